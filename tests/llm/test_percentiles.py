import random
from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest

from millrace.llm.percentiles import PERCENTILES, duration_states, merge_states, percentiles, value_states

GROUPS = ["project_id", "status"]


def found(df, groups=GROUPS, ps=PERCENTILES, partitions=None):
    return {tuple(r)[: len(groups)]: (r["n_rows"], *[float(x) for x in tuple(r)[len(groups) + 1 :]]) for r in percentiles(df, groups, ps, partitions).collect()}


@pytest.mark.parametrize("partitions", [1, 4, 13])
def test_exact_over_any_partitions(spark, partitions):
    r = random.Random(partitions)
    data = {("a", "X"): [r.randrange(60) for _ in range(3000)], ("b", None): [7], (None, "Y"): [3, 3, 4], ("c", "X"): [r.randrange(10**15) for _ in range(40)], ("d", "Z"): [5] * 50}
    rows = [(*k, v) for k, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "project_id string, status string, v long")
    got = found(value_states(df, GROUPS, "v"), partitions=partitions)
    assert set(got) == set(data)
    for k, vs in data.items():
        assert got[k][0] == len(vs) and got[k][-1] == 0.0
        np.testing.assert_allclose(got[k][1:-1], np.quantile(np.array(vs), np.array(PERCENTILES) / 100), rtol=1e-12)


def test_days_put_together(spark):
    r = random.Random(1)
    rows = [(str(i), "p", "OK", r.choice([None, -5, r.randrange(1000)]), datetime(2024, 1, 1) + timedelta(days=i % 3)) for i in range(300)]
    rows += rows[:50] + [(rows[0][0], "p", "OK", rows[0][3], datetime(2024, 1, 9))]
    df = spark.createDataFrame(rows, "id string, project_id string, status string, duration_ms long, created_at timestamp_ntz")
    days = duration_states(df)
    one = {i: v for i, _, _, v, _ in rows if v is not None and v >= 0}
    got = found(merge_states(days, GROUPS))["p", "OK"]
    assert got[0] == len(one)
    np.testing.assert_allclose(got[1:-1], np.quantile(list(one.values()), np.array(PERCENTILES) / 100))
    parts = [days.where(f"day = DATE'2024-01-0{i}'").drop("day") for i in (1, 2, 3)]
    again = found(merge_states(parts[0].unionByName(parts[1]).unionByName(parts[2]), GROUPS))["p", "OK"]
    assert again == got
    assert {k[2].day for k in found(days, [*GROUPS, "day"])} == {1, 2, 3}


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([("a", "X", 1, 2, "k", 3)], "project_id string, status string, v long, n long, kind string, value long")
    assert found(value_states(df, GROUPS, "v"))["a", "X"][:2] == (1, 1.0)
    assert found(value_states(df.limit(0), GROUPS, "v")) == {}
    assert found(value_states(df.where("v < 0"), GROUPS, "v")) == {}
    with pytest.raises(ValueError):
        percentiles(df.select("value", "n", df.kind.alias("p50")), ["p50"])


@pytest.mark.parametrize("held", [1, 50])
def test_results_are_exact_decimals_whatever_is_kept(spark, held):
    """Sums of hundredths of neighbouring values, also of values beyond a double's reach, and of groups in many pieces."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        r = random.Random(held)
        data = {"a": [r.randrange(2**62) for _ in range(700)], "b": [9007199254740993, 9007199254740994], "c": [27636, 27637, 27637, 27637], "d": list(range(5))}
        df = spark.createDataFrame([(g, v, 1) for g, vs in data.items() for v in vs], "g string, value long, n long")
        states = merge_states(df, ["g"])
        for partitions in (1, 3):
            got = {x["g"]: x for x in percentiles(states, ["g"], partitions=partitions, held=held).collect()}
            for g, vs in data.items():
                vs = sorted(vs)
                for p in PERCENTILES:
                    at, rest = divmod((len(vs) - 1) * p, 100)
                    want = Decimal(vs[at] * (100 - rest) + vs[min(at + 1, len(vs) - 1)] * rest).scaleb(-2)
                    assert got[g][f"p{p}"] == want and got[g]["max_error"] == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with pytest.raises(ValueError):
        percentiles(states, ["g"], (99.5,))

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.operators.intervals import merged_intervals

T0 = datetime(2024, 3, 31)
at = lambda s: None if s is None else T0 + timedelta(seconds=s)
SCHEMA = "e string, s timestamp_ntz, t timestamp_ntz"


def brute(rows):
    by = {}
    for e, s, t in rows:
        if s is not None and t is not None and t > s:
            by.setdefault(e, []).append((s, t))
    out = set()
    for e, v in by.items():
        v.sort()
        s, t = v[0]
        for a, b in v[1:]:
            if a > t:
                out |= {("period", e, s, t), ("gap", e, t, a)}
                s, t = a, b
            else:
                t = max(t, b)
        out.add(("period", e, s, t))
    return out


def found(spark, rows, partitions, schema=SCHEMA):
    got = [tuple(r) for r in merged_intervals(spark.createDataFrame(rows, schema), "e", "s", "t", partitions).collect()]
    assert len(got) == len(set(got))
    return set(got)


times = st.one_of(st.none(), st.integers(0, 40))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "a", "b", None]), times, times), max_size=30), st.sampled_from([1, 3, 7]))
def test_any_intervals(spark, rows, partitions):
    rows = [(e, at(s), at(t)) for e, s, t in rows]
    assert found(spark, rows, partitions) == brute(rows)


@pytest.mark.parametrize("partitions", [1, 5, 16])
def test_one_entity_over_many_partitions(spark, partitions):
    long = [("a", at(0), at(100_000))]
    rows = [("a", at(3 * i), at(3 * i + 1 + i % 4)) for i in range(400)]
    assert found(spark, rows, partitions) == brute(rows)
    assert found(spark, rows + long, partitions) == {("period", "a", at(0), at(100_000))}


def test_touching_equal_reversed_and_repeated(spark):
    rows = [("a", at(0), at(5)), ("a", at(5), at(9)), ("a", at(5), at(9)), ("a", at(7), at(7)), ("a", at(20), at(12))]
    assert found(spark, rows, 3) == {("period", "a", at(0), at(9))}


def test_empty(spark):
    assert found(spark, [], 3) == set()
    assert found(spark, [("a", None, at(1))], 3) == set()


def test_clashing_columns(spark):
    df = spark.createDataFrame([("a", at(0), at(1), "x", 1, "y")], SCHEMA + ", kind string, pid int, entity string")
    assert [tuple(r) for r in merged_intervals(df, "e", "s", "t").collect()] == [("period", "a", at(0), at(1))]


@pytest.mark.parametrize("batch", [1, 3])
def test_batch_by_batch(spark, batch):
    """However small the batches are: nested, touching and hanging over borders, first entities with unknown depth."""
    r = random.Random(batch)
    rows = [(r.choice(["a", "a", "a", "b", "c"]), at(s := r.randrange(300)), at(s + r.choice([1, 2, 5, 40]))) for _ in range(120)] + [("a", at(0), at(90)), ("b", at(100), at(299))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        for partitions in (1, 4):
            assert found(spark, rows, partitions) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

import random
from datetime import datetime, timedelta

import pytest

from millrace.operators.references import contiguous_runs, orphan_references

T0 = datetime(2024, 1, 30)
at = lambda d: None if d is None else T0 + timedelta(days=d)
REFS = "order_id long, cid string, pid string, t timestamp_ntz"
PARENT = "id string, c timestamp_ntz, d timestamp_ntz"


def brute(refs, parents):
    out = set()
    for oid, cid, pid, t in refs:
        for key, name in ((cid, "customers"), (pid, "products")):
            if key is None or t is None:
                continue
            k = key.strip(" ").upper()
            own = [(c, d) for i, c, d in parents[name] if i is not None and i.strip(" ").upper() == k]
            if any(c is not None and c <= t and (d is None or d > t) for c, d in own):
                continue
            reason = "missing" if not own else "late" if all(c is not None and c > t for c, d in own) else "deleted"
            out.add((oid, name, reason, t.strftime("%Y-%m")))
    return out


def found(spark, refs, parents, partitions):
    r = spark.createDataFrame(refs, REFS)
    links = [(col, name, spark.createDataFrame(parents[name], PARENT), "id", "c", "d") for col, name in (("cid", "customers"), ("pid", "products"))]
    got = [tuple(x) for x in orphan_references(r, "order_id", "t", links, partitions).collect()]
    assert len(got) == len(set(got))
    return set(got)


IDS = ["C1", "C2", "c2 ", "C3", "C007", "C7", "C-9", "X", "", " ", "9", "C" + "9" * 19, "C" + "9" * 18, "C1A"]


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    day = lambda: r.choice([None, *range(12)])
    parents = {n: [(r.choice([*IDS, None]), day(), day()) for _ in range(r.choice([0, 6, 25]))] for n in ("customers", "products")}
    parents = {n: [(i, at(c), at(d)) for i, c, d in v] for n, v in parents.items()}
    refs = [(r.choice([i, i, None, 1]), r.choice([*IDS, None, "C2", "C2"]), r.choice([*IDS, None]), at(day())) for i in range(80)]
    refs += refs[:5]
    for partitions in (1, 4, 13):
        assert found(spark, refs, parents, partitions) == brute(refs, parents)


def test_hot_key_over_partitions(spark):
    parents = {"customers": [("C5", at(0), at(50)), ("C5", at(60), None), ("C9", at(0), None)], "products": []}
    refs = [(i, "C5", None, at(i % 100)) for i in range(600)] + [(1000 + i, "C9", None, at(i)) for i in range(50)]
    assert found(spark, refs, parents, 12) == brute(refs, parents)


def test_empty_and_clashing(spark):
    assert found(spark, [], {"customers": [], "products": []}, 2) == set()
    r = spark.createDataFrame([(1, "C1", at(1), "x", 2)], "order_id long, cid string, t timestamp_ntz, space string, n int")
    p = spark.createDataFrame([("C2", at(0), None, 1)], PARENT + ", kind int")
    got = orphan_references(r, "order_id", "t", [("cid", "customers", p, "id", "c", "d")]).collect()
    assert [tuple(x) for x in got] == [(1, "customers", "missing", "2024-01")]


def test_runs(spark):
    keys = spark.createDataFrame([("a", n) for n in (1, 2, 3, 7, 8, 20, 2, (1 << 20) - 1, 1 << 20)] + [("b", 4)], "space string, n long")
    assert {tuple(r) for r in contiguous_runs(keys).collect()} == {("a", 1, 3), ("a", 7, 8), ("a", 20, 20), ("a", (1 << 20) - 1, (1 << 20) - 1), ("a", 1 << 20, 1 << 20), ("b", 4, 4)}


def test_any_type_of_id_batch_by_batch(spark):
    """Ids may be texts; small batches hand on the last run and the latest end."""
    r = random.Random(8)
    parents = [(f"C{n}", at(r.randrange(20)), r.choice([None, at(20 + r.randrange(20))])) for n in [*range(1, 30), *range(40, 60)] for _ in range(1 + n % 2)]
    refs = [(f"order {i}", f"C{r.randrange(70)}", at(r.randrange(45))) for i in range(300)] + [(None, "C99", at(1))]
    p = spark.createDataFrame(parents, "k string, c timestamp_ntz, d timestamp_ntz")
    df = spark.createDataFrame(refs, "o string, k string, t timestamp_ntz")
    want = set()
    for o, k, t in refs:
        own = [(c, d) for x, c, d in parents if x == k]
        if not any(c <= t and (d is None or d > t) for c, d in own):
            want.add((o, "parents", "missing" if not own else "late" if all(c > t for c, _ in own) else "deleted", t.strftime("%Y-%m")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        for partitions in (1, 5):
            assert {tuple(x) for x in orphan_references(df, "o", "t", [("k", "parents", p, "k", "c", "d")], partitions).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

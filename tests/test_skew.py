import pytest
from pyspark.sql import functions as F

from millrace.core.runtime import sorted_scan
from millrace.operators import skew
from millrace.operators.skew import heavy_keys, key_totals, skewed_aggregate

SCHEMA = "order_id long, customer_id string, product_id string, quantity int, unit_price double"


@pytest.mark.parametrize("partitions", [1, 4, 9])
def test_totals(spark, partitions):
    rows = [(i, "c1" if i % 3 else f" C{i} ", None if i % 5 == 0 else "P", None if i % 7 == 0 else i, 0.1) for i in range(300)] * 2
    got = {(r[0], r[1]): tuple(r)[2:] for r in key_totals(spark.createDataFrame(rows, SCHEMA), ["customer_id", "product_id"], "order_id", "quantity", "unit_price", partitions).collect()}
    want = {}
    for _, c, p, q, u in rows:
        for f, k in (("customer_id", c), ("product_id", p)):
            t = want.setdefault((f, k and k.strip().upper()), [0, None, None])
            t[0] += 1
            if q is not None:
                t[1], t[2] = (t[1] or 0) + q, (t[2] or 0) + q * u
    assert set(got) == set(want)
    for k, (n, q, rev) in want.items():
        assert got[k][:2] == (n, q) and (got[k][2] is None) == (rev is None) and (rev is None or abs(got[k][2] - rev) < 1e-6)


def test_heavy_keys_count_nulls_in_the_total(spark):
    rows = [(i, "a" if i < 2 else None if i < 60 else f"b{i}", "p", 1, 1.0) for i in range(100)]
    t = key_totals(spark.createDataFrame(rows, SCHEMA), ["customer_id", "product_id"], "order_id", "quantity", "unit_price")
    assert {tuple(r) for r in heavy_keys(t, 0.02).collect()} == {("customer_id", "A"), ("product_id", "P")}


def test_empty_infinite_and_clashing(spark):
    df = spark.createDataFrame([(1, "a", "b", 2, float("inf"), "x", 3)], SCHEMA + ", field_name string, a int")
    r = key_totals(df, ["customer_id"], "order_id", "quantity", "unit_price").collect()
    assert [tuple(x) for x in r] == [("customer_id", "A", 1, 2, None)]
    assert key_totals(df.limit(0), ["customer_id"], "order_id", "quantity", "unit_price").count() == 0


def test_a_heavy_key_spans_partitions(spark):
    df = spark.range(20_000).select(F.when(F.col("id") < 19_999, "hot").otherwise("cold").alias("k"), F.col("id").alias("o"))
    parts = df.repartitionByRange(8, "k", "o").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 20_000 / 3


@pytest.mark.parametrize("rows", [1, 7, 1 << 17])
def test_only_edges_are_stitched(spark, monkeypatch, rows):
    """Whatever a task adds up at once: all keys come out, and no more than two a partition move again."""
    monkeypatch.setattr(skew, "_ROWS", rows)
    data = [(None if i % 10 == 9 else f"k{(i * i) % 97}" if i % 3 else "hot", i % 11, None if i % 5 == 0 else i) for i in range(600)]
    df = spark.createDataFrame(data, "k string, o int, v int")
    stitched = []
    monkeypatch.setattr(skew, "sorted_scan", lambda *a: stitched.append(sorted_scan(*a)) or stitched[-1])
    got = {r["k"]: tuple(r)[1:] for r in skewed_aggregate(df, ["k"], "o", {"n": ("count", None), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "o")}, 5).collect()}
    want = {}
    for k, o, v in data:
        want.setdefault(k, []).append((o, v))
    values = lambda x: [v for _, v in x if v is not None]
    assert got == {k: (len(x), sum(values(x)) if values(x) else None, min(values(x), default=None), max(o for o, _ in x)) for k, x in want.items()}
    edges, rest = stitched[0].where("edge").count(), stitched[0].where("NOT edge")
    assert 0 < edges <= 10 and rest.count() == rest.select("k0").distinct().count()


def test_sums_of_whole_numbers_do_not_wrap(spark):
    df = spark.createDataFrame([("a", 1, 2**62)] * 3 + [("b", 1, 5)], "k string, o int, v long")
    with pytest.raises(Exception, match="(?i)overflow|out of range"):
        skewed_aggregate(df, ["k"], "o", {"s": ("sum", "v")}, 2).collect()
    with pytest.raises(ValueError):
        skewed_aggregate(df, ["k"], "o", {"s": ("median", "v")})

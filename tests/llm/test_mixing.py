import hashlib

import pytest

from millrace.llm.mixing import mix, sized_prefixes

TARGETS = "source string, target_share double, max_repeats int"


def brute(sizes, targets, seed=17):
    total = sum(n for _, _, n in sizes)
    times = {}
    for s, share, most in targets:
        docs = sorted(((hashlib.md5(f"{seed}|{d}".encode()).hexdigest(), d, n) for d, x, n in sizes if x == s))
        size = sum(n for *_, n in docs)
        budget = int(share * total + 0.5)
        epochs = min(most, budget // size) if size else min(most, 1)
        left, upto = budget - epochs * size, 0
        for _, d, n in docs:
            upto += n
            last = epochs < most and left > 0 and upto - n < left and 2 * (upto - left) <= n
            if epochs + last:
                times[d] = epochs + last
    return times


@pytest.mark.parametrize("partitions", [1, 5, 12])
def test_against_brute_force(spark, partitions):
    sizes = [(i, "big" if i % 3 else "mid", 5 + i % 11) for i in range(400)] + [(1000 + i, "small", 40) for i in range(3)] + [(2000, None, 500), (2001, "unlisted", 700), (2002, "zero", 0)]
    targets = [("big", 0.3, 1), ("mid", 0.5, 4), ("small", 0.1, 2), ("none", 0.05, 4), ("zero", 0.05, 3)]
    docs, shares = mix(spark.createDataFrame(sizes, "doc_id long, source string, n_tokens long"), spark.createDataFrame(targets, TARGETS), partitions=partitions)
    assert {r["doc_id"]: r["times"] for r in docs.collect()} == brute(sizes, targets)
    total = sum(n for *_, n in sizes)
    by = {r["source"]: r for r in shares.collect()}
    assert set(by) == {t[0] for t in targets} and by["none"]["tokens"] == 0 and by["small"]["tokens"] == 2 * 120
    for s in ("big", "mid"):  # sources that are large enough come within half a document of their budget
        assert abs(by[s]["tokens"] - by[s]["target_share"] * total) <= 8.5
    assert abs(sum(r["share_of_mix"] for r in by.values()) - 1) < 1e-9


def test_prefix_sums(spark):
    sizes = [(i, "a" if i < 90 else "b", i) for i in range(100)]
    rows = sized_prefixes(spark.createDataFrame(sizes, "doc_id long, source string, n long"), "doc_id", "source", "n", 1, 7).collect()
    for s in "ab":
        own = sorted((hashlib.md5(f"1|{d}".encode()).hexdigest(), d, n) for d, x, n in sizes if x == s)
        upto, want = 0, {}
        for _, d, n in own:
            upto += n
            want[d] = upto
        assert {r["doc_id"]: r["upto"] for r in rows if r["source"] == s} == want
        assert {r["source_size"] for r in rows if r["source"] == s} == {upto}


def test_empty_and_clashing(spark):
    none = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    docs, shares = mix(none, spark.createDataFrame([("a", 1.0, 2)], TARGETS))
    assert docs.count() == 0 and [tuple(r)[:1] for r in shares.collect()] == [("a",)]
    one = spark.createDataFrame([(1, "a", 10, "x", 2)], "doc_id long, source string, n_tokens long, upto string, times int")
    docs, _ = mix(one, spark.createDataFrame([("a", 1.0, 2)], TARGETS))
    assert [tuple(r) for r in docs.collect()] == [(1, "a", 10, 1)]
    docs, _ = mix(one, spark.createDataFrame([], TARGETS))
    assert docs.count() == 0


def test_keys_may_be_texts(spark):
    sizes = spark.createDataFrame([(f"doc {i}", "a" if i % 2 else "b", 10) for i in range(40)], "doc_id string, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.25, 1), ("b", 0.75, 2)], "source string, target_share double, max_repeats int")
    used, shares = mix(sizes, targets)
    got = [tuple(r) for r in used.select("doc_id", "source", "n_tokens", "times").collect()]
    assert sum(n * t for _, s, n, t in got if s == "a") == 100 and sum(n * t for _, s, n, t in got if s == "b") == 300
    assert {r["source"]: r["tokens"] for r in shares.collect()} == {"a": 100, "b": 300}

import random
from datetime import datetime, timedelta

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from millrace.operators import drift
from millrace.operators.drift import correspondences, feed_changes, feed_name, feed_versions, field_changes, flood, read_versions, unified_fields, unified_type, unite

NAMES = ["customer_id", "customer_key", "order_date", "order_day", "amount", "total_amount", "x", "y"]


def rule(old, ot, new, nt):
    """The positional rule on its own."""
    a, b = dict(zip(old, ot)), dict(zip(new, nt))
    shared = [n for n in old if n in b]
    out = {("retyped", n) for n in shared if a[n] != b[n]}

    def slots(names):
        ends = ["", *[n for n in names if n in a and n in b], ""]
        found, k = {}, 0
        between = [[]]
        for n in names:
            if n in a and n in b:
                between.append([])
            else:
                between[-1].append(n)
        for k in range(len(between)):
            found[ends[k], ends[k + 1]] = between[k]
        return found

    s, t = slots(old), slots(new)
    gone, come = {n for n in old if n not in b}, {n for n in new if n not in a}
    for k, v in s.items():
        w = t.get(k, [])
        if len(v) == len(w) == 1 and a[v[0]] == b[w[0]]:
            out.add(("renamed", w[0]))
            gone.discard(v[0])
            come.discard(w[0])
    return out | {("removed", n) for n in gone} | {("added", n) for n in come}


lists = st.lists(st.sampled_from(NAMES), unique=True, max_size=7)
kinds = st.lists(st.sampled_from(["string", "integer"]), min_size=8, max_size=8)


@settings(max_examples=1500, deadline=None)
@given(lists, kinds, lists, kinds)
def test_flooding_loses_no_rename(old, ot, new, nt):
    ot, nt = ot[: len(old)], nt[: len(new)]
    assert {(k, f) for k, f, *_ in field_changes(old, ot, new, nt)} == rule(old, ot, new, nt)


def test_correspondence_of_a_renamed_field():
    pairs = correspondences(["id", "name", "total"], ["integer", "string", "number"], ["id", "full_name", "total"], ["integer", "string", "number"])
    assert (1, 1) in pairs and (0, 0) in pairs and (2, 2) in pairs


def ktr(fields, extra=""):
    inner = "".join(f"<field><name>{n}</name>{f'<type>{t}</type>' if t else ''}</field>" for n, t in fields)
    return f"<transformation><info><name>f</name></info>{extra}<step><name>in</name><type>CsvInput</type><fields>{inner}</fields></step></transformation>".encode()


FILES = "id string, project_id string, filename string, file_type string, content binary, size_bytes long, created_at timestamp_ntz"


def test_feed_names(spark):
    names = {"a/b\\Load_Leads_EU_V1.KTR": "load_leads_eu", "load_leads_eu-v07.ktr": "load_leads_eu", "load_leads_eu (4).ktr": "load_leads_eu", "load_leads_eu.2024-01-31.ktr": "load_leads_eu", "load_leads_eu_20240131.ktr": "load_leads_eu", "load_leads_eu_rev3.ktr": "load_leads_eu", "load_leads_b2b.ktr": "load_leads_b2b", "load_leads_eu copy.ktr": "load_leads_eu"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(feed_name(df["n"])).collect()] == list(names.values())


def test_changes_over_partitions(spark):
    r = random.Random(3)
    rows, versions = [], []
    fields = [("a", "String"), ("b", ""), ("c", "Integer")]
    for i in range(60):
        if i % 3 == 1:
            fields = [*fields]
            k = r.randrange(len(fields))
            fields[k] = (f"n{i}", fields[k][1])
        elif i % 3 == 2:
            fields = [*fields, (f"m{i}", "Date")] if r.random() < 0.6 or len(fields) < 2 else fields[1:]
        rows.append((f"f{i:03}", "p", f"feed_v{i}.ktr", "KTR", ktr(fields), 1, datetime(2024, 1, 1) + timedelta(days=i)))
        versions.append(fields)
    want = set()
    low = lambda v: ([n for n, _ in v], [(t or "String").lower() for _, t in v])
    for i in range(1, 60):
        want |= {(f"f{i:03}", k, n) for k, n in rule(*low(versions[i - 1]), *low(versions[i]))}
    df = spark.createDataFrame(rows, FILES)
    for partitions in (1, 4, 11):
        got = [tuple(x) for x in feed_changes(df, partitions).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_damaged_null_empty_and_unified(spark):
    day = lambda i: datetime(2024, 1, 1 + i)
    rows = [
        ("1", "p", "x_v1.ktr", "KTR", ktr([("A", "integer"), ("b", None)]), 1, day(0)),
        ("2", "p", "x_v2.ktr", "KTR", b"<transformation><step>", 1, day(1)),
        ("3", "p", "x_v3.ktr", "KTR", None, 1, day(2)),
        ("4", "p", "x_v4.ktr", "KTR", ktr([("a ", "Number"), ("B", "STRING")]), 1, day(3)),
        ("5", "q", "x_v5.ktr", "KTR", ktr([("z", "Number")]), 1, day(4)),
        ("6", "p", "x.kjb", "KJB", b"<job/>", 1, day(5)),
        ("7", None, None, "KTR", ktr([]), None, None),
    ]
    df = spark.createDataFrame(rows, FILES)
    assert {tuple(r) for r in feed_changes(df).collect()} == {("4", "retyped", "a")}
    fields = {(r["file_id"], r["field_name"], r["declared_type"], r["unified_type"]) for r in unified_fields(df).collect()}
    assert ("1", "a", "integer", "number") in fields and ("4", "b", "string", "string") in fields and ("5", "z", "number", "number") in fields
    assert feed_changes(df.limit(0)).count() == 0 and feed_versions(df).count() == 4


def test_flooding_settles_and_decides():
    """Two fields vanish and two appear in one place: order, names and types tell which is which."""
    old, new = ["id", "cust_name", "fax", "total"], ["id", "customer_name", "loyalty", "total"]
    kinds = ["integer", "string", "string", "number"]
    assert set(correspondences(old, kinds, new, kinds)) == {(0, 0), (1, 1), (2, 2), (3, 3)}
    s = flood(old, kinds, new, kinds)
    assert s[1, 1] > max(s[1, 2], s[2, 1]) and s[0, 0] > 0.8
    swapped = correspondences(["id", "a", "b", "t"], ["integer", "string", "number", "date"], ["id", "x", "y", "t"], ["integer", "number", "string", "date"])
    assert (0, 0) in swapped and (3, 3) in swapped and len(swapped) == 4
    assert flood([], [], new, kinds).shape == (0, 4)


def test_records_are_united(spark, monkeypatch):
    one = spark.createDataFrame([(1, "Ann", 5, ("x", 1)), (2, None, None, None)], "id int, cust_name string, n int, addr struct<city string, zip int>")
    two = spark.createDataFrame([(2**40, "Bob", 2.5, ("y", 7))], "ID long, customer_name string, n double, addr struct<city string, zip_code int>")
    three = spark.createDataFrame([("Cy", 1.0, True, "v")], "customer_name string, n double, cust_name boolean, version string")
    got, changes = unite([("1", one), ("2", two), ("3", three), ("4", three.limit(0))])
    assert got.dtypes == [("_version", "string"), ("id", "bigint"), ("customer_name", "string"), ("n", "double"), ("addr_city", "string"), ("addr_zip_code", "int"), ("cust_name", "boolean"), ("version", "string")]
    assert {tuple(r) for r in got.collect()} == {("1", 1, "Ann", 5.0, "x", 1, None, None), ("1", 2, None, None, None, None, None, None), ("2", 2**40, "Bob", 2.5, "y", 7, None, None), ("3", None, "Cy", 1.0, None, None, True, "v")}
    assert {c[:4] for c in changes} == {("2", "retyped", "id", "id"), ("2", "renamed", "customer_name", "cust_name"), ("2", "retyped", "n", "n"), ("2", "renamed", "addr_zip_code", "addr_zip"), ("3", "removed", "id", "id"), ("3", "removed", "addr_city", "addr_city"), ("3", "removed", "addr_zip_code", "addr_zip_code"), ("3", "added", "cust_name", None), ("3", "added", "version", None)}
    # without flooding nothing but equal names corresponds
    monkeypatch.setattr(drift, "flood", lambda a, b, c, d, *_: np.zeros((len(a), len(c))))
    other, _ = unite([("1", one), ("2", two)])
    assert "cust_name" in other.columns and "customer_name" in other.columns


def test_unified_types():
    of = lambda a, b: unified_type(T._parse_datatype_string(a), T._parse_datatype_string(b)).simpleString()
    assert of("int", "bigint") == "bigint" and of("int", "double") == "double" and of("date", "timestamp_ntz") == "timestamp_ntz" and of("int", "boolean") == "string"


def test_files_of_one_schema_are_read_together(spark, tmp_path):
    for i, cols in enumerate((["id", "id AS a"], ["id + 10 AS id", "id AS a"], ["id + 20 AS id", "CAST(id AS string) AS a"])):
        spark.range(3).selectExpr(*cols).write.parquet(str(tmp_path / str(i)))
    versions = read_versions(spark, [str(tmp_path / str(i)) for i in range(3)])
    assert [df.count() for _, df in versions] == [6, 3]
    got, changes = unite(versions)
    assert {(r["id"], r["a"]) for r in got.collect()} == {(i + 10 * k, str(i)) for k in range(3) for i in range(3)} and [c[1] for c in changes] == ["retyped"]

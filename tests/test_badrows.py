import csv
import io

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.operators.badrows import DECIMAL, Field, number_up_to, signed_up_to, split_lines
from millrace.plans.problem_queries import ORDER_FIELDS

CASES = {
    "1,C,P,2,3.5,OK": None,
    "1,C,P,2,3.5,OK\r": None,
    " 1 , C,P , -2 ,\t3.5 ,": None,
    '"1","C, x","P ""q""","","","O"': None,
    "9223372036854775807,,,2147483647,0.0,": None,
    "0009223372036854775807,,,-2147483648,-1,": None,
    "9223372036854775808,,,,,": "bad_order_id",
    "0,,,,,": "bad_order_id",
    ",,,,,": "bad_order_id",
    "-1,,,,,": "bad_order_id",
    "١,,,,,": "bad_order_id",
    "1,,,2147483648,,": "bad_quantity",
    "1,,,-2147483649,,": "bad_quantity",
    '1,,," 1",,': "bad_quantity",
    "1,,,+1,,": "bad_quantity",
    "1,,,1.0,,": "bad_quantity",
    "1,,,1,.5,": "bad_unit_price",
    "1,,,1,5.,": "bad_unit_price",
    "1,,,1,1e3,": "bad_unit_price",
    "1,,,1,NaN,": "bad_unit_price",
    "": "column_count",
    "1,2,3": "column_count",
    "1,2,3,4,5,6,7": "column_count",
    "1;2;3;4;5;6": "column_count",
    '1,"C,P,2,3.5,OK': "broken_quoting",
    '1,"C"x,P,2,3.5,OK': "broken_quoting",
    '1,C"x,P,2,3.5,OK': "broken_quoting",
    '1, "C",P,2,3.5,OK': "broken_quoting",
    '1,"C" ,P,2,3.5,OK': "broken_quoting",
    '"': "broken_quoting",
    "1,C,P,2,3.5,O\nK": None,
    "1,C,P,2\n,3.5,OK": "bad_quantity",
    "1,C,P,2,3.5,OK\r\r": None,
    "0" * 50_000 + "x,,,,,": "bad_order_id",
    "1,,," + " " * 50_000 + "x,,": "bad_quantity",
    "1," + '"' + '""' * 50_000 + '",,,,': None,
    "," * 50_000: "column_count",
}


def reasons(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    good, bad = split_lines(df, "line", ORDER_FIELDS)
    got = {r["i"]: r["reason"] for r in bad.collect()}
    ok = {r["i"]: r for r in good.collect()}
    assert not set(got) & set(ok) and len(got) + len(ok) == len(lines)
    return got, ok


def test_cases(spark):
    got, _ = reasons(spark, list(CASES))
    assert [got.get(i) for i in range(len(CASES))] == list(CASES.values())


def test_typed_values(spark):
    _, ok = reasons(spark, ['"1","C, x","P ""q""","","","O"', " 07 , C,P , -2 ,\t3.5 ,\r", "1,,,,,"])
    assert tuple(ok[0])[2:] == (1, "C, x", 'P "q"', None, None, "O")
    assert tuple(ok[1])[2:] == (7, "C", "P", -2, 3.5, None)
    assert tuple(ok[2])[2:] == (1, None, None, None, None, None)


def test_null_repeated_empty_and_clashing(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", "1,,,,,", 2), ("b", "1,,,,,", 2)], "reason string, line string, order_id int")
    good, bad = split_lines(df, "line", ORDER_FIELDS)
    assert [tuple(r) for r in bad.collect()] == [("a", None, 1, "column_count")]
    assert bad.columns == ["_reason", "line", "order_id", "reason"]
    assert good.columns[:3] == ["reason", "line", "_order_id"] and good.count() == 2
    assert split_lines(df.limit(0), "line", ORDER_FIELDS)[0].count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='1,"a \t', max_size=9), min_size=1, max_size=60))
def test_quoting_against_a_state_machine(spark, lines):
    def machine(line):
        fields, i = 1, 0
        while True:
            if line[i : i + 1] == '"':
                i += 1
                while True:
                    k = line.find('"', i)
                    if k < 0:
                        return "broken_quoting"
                    if line[k + 1 : k + 2] == '"':
                        i = k + 2
                        continue
                    i = k + 1
                    break
                if line[i : i + 1] not in ("", ","):
                    return "broken_quoting"
            else:
                k = line.find(",", i)
                part = line[i:] if k < 0 else line[i:k]
                if '"' in part:
                    return "broken_quoting"
                i += len(part)
            if i >= len(line):
                return None if fields == 2 else "column_count"
            i += 1
            fields += 1

    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    good, bad = split_lines(df, "line", [Field("x"), Field("y")])
    got = {r["i"]: r["reason"] for r in bad.collect()}
    assert [got.get(i) for i in range(len(lines))] == [machine(x) for x in lines]
    for r in good.collect():
        if '"' not in r["line"]:
            assert [r["x"] or "", r["y"] or ""] == [v.strip(" \t") for v in r["line"].split(",")]
        elif " " not in r["line"] and "\t" not in r["line"]:
            assert [r["x"] or "", r["y"] or ""] == next(csv.reader(io.StringIO(r["line"])))


@pytest.mark.parametrize("limit", [1, 9, 10, 99, 100, 255, 2**31 - 1, 2**63 - 1])
def test_number_patterns(limit):
    import re

    p, q = re.compile(rf"\A{number_up_to(limit)}\Z"), re.compile(rf"\A{number_up_to(limit, 1)}\Z")
    for n in {0, 1, 5, 9, 10, 11, 99, 100, 101, 199, 200, limit - 1, limit, limit + 1, limit * 10, limit + 10**9}:
        assert bool(p.match(str(n))) == (n <= limit), (limit, n)
        assert bool(q.match("00" + str(n))) == (1 <= n <= limit), (limit, n)
    assert re.match(rf"\A{signed_up_to(8)}\Z", "-128") and not re.match(rf"\A{signed_up_to(8)}\Z", "128")
    assert re.match(rf"\A{DECIMAL}\Z", "-1.50")

"""Every step on string rows, with the edge cases of its contract."""

import os
import smtplib
import zipfile

import pytest
from pyspark.sql import functions as F

import millrace.plans.compiler  # noqa: F401
from millrace.frame import Frame
from millrace.registry import STEPS, Context, Params


def frame(spark, rows, width=None):
    width = width or max(map(len, rows), default=1)
    df = spark.createDataFrame([(i, *r, *[None] * (width - len(r))) for i, r in enumerate(rows)], "at long" + "".join(f", c{i} string" for i in range(width)))
    f = Frame.of(df.repartition(3), ["at", *[f"c{i}" for i in range(width)]][:1], text=True)
    return f.put([f.col(i + 1) for i in range(width)], [f"n{i}" for i in range(width)])


def rows(f):
    return [tuple(r) for r in f.sorted().select(*f.fields()).collect()]


def run(spark, kind, ins, params=None, context=None):
    ins = [i if isinstance(i, Frame) else frame(spark, i) for i in ins]
    got = STEPS[kind](ins, Params(params or {}), context or Context(spark))
    return {k: rows(f) for k, f in got.items()} if isinstance(got, dict) else rows(got)


AB = [("a", "1"), ("b", None), (None, "3")]
CASES = [
    ("SelectValues", [AB], {"columns": "1,0,0,9"}, [("1", "a", "a", None), (None, "b", "b", None), ("3", None, None, None)]),
    ("Constant", [[("a",)]], {"value.0": "x", "value.1": "y", "value.3": "z"}, [("a", "x", "y")]),
    ("SetValueConstant", [[("a", "b")]], {"column": "1"}, [("a", None)]),
    ("SetValueField", [[("a", "b")]], {"sourceColumn": "0", "targetColumn": "1"}, [("a", "a")]),
    ("ConcatFields", [AB], {"columns": "0,1", "separator": "-"}, [("a", "1", "a-1"), ("b", None, "b-"), (None, "3", "-3")]),
    ("FieldSplitter", [[("x.y.z", "k"), (None, "l"), ("", "m")]], {"column": "0", "separator": ".", "outputCount": "2"}, [("x", "y", "k"), (None, None, "l"), ("", None, "m")]),
    ("FieldSplitter", [[("x|y|z",), ("q",)]], {"column": "0", "separator": "|"}, [("x", "y", "z"), ("q", None, None)]),
    ("CloneRow", [[("a",), ("b",)]], {"cloneCount": "2"}, [("a",), ("a",), ("b",), ("b",)]),
    ("CloneRow", [[("a",)]], {"cloneCount": "0"}, []),
    ("Sequence", [[("b",), ("a",), ("c",)]], {"start": "5", "increment": "-2"}, [("b", "5"), ("a", "3"), ("c", "1")]),
    ("StringOperations", [[(" \ta b\n",), (None,)]], {"column": "0"}, [("a b",), (None,)]),
    ("StringOperations", [[("\u2003 x ",)]], {"column": "0", "operation": "ltrim"}, [("x ",)]),
    ("StringOperations", [[("hELLO  wORLD",)]], {"column": "0", "operation": "initcap"}, [("Hello World",)]),
    ("ReplaceString", [[("a.b.c",)]], {"column": "0", "search": ".", "replacement": "$1"}, [("a$1b$1c",)]),
    ("ReplaceString", [[("ab12",)]], {"column": "0", "search": "([a-z]+)(\\d+)", "replacement": "$2$1", "regex": "true"}, [("12ab",)]),
    ("StringCut", [[("hello",), ("h",), (None,)]], {"column": "0", "fromIndex": "1", "toIndex": "3"}, [("el",), ("",), (None,)]),
    ("StringCut", [[("hello",)]], {"column": "0", "fromIndex": "2"}, [("llo",)]),
    ("RegexEval", [[("k=v",), ("none",), (None,)]], {"column": "0", "pattern": "(\\w+)=(?:x|(v))"}, [("k=v", "k", "v"), ("none", None, None), (None, None, None)]),
    ("ValueMapper", [[("a",), ("b",), (None,)]], {"column": "0", "from.0": "a", "to.0": "A", "defaultValue": "?"}, [("A",), ("?",), ("?",)]),
    ("ValueMapper", [[("a",), ("b",), (None,)]], {"column": "0", "from.0": "a", "to.0": "A"}, [("A",), ("b",), (None,)]),
    ("IfNull", [AB], {"defaultValue": "-"}, [("a", "1"), ("b", "-"), ("-", "3")]),
    ("NullIf", [AB], {"column": "0", "value": "a"}, [(None, "1"), ("b", None), (None, "3")]),
    ("Calculator", [[("6", "0"), ("x", "1"), (None, "1"), ("-1", "0"), ("0", "0"), ("7", "2")]], {"colA": "0", "colB": "1", "operation": "DIVIDE"}, [("6", "0", "Infinity"), ("x", "1", None), (None, "1", None), ("-1", "0", "-Infinity"), ("0", "0", "NaN"), ("7", "2", "3.5")]),
    ("Calculator", [[("6",)]], {"colA": "0", "valueB": "4", "operation": "MODULO"}, [("6", "2.0")]),
    ("Formula", [[("10", "9"), ("b", "a"), (None, "1")]], {"formulaString": 'IF([x]>[y];CONCATENATE([x];"\\"";[z]);low)', "fieldNames": "x,y", "fieldName": "r"}, [("10", "9", '10"'), ("b", "a", 'b"'), (None, "1", "low")]),
    ("CheckSum", [[("a", None, "bc")]], {"algorithm": "MD5"}, [("a", None, "bc", "900150983cd24fb0d6963f7d28e17f72")]),
    ("CheckSum", [[("a",)]], {"algorithm": "CRC32"}, [("a", None)]),
    ("SplitFieldToRows3", [[("a,,b", "k"), (None, "l")]], {"column": "0"}, [("a", "k"), ("", "k"), ("b", "k"), (None, "l")]),
    ("Validator", [[("ab",), ("ab\n",), (None,), ("abcd",)]], {"column": "0", "pattern": "[a-z]+", "maxLength": "3"}, [("ab", "true"), ("ab\n", "false"), (None, "false"), ("abcd", "false")]),
    ("NumberRange", [[("10",), ("x",), (None,), ("50",)]], {"column": "0", "lowerBound.0": "0", "upperBound.0": "10", "label.0": "l", "lowerBound.1": "10", "upperBound.1": "20", "label.1": "m", "defaultLabel": "?"}, [("10", "l"), ("x", "?"), (None, "?"), ("50", "?")]),
    ("DetectLastRow", [[("a",), ("b",)]], {}, [("a", "false"), ("b", "true")]),
    ("FieldsChangeSequence", [[("a",), ("a",), (None,), (None,), ("a",)]], {"columns": "0", "start": "1"}, [("a", "1"), ("a", "1"), (None, "2"), (None, "2"), ("a", "3")]),
    ("Unique", [[("a", "1"), ("a", "2"), ("b", "3"), ("a", "4")]], {"columns": "0"}, [("a", "1"), ("b", "3"), ("a", "4")]),
    ("UniqueRowsByHashSet", [[("a", "1"), ("b", "2"), ("a", "3"), (None, "4"), (None, "5")]], {"columns": "0"}, [("a", "1"), ("b", "2"), (None, "4")]),
    ("GroupBy", [[("a", "1"), ("a", "x"), ("b", "2"), ("a", None)]], {"groupColumns": "0", "aggColumns": "1,1,1,1,1", "aggFunctions": "COUNT,SUM,LAST,FIRST,ODD"}, [("a", "2", "1.0", "x", "1", "2"), ("b", "1", "2.0", "2", "2", "1"), ("a", "1", None, None, None, "1")]),
    ("MemoryGroupBy", [[("b", "1"), ("a", "2"), ("b", "4"), (None, "5"), ("null", "6")]], {"groupColumns": "0", "aggColumns": "1,1,1", "aggFunctions": "SUM,AVG,ODD"}, [("b", "5.0", "2.5", None), ("a", "2.0", "2.0", None), (None, "5.0", "5.0", None), ("null", "6.0", "6.0", None)]),
    ("MemoryGroupBy", [frame], {"groupColumns": "", "aggColumns": "0", "aggFunctions": "COUNT"}, []),
    ("Denormaliser", [[("k", "x", "1"), ("k", "y", "2"), ("k", "x", None), ("l", "z", "3")]], {"keyColumns": "0", "pivotColumn": "1", "valueColumn": "2", "pivotValues": "x,y"}, [("k", None, "2"), ("l", None, None)]),
    ("Normaliser", [[("k", "1", None)]], {"keyColumns": "0", "valueColumns": "1,2", "valueNames": "a,b"}, [("k", "a", "1"), ("k", "b", None)]),
    ("SortRows", [[("10",), ("9",), (None,), ("a",)]], {"columns": "0"}, [("10",), ("9",), ("a",), (None,)]),
    ("SortRows", [[("a", "1"), (None, "2"), ("b", "3"), ("a", "4")]], {"columns": "0", "ascending": "false"}, [(None, "2"), ("b", "3"), ("a", "1"), ("a", "4")]),
    ("SortedMerge", [[("a",), ("c",)], [("b",), (None,)]], {"columns": "0"}, [("a",), ("b",), ("c",), (None,)]),
    ("Append", [[("a",)], [("b", "2")]], {}, [("a", None), ("b", "2")]),
    ("MergeJoin", [AB, [("b", "x"), ("b", "y"), (None, "n"), ("z", "z")]], {"leftColumns": "0", "rightColumns": "0"}, [("b", None, "b", "x"), ("b", None, "b", "y"), (None, "3", None, "n")]),
    ("StreamLookup", [[("1",), ("2",), (None,)], [("1", "x"), ("1", "y"), (None, "n")]], {"keyStreamCols": "0", "keyLookupCols": "0", "valueFieldCols": "1"}, [("1", "x"), ("2", None), (None, "n")]),
    ("StreamLookup", [[("1", "x")], [("9",), ("1",)]], {"lookupInputIndex": "0", "keyStreamCols": "0", "keyLookupCols": "0", "valueFieldCols": "1"}, [("9", None), ("1", "x")]),
    ("MultiwayMergeJoin", [[("a", "1"), (None, "2")], [("a", "3"), (None, "4")], [("a", "5"), ("b", "6")]], {}, [("a", "1", "a", "3", "a", "5")]),
    ("JoinRows", [[("a",), ("b",)], [("1",), ("2",)]], {}, [("a", "1"), ("a", "2"), ("b", "1"), ("b", "2")]),
    ("MergeRows", [[("1", "a"), ("2", "b"), ("3", "c"), ("3", "d")], [("4", "n"), ("3", "d"), ("1", "z")]], {"keyColumns": "0"}, [("4", "n", "new"), ("3", "d", "identical"), ("1", "z", "changed"), ("2", "b", "deleted")]),
    ("BlockingStep", [AB], {}, AB),
    ("Dummy", [AB], {}, AB),
]


@pytest.mark.parametrize("kind,ins,params,want", CASES, ids=[f"{i}-{c[0]}" for i, c in enumerate(CASES)])
def test_step(spark, kind, ins, params, want):
    ins = [frame(spark, [], 1) if i is frame else i for i in ins]
    assert run(spark, kind, ins, params) == want


@pytest.mark.parametrize("how,n", [("INNER", 2), ("LEFT OUTER", 3), ("RIGHT OUTER", 3), ("FULL OUTER", 4), ("ODD", 4)])
def test_join_types(spark, how, n):
    got = run(spark, "MergeJoin", [[("a",), ("b",), (None,)], [("b",), (None,), ("z",)]], {"leftColumns": "0", "rightColumns": "0", "joinType": how})
    assert len(got) == n and ("b", "b") in got and (None, None) in got


def test_pairs_of_a_hot_key_are_shared_by_tasks(spark, monkeypatch):
    import millrace.operators.joins as joins

    monkeypatch.setattr(joins, "PAIRS_A_TASK", 50)
    a = [("h", f"a{i}") for i in range(3)] + [(None, "x"), ("r", "y"), ("a", "z")]
    b = [("h", f"b{i % 30}") for i in range(40)] + [(None, "n"), ("r", "m"), ("b", "z")]
    c = [("h", f"c{i}") for i in range(20)] + [(None, f"d{i}") for i in range(60)] + [("r", f"e{i}") for i in range(2)]
    want = sorted((str(x), u, str(y), v, str(z), w) for x, u in a for y, v in b for z, w in c if x == y == z)
    f = STEPS["MultiwayMergeJoin"]([frame(spark, x) for x in (a, b, c)], Params(), Context(spark)).to_df()
    sizes = [r[1] for r in f.groupBy(F.spark_partition_id()).count().collect()]
    assert sorted(tuple(str(x) if i % 2 == 0 else x for i, x in enumerate(r)) for r in f.collect()) == want
    assert len(want) == 2462 and len(sizes) > 20 and max(sizes) < 500


OPS = [("EQ", "18", ["18"]), ("NEQ", "18", ["18.0", "9", "x"]), ("GT", "10", ["18", "18.0", "x"]), ("LTE", "18", ["18", "18.0", "9"]), ("LT", None, []), ("CONTAINS", "8.", ["18.0"]), ("STARTS_WITH", "1", ["18", "18.0"]), ("ENDS_WITH", "8", ["18"]), ("odd", "x", ["x"])]


@pytest.mark.parametrize("op,value,want", OPS)
def test_filter(spark, op, value, want):
    data = [("18",), ("18.0",), ("9",), ("x",), (None,)]
    p = {"column": "0", "operator": op, "trueStep": "t", "falseStep": "f"} | ({"value": value} if value else {})
    got = run(spark, "FilterRows", [data], p)
    assert [r[0] for r in got["t"]] == want
    assert sorted(map(str, got["t"] + got["f"])) == sorted(map(str, data))
    assert run(spark, "FilterRows", [data], p | {"falseStep": "t"})["t"] == data


def test_switch(spark):
    got = run(spark, "SwitchCase", [[("a",), ("b",), ("c",), (None,)]], {"column": "0", "case.a": "x", "case.b": "x", "defaultStep": "d"})
    assert got == {"x": [("a",), ("b",)], "d": [("c",), (None,)]}
    assert run(spark, "SwitchCase", [[("a",), (None,)]], {"case.a": "x"}) == {"x": [("a",)]}


def test_abort(spark):
    with pytest.raises(Exception, match="too bad"):
        run(spark, "Abort", [[("a",)]], {"message": "too bad"})
    f = STEPS["Abort"]([frame(spark, [("a",)])], Params(), Context(spark))
    with pytest.raises(Exception):  # noqa: B017
        f.df.count()
    assert run(spark, "Abort", [[("a",)]], {"abortCondition": "EMPTY"}) == [("a",)]


def test_positions_over_many_blocks(spark, monkeypatch):
    import millrace.frame as fr

    monkeypatch.setattr(fr, "BLOCK", 4)
    data = [(str(i // 3 % 2),) for i in range(50)]
    assert [r[1] for r in run(spark, "FieldsChangeSequence", [data], {"columns": "0"})] == [str(i // 3 + 1) for i in range(50)]
    assert len(run(spark, "Unique", [data], {"columns": "0"})) == 17
    assert [r[1] for r in run(spark, "GroupBy", [data], {"groupColumns": "0", "aggColumns": "0", "aggFunctions": "COUNT"})] == ["3"] * 16 + ["2"]


def test_groups_of_sorted_rows(spark):
    data = [("b", "x", "1"), ("a", "y", "2"), (None, "x", "3"), ("b", "x", "4"), ("b", "w", "5")]
    f = STEPS["SortRows"]([frame(spark, data)], Params({"columns": "0,1", "ascending": "false,true"}), Context(spark))
    for functions in ("COUNT,SUM", "COUNT,LAST"):  # the second needs positions
        p = {"groupColumns": "1,0", "aggColumns": "2,2", "aggFunctions": functions}
        last = {"COUNT,SUM": ["3.0", "5.0", "5.0", "2.0"], "COUNT,LAST": ["3", "5", "4", "2"]}[functions]
        assert run(spark, "GroupBy", [f], p) == [("x", None, "1", last[0]), ("w", "b", "1", last[1]), ("x", "b", "2", last[2]), ("y", "a", "1", last[3])]
    g = STEPS["SelectValues"]([f], Params({"columns": "1,0,2"}), Context(spark))
    assert len(run(spark, "GroupBy", [g], {"groupColumns": "0", "aggColumns": "2", "aggFunctions": "SUM"})) == 4  # runs, not groups


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        run(spark, "MergeJoin", [AB, AB], {})
    with pytest.raises(ValueError):
        run(spark, "SortRows", [AB], {"columns": "7"})
    with pytest.raises(ValueError):
        run(spark, "Calculator", [AB], {"colA": "0", "operation": "ODD"})
    with pytest.raises(NotImplementedError):
        run(spark, "MetaInject", [AB])
    with pytest.raises(PermissionError):
        run(spark, "ExecProcess", [AB])


def test_variables_results_and_log(spark):
    said = []
    c = Context(spark, log=said.append)
    run(spark, "SetVariable", [[("x",), ("last",)]], {"column": "0", "variableName": "V"}, c)
    assert run(spark, "GetVariable", [[("a",)]], {"variableName": "V"}, c) == [("a", "last")]
    assert run(spark, "GetVariable", [[("a",)]], {"variableName": "NOPE_NOPE", "defaultValue": "d"}, c) == [("a", "d")]
    run(spark, "WriteToLog", [AB], {"logSubject": "s "}, c)
    assert said == ["INFO s [a, 1]", "INFO s [b, null]", "INFO s [null, 3]"]
    run(spark, "RowsToResult", [AB], {}, c)
    assert run(spark, "RowsFromResult", [], {}, c) == AB
    assert run(spark, "RowsFromResult", [], {}, Context(spark)) == []
    run(spark, "DetectEmptyStream", [frame(spark, [], 1)], {}, c)
    assert c.results["empty"] is True


def test_scripts(spark):
    p = {"script": "var grade; if (score >= 90) { grade = 'A'; } else if (score >= 60) grade = 'B'; else grade = 'C';", "fieldNames": "name,score", "outputFields": "grade"}
    assert run(spark, "ScriptValueMod", [[("x", "95"), ("y", "72"), ("z", "9")]], p) == [("x", "95", "A"), ("y", "72", "B"), ("z", "9", "C")]
    p = {"script": "value = value == undefined ? 'EMPTY' : value.toUpperCase();", "fieldNames": "name,value", "outputFields": "value"}
    assert run(spark, "ScriptValueMod", [[("x", "a"), ("y", None)]], p) == [("x", "A"), ("y", "EMPTY")]
    p = {"script": "var n = name + '!';", "fieldNames": "name", "outputFields": "name,n", "outputRename": "again,"}
    assert run(spark, "ScriptValueMod", [[("x",)]], p) == [("x", "x", "x!")]
    with pytest.raises(ValueError):
        run(spark, "ScriptValueMod", [AB], {"script": "try { } catch (e) { }"})


def test_script_language():
    from millrace.functions.script import compile_script

    value = lambda text, **names: compile_script(text)(names).get("r")
    assert value("var r = 0; for (var i = 1; i <= 4; i++) { if (i == 3) continue; r += i; }") == 7
    assert value("function f(a, b) { return a + b; } var r = f('1', 2) + [1,2].join('-');") == "121-2"
    assert value("var r = typeof x == 'undefined' ? 1 : 2;", x=None) == 2
    assert value("var r = ('a,b').split(',').length * parseInt('12px') % 7;") == 3
    assert value("var r = '5' - 2 + (1 / 0 > 9 ? 1 : 0);") == 4
    assert value("var r = Math.max(1, Math.round(2.5)).toFixed(2);") == "3.00"
    assert value("var r = 1 + 1 + 'x' + null;") == "2xnull"
    assert value("var i = 0; while (true) { i++; if (i > 4) break; } var r = i;") == 5


def test_java(spark):
    p = {"script": "return new String[] {fields[0] == null ? null : fields[0].trim(), fieldNames[0]};", "fieldNames": "who", "outputCount": "2"}
    assert run(spark, "UserDefinedJavaClass", [[(" a ",), (None,)]], p) == [("a", "who"), (None, "who")]
    assert run(spark, "UserDefinedJavaClass", [[("a",)]], {"script": "return null;"}) == [("a",)]
    with pytest.raises(ValueError):
        run(spark, "UserDefinedJavaClass", [[("a",)]], {"script": "this is no java"})


def test_files(spark, tmp_path):
    a, b, z = (str(tmp_path / n) for n in ("a.txt", "sub/b.txt", "a.zip"))
    (tmp_path / "a.txt").write_text("h\n1\n2\n")
    assert run(spark, "FileExists", [[(a,), (b,), (None,)]]) == [(a, "true"), (b, "false"), (None, "false")]
    assert run(spark, "GetFilesRowsCount", [[(a,), (b,)]]) == [(a, "2"), (b, None)]
    assert run(spark, "FileLocked", [[(a,), (b,)]]) == [(a, "false"), (b, "true")]
    run(spark, "ProcessFiles", [[(a, b)]])
    run(spark, "ZipFile", [[(b, z)]])
    assert os.path.exists(b) and zipfile.ZipFile(z).namelist() == ["b.txt"]
    run(spark, "ProcessFiles", [[(b, "")]], {"operation": "DELETE"})
    assert not os.path.exists(b)
    assert [r[1] for r in run(spark, "GetFileNames", [], {"directory": str(tmp_path), "glob": "*.txt"})] == ["a.txt"]
    (tmp_path / "x.properties").write_text("# c\na = 1\nb:two words\n c\\ d=\\u0041\\\n  more\n")
    assert run(spark, "PropertyInput", [], {"filePath": str(tmp_path / "x.properties")}) == [("a", "1"), ("b", "two words"), ("c d", "Amore")]
    assert run(spark, "ExecProcess", [[("echo hi; exit 3",)]], {}, Context(spark, allow_exec=True)) == [("echo hi; exit 3", "hi", "3")]
    assert len(run(spark, "SystemInfo", [])[0]) == 6
    assert run(spark, "RowGenerator", [], {"rowLimit": "2", "field.0": "x"}) == [("x",)] * 2
    assert run(spark, "Rest", [[("http://127.0.0.1:9/",)]], {"urlColumn": "0"})[0][2] == "-1"


def test_csv(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    (tmp_path / "in.csv").write_text('a,b\n1,"x, ""y"""\n\n2,\n3,p"q"r,extra\n"",z\n')
    strict = run(spark, "CsvInput", [], {"filePath": path, "strict": "true"})
    assert strict == [("1", 'x, "y"'), (None, None), ("2", None), ("3", "pqr"), (None, "z")]
    assert run(spark, "TextFileInput", [], {"filePath": path})[:2] == [("1", 'x, "y"'), ("2", None)]
    out = str(tmp_path / "o" / "out.csv")
    run(spark, "TextFileOutput", [[("1", 'x, "y"'), (None, "")]], {"filePath": out, "writeHeader": "true", "fieldNames": "q,p", "outputCols": "1,0"})
    assert open(out).read() == 'q,p\n"x, ""y""",1\n,\n'
    c = Context(spark, fetch=lambda p: b"h\n1\n")
    assert run(spark, "CsvInput", [], {"filePath": "/x/d.csv", "sftpHost": "h", "sftpPassword": "s"}, c) == [("1",)]
    with pytest.raises(ValueError):
        run(spark, "CsvInput", [], {"filePath": "/x/d.csv", "sftpHost": "h"}, c)


def test_excel(spark, tmp_path):
    path = str(tmp_path / "b.xlsx")
    run(spark, "ExcelOutput", [[("x & y", None), ("2", "z")]], {"filePath": path})
    assert run(spark, "ExcelInput", [], {"filePath": path}) == [("x & y", ""), ("2", "z")] or run(spark, "ExcelInput", [], {"filePath": path}) == [("x & y", None), ("2", "z")]
    run(spark, "TypeExitExcelWriter", [[("3", "w")]], {"filePath": path})
    run(spark, "TypeExitExcelWriter", [[("n", "m")]], {"filePath": path, "sheetName": "New"})
    assert run(spark, "ExcelInput", [], {"filePath": path, "hasHeader": "false"})[-1] == ("3", "w")
    assert run(spark, "ExcelInput", [], {"filePath": path, "sheetName": "New"}) == [("n", "m")]
    with pytest.raises(ValueError):
        run(spark, "ExcelInput", [], {"filePath": path, "sheetName": "None"})
    with pytest.raises(ValueError):
        run(spark, "TypeExitExcelWriter", [AB], {"filePath": str(tmp_path / "none.xlsx")})


def test_java_doubles():
    from millrace.sources.excel import _java_double

    want = {5: "5.0", 0: "0.0", 0.001: "0.001", 0.0001: "1.0E-4", 1e7: "1.0E7", 12345678: "1.2345678E7", 1.5: "1.5", 1e21: "1.0E21", -2.25: "-2.25"}
    assert {k: _java_double(float(k)) for k in want} == want


def test_jdbc(spark):
    db = {"dbType": "derby", "jdbcDatabase": "steps"}
    from millrace.sources.jdbc import _Connection

    with _Connection(Params(db), Context(spark)) as c:
        c.run("CREATE TABLE T (ID VARCHAR(20), NAME VARCHAR(20))")
    put = lambda data, **p: run(spark, "TableOutput", [data], db | {"tableName": "T"} | p)
    get = lambda **p: run(spark, "TableInput", [], db | ({"tableName": "T"} | p if "query" not in p else p))
    put([("1", "a"), ("2", "b")])
    put([("3", None)])
    assert sorted(get()) == [("1", "a"), ("2", "b"), ("3", None)]
    assert get(whereClause="ID = '2'") == get(query="SELECT * FROM T WHERE NAME = 'b'") == [("2", "b")]
    up = db | {"tableName": "T", "columns": "ID,NAME", "keyFields": "ID"}
    run(spark, "InsertUpdate", [[("2", "B"), ("4", "d"), ("4", "D")]], up)
    assert sorted(get()) == [("1", "a"), ("2", "B"), ("3", None), ("4", "D")]
    run(spark, "Delete", [[("1",), ("9",)]], db | {"tableName": "T", "columns": "ID", "keyFields": "ID"})
    run(spark, "ExecSQL", [[("x", "2"), ("y", "3")]], db | {"sql": "UPDATE T SET NAME = ? WHERE ID = ?", "paramFields": "0,1"})
    assert sorted(get()) == [("2", "x"), ("3", "y"), ("4", "D")]
    put([("7", "z")], truncateFirst="true")
    assert get() == [("7", "z")]


def test_rows_of_a_database_keep_their_order_and_texts(spark, monkeypatch):
    import millrace.sources.jdbc as jdbc

    monkeypatch.setattr(jdbc, "ROWS_AT_ONCE", 2)  # the rows come in four batches
    db = {"dbType": "derby", "jdbcDatabase": "texts"}
    with jdbc._Connection(Params(db), Context(spark)) as c:
        c.run("CREATE TABLE T (ID INT, NAME VARCHAR(20), D DOUBLE, TS TIMESTAMP)")
    rows = [("7", 'a"b,c', "1.5", "2020-01-02 03:04:05"), ("6", "", "1.0E10", None), ("5", None, None, None), ("4", " x ", None, None), ("3", "li\nne\r\n", None, None), ("2", '"', None, None), ("1", "é漢", None, None)]
    run(spark, "TableOutput", [rows], db | {"tableName": "t"})
    assert run(spark, "TableInput", [], db | {"query": "SELECT * FROM T ORDER BY ID DESC"}) == rows
    assert run(spark, "TableInput", [], db | {"tableName": "T", "whereClause": "ID > 9"}) == []


def test_a_table_is_as_it_was_when_the_step_was_reached(spark):
    from millrace.sources.jdbc import _Connection

    p = Params({"dbType": "derby", "jdbcDatabase": "then", "tableName": "T"})
    with _Connection(p, Context(spark)) as c:
        c.run("CREATE TABLE T (ID INT)")
        c.run("INSERT INTO T VALUES (1)")
    before = STEPS["TableInput"]([], p, Context(spark)).to_df()
    with _Connection(p, Context(spark)) as c:
        c.run("DELETE FROM T")
    assert [tuple(r) for r in before.collect()] == [("1",)]


def test_jdbc_urls():
    from millrace.sources.jdbc import driver_of, url_of

    of = lambda **p: url_of(Params(p))
    assert of(dbType="oracle", jdbcHost="h", jdbcSid="S") == "jdbc:oracle:thin:@h:1521:S"
    assert of(dbType="oracle", jdbcHost="h", jdbcServiceName="s") == "jdbc:oracle:thin:@//h:1521/s"
    assert of(dbType="MySQL", jdbcHost="h", jdbcPort="1", jdbcDatabase="d") == "jdbc:mysql://h:1/d"
    assert of(dbType="postgres", jdbcHost="h", jdbcDatabase="d") == "jdbc:postgresql://h:5432/d"
    assert of(dbType="mssql", jdbcHost="h", jdbcDatabase="d") == "jdbc:sqlserver://h:1433;databaseName=d"
    assert of(dbType="db2", jdbcHost="h", jdbcDatabase="d") == "jdbc:db2://h:50000/d"
    assert of(jdbcUrl="jdbc:x") == "jdbc:x" and driver_of(Params(jdbcDriver="D")) == "D"
    for bad in (url_of, driver_of):
        with pytest.raises(ValueError):
            bad(Params(dbType="odd"))


def test_mail(spark):
    from millrace.plans.jobs import ENTRIES, JobContext

    sent = []

    class Server:
        def __init__(self, host, port, timeout):
            sent.append((host, port))

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

        def starttls(self):
            sent.append("tls")

        def login(self, user, password):
            sent.append((user, password))

        def send_message(self, m):
            sent.append((m["To"], m["Subject"], m.get_content().strip()))

    c = JobContext(spark, mail=Server)
    assert ENTRIES["Mail"](Params({"host": "h", "from": "a@x", "to": "b@x", "subject": "s", "body": "t", "useSTARTTLS": "true", "user": "u", "password": "p"}), c)
    assert sent == [("h", 587), "tls", ("u", "p"), ("b@x", "s", "t")]
    with pytest.raises(ValueError):
        ENTRIES["Mail"](Params({"host": "h"}), c)
    assert JobContext(spark).mail is smtplib.SMTP


def test_unequal_in_all_spellings(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    for op in ("NE", "NOT_EQUAL", "NEQ", "<>", "!="):
        got = STEPS["FilterRows"]([Frame.of(df)], Params(column="0", operator=op, value="a", trueStep="t", falseStep="f"), Context(spark))
        assert [r[0] for r in got["t"].to_df().collect()] == ["b"] and {r[0] for r in got["f"].to_df().collect()} == {"a", None}


def test_initcap_drops_outer_blanks(spark):
    df = spark.createDataFrame([(" ab  cd ",), ("\tX y\n",), ("",), (None,)], "x string")
    got = STEPS["StringOperations"]([Frame.of(df)], Params(column="0", operation="initcap"), Context(spark)).to_df().collect()
    assert [r[0] for r in got] == ["Ab Cd", "X Y", "", None]


def test_filters_reach_the_scan_below_a_sort_and_a_sink(spark, tmp_path):
    spark.range(100).selectExpr("id", "CAST(id % 7 AS double) AS v").coalesce(1).write.parquet(str(tmp_path / "t"))
    f = Frame.of(spark.read.parquet(str(tmp_path / "t")))
    f = STEPS["FilterRows"]([f], Params(column="1", operator="GT", value="3", trueStep="t"), Context(spark))["t"]
    for g in (f, STEPS["SortRows"]([f], Params(columns="1,0"), Context(spark))):
        plan = g.sorted()._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [IsNotNull(v), GreaterThan(v,3.0)]" in plan
    got = STEPS["Sequence"]([f], Params(), Context(spark)).to_df(["id", "v", "n"]).collect()
    assert [r["n"] for r in sorted(got, key=lambda r: r["id"])] == list(range(1, len(got) + 1))


def test_last_rows_of_equal_places_and_of_descending_orders(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (3, "c"), (None, "d"), (None, "e")], "k int, v string")
    for f in (Frame.of(df, ["k"]), STEPS["SortRows"]([Frame.of(df)], Params(columns="0", ascending="false"), Context(spark)), Frame.of(df)):
        got = STEPS["DetectLastRow"]([f], Params(), Context(spark)).to_df(["k", "v", "last"]).collect()
        assert sorted(r["last"] for r in got) == ["false"] * 4 + ["true"]
        c = Context(spark)
        STEPS["SetVariable"]([f], Params(column="1", variableName="X"), c)
        assert c.variables["X"] in {"b"} if f.order and f.order[0].descending else {"d", "e"}
    assert STEPS["DetectLastRow"]([Frame.of(df.limit(0))], Params(), Context(spark)).to_df().count() == 0


def test_first_rows_by_several_columns_with_nulls(spark):
    df = spark.createDataFrame([("x", 2, "b", 1), ("x", None, "a", 2), ("x", 2, "a", 3), ("y", None, None, 4)], "g string, o int, p string, v int")
    f = Frame.of(df, ["o", "p"])
    got = STEPS["UniqueRowsByHashSet"]([f], Params(columns="0"), Context(spark)).to_df().collect()
    assert {(r["g"], r["v"]) for r in got} == {("x", 3), ("y", 4)}


def test_strict_reading_of_a_folder_drops_every_header(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f'h,g\n{i},x"y"z\n\n{i}{i},\n')
    got = STEPS["CsvInput"]([], Params(filePath=f"file://{tmp_path}", strict="true"), Context(spark)).to_df()
    assert got.columns == ["h", "g"] and sorted(tuple(r) for r in got.collect() if r[0]) == sorted((x, g) for i in range(3) for x, g in ((str(i), "xyz"), (str(i) * 2, None))) and got.count() == 9


def test_parts_have_headers(spark, tmp_path):
    f = Frame.of(spark.range(50).repartition(3), ["id"])
    STEPS["TextFileOutput"]([f], Params(filePath=f"file://{tmp_path}/o", partitioned="true", writeHeader="true", fieldNames="n"), Context(spark))
    got = spark.read.csv(f"file://{tmp_path}/o", header=True)
    assert got.columns == ["n"] and {r[0] for r in got.collect()} == {str(i) for i in range(50)}


def test_a_sheet_counts_its_header():
    from millrace.sources.excel import _checked

    assert _checked([1] * 9, 1, 10) == [1] * 9
    with pytest.raises(ValueError):
        _checked([1] * 10, 1, 10)


def test_downloads_land_in_the_shared_folder(spark):
    c = Context(spark, fetch=lambda p: b"name,age\nAlice,30\n")
    p = Params(filePath="/in/data.csv", sftpHost="h", sftpPassword="x")
    assert [tuple(r) for r in STEPS["CsvInput"]([], p, c).to_df().collect()] == [("Alice", "30")]
    from millrace.core.runtime import shared_dir
    from millrace.sources.files import local_path

    assert local_path("/in/data.csv", p, c).startswith(shared_dir(spark))


def test_tables_of_a_block_are_removed(spark):
    import os
    from urllib.parse import urlparse

    from millrace.core.runtime import materialise, scratch

    with scratch():
        inner = materialise(spark.range(3))
        path = urlparse(inner._millrace_path).path
        assert os.path.isdir(path) and inner.count() == 3
    outer = materialise(spark.range(2))
    assert not os.path.exists(path) and outer.count() == 2


def test_all_rows_are_logged(spark):
    lines = []
    f = Frame.of(spark.range(250), ["id"])
    STEPS["WriteToLog"]([f], Params(), Context(spark, log=lines.append))
    assert len(lines) == 250 and lines[-1] == "INFO [249]"

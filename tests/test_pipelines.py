"""Whole definitions: YAML and XML to results, jobs, streams, the service."""

import io
import zipfile

import pytest

from millrace.plans.compiler import run_transformation
from millrace.plans.convert import convert_job, convert_project, convert_transformation
from millrace.plans.jobs import JobContext, run_job
from millrace.plans.model import dump, load_job, load_transformation
from millrace.service import Service
from millrace.streaming import stream_steps


def step(name, kind, inner=""):
    return f"<step><name>{name}</name><type>{kind}</type>{inner}</step>"


def fields(*names):
    return "<fields>" + "".join(f"<field><name>{n}</name></field>" for n in names) + "</fields>"


def ktr(name, steps, hops, parameters=""):
    order = "".join(f"<hop><from>{a}</from><to>{b}</to><enabled>Y</enabled></hop>" for a, b in hops)
    return f"<transformation><info><name>{name}</name>{parameters}</info>{''.join(steps)}<order>{order}</order></transformation>"


ORDER = ("order_id", "customer_id", "product_id", "quantity", "unit_price", "status")
LOOK = "<from>read_customers</from><keystream>customer_id</keystream><keylookup>cust_id</keylookup>" + "".join(f"<valuestream><value>{v}</value><valuename>{v}</valuename></valuestream>" for v in ("first_name", "last_name"))


def sales(base):
    one = ktr(
        "filter",
        [step("read", "CSVInput", f"<filename>{base}/orders.csv</filename>" + fields(*ORDER)), step("confirmed?", "FilterRows", "<compare><condition><leftvalue>status</leftvalue><function>=</function><value><text>CONFIRMED</text></value></condition></compare>")]
        + [step(n, "TextFileOutput", f"<file><name>{base}/{n}.csv</name><header>Y</header></file>" + fields(*ORDER)) for n in ("good", "rejected")],
        [("read", "confirmed?"), ("confirmed?", "good"), ("confirmed?", "rejected")],
    )
    two = ktr(
        "enrich",
        [
            step("read", "CsvInput", f"<filename>{base}/good.csv</filename>" + fields(*ORDER)),
            step("read_customers", "CsvInput", f"<filename>{base}/customers.csv</filename>" + fields("cust_id", "first_name", "last_name")),
            step("look", "StreamLookup", LOOK),
            step("sort", "SortRows", "<fields><field><name>last_name</name><sort_direction>ascending</sort_direction></field></fields>"),
            step("write", "TextFileOutput", f"<file><name>{base}/report.csv</name><header>Y</header></file>" + fields("order_id", "last_name", "first_name")),
        ],
        [("read", "look"), ("look", "sort"), ("sort", "write")],  # the lookup's hop is left out
    )
    job = """<job><name>sales</name><entries><entry><name>START</name><type>SPECIAL</type><start>Y</start></entry>
    <entry><name>one</name><type>TRANS</type><filename>${X}/ktr/one.ktr</filename></entry><entry><name>two</name><type>TRANS</type><filename>two.ktr</filename></entry>
    <entry><name>END</name><type>SUCCESS</type></entry></entries><hops>
    <hop><from>START</from><to>one</to><enabled>Y</enabled><unconditional>Y</unconditional></hop><hop><from>one</from><to>two</to><evaluation>Y</evaluation></hop><hop><from>two</from><to>END</to></hop></hops></job>"""
    return {"one.ktr": one, "two.ktr": two, "sales.kjb": job}


def test_sales_pipeline_from_xml(spark, tmp_path):
    (tmp_path / "orders.csv").write_text(",".join(ORDER) + "\n1001,C2,P1,1,9.5,CONFIRMED\n1002,C1,P1,2,1,REJECTED\n1003,C1,P2,3,2,CONFIRMED\n1004,C9,P2,3,2,CONFIRMED\n1005,C3,P2,3,2,CONFIRMED\n")
    (tmp_path / "customers.csv").write_text("cust_id,first_name,last_name\nC1,Al,Smith\nC2,Bob,Jones\nC3,Cy,Brown\n")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for n, x in sales(tmp_path).items():
            z.writestr("project/" + n, x)
    with zipfile.ZipFile(io.BytesIO(convert_project(buffer.getvalue()))) as z:
        assert sorted(z.namelist()) == ["one.yaml", "sales.yaml", "two.yaml"]
        z.extractall(tmp_path)
    assert run_job(spark, str(tmp_path / "sales.yaml"), {"basePath": str(tmp_path)})
    assert (tmp_path / "rejected.csv").read_text().splitlines() == [",".join(ORDER), "1002,C1,P1,2,1,REJECTED"]
    assert (tmp_path / "report.csv").read_text().splitlines() == ["order_id,last_name,first_name", "1005,Brown,Cy", "1001,Jones,Bob", "1003,Smith,Al", "1004,,"]


def test_conversion_details():
    d = convert_transformation(sales("b")["two.ktr"])
    by = {s.id: s.params for s in d.steps}
    assert by["look"]["keyStreamCols"] == "1" and by["look"]["keyLookupCols"] == "0" and by["look"]["valueFieldCols"] == "1,2" and by["look"]["lookupInputIndex"] == "1"
    assert by["sort"]["columns"] == "7" and by["write"]["outputCols"] == "0,7,6"
    assert any((h.from_, h.to) == ("read_customers", "look") for h in d.hops)
    again = load_transformation(dump(d))
    assert [(s.id, s.type, s.params) for s in again.steps] == [(s.id, s.type, s.params) for s in d.steps]
    x = ktr(
        "x",
        [
            step("in", "CsvInput", fields("k", "when", "amount")),
            step("g", "GroupBy", "<group><field><name>k</name></field></group><fields><field><aggregate>total</aggregate><subject>amount</subject><type>SUM</type></field></fields>"),
            step("big", "FilterRows", "<compare><condition><leftvalue>total</leftvalue><function>&gt;=</function><value><text>5</text></value></condition></compare>"),
            step("c", "Calculator", "<calculation><field_name>d</field_name><calc_type>PRODUCT</calc_type><field_a>total</field_a><value>2</value></calculation>"),
            step("s", "SwitchCase", "<fieldname>k</fieldname><cases><case><value>a</value><target_step>o</target_step></case></cases>"),
            step("o", "Dummy (do nothing)"),
        ],
        [("in", "g"), ("g", "big"), ("big", "c"), ("c", "s"), ("s", "o")],
        "<parameters><parameter><name>P</name><default_value>1</default_value></parameter></parameters>",
    )
    d = convert_transformation(x)
    by = {s.id: s for s in d.steps}
    assert d.parameters == {"P": "1"} and by["o"].type == "Dummy"
    assert by["g"].params["groupColumns"] == "0" and by["g"].params["aggColumns"] == "2" and by["big"].params == {"column": "1", "operator": "GTE", "value": "5", "trueStep": "c"}
    assert by["c"].params["colA"] == "1" and by["c"].params["operation"] == "MULTIPLY" and by["s"].params == {"column": "0", "case.a": "o"}
    with pytest.raises(ValueError):
        convert_transformation('<!DOCTYPE x [<!ENTITY a "b">]>' + x)
    job = convert_job("<job><name>j</name><entries><entry><name>f</name><type>FILE_EXISTS</type><filename>x</filename></entry><entry><name>m</name><type>MAIL</type><destination>d</destination><server>s</server></entry><entry><name>e</name><type>SPECIAL</type></entry></entries><jobhop><from>f</from><to>m</to><evaluation>N</evaluation></jobhop><jobhop><from>f</from><to>e</to><enabled>N</enabled></jobhop></job>")
    assert [e.type for e in job.entries] == ["FileExists", "Mail", "Success"] and [(h.to, h.evaluation) for h in job.hops] == [("m", "failure")]


def test_variables_fan_out_and_chains(spark, tmp_path):
    (tmp_path / "in.csv").write_text("name,score\nBob,2\nAl,3\n")
    text = """
name: t
parameters: {OUT: "%s"}
steps:
- {id: r, type: CsvInput, params: {filePath: "${IN}/in.csv"}}
- {id: s, type: SortRows, params: {columns: "0"}}
- {id: a, type: TextFileOutput, params: {filePath: "${OUT}/a.csv", writeHeader: "true", fieldNames: "name,score"}}
- {id: b, type: TextFileOutput, params: {filePath: "${OUT}/b.csv"}}
hops:
- {from: r, to: s}
- {from: s, to: a}
- {from: s, to: b}
- {from: r, to: b, enabled: false}
"""
    run_transformation(spark, text % tmp_path, {"IN": str(tmp_path)})
    assert (tmp_path / "a.csv").read_text() == "name,score\nAl,3\nBob,2\n" and (tmp_path / "b.csv").read_text() == "Al,3\nBob,2\n"


@pytest.mark.parametrize(
    "hops",
    ["- {from: a, to: b}\n- {from: b, to: a}", "- {from: a, to: b}\n- {from: a, to: b}", "- {from: a, to: nowhere}", "- {from: b, to: b}"],
)
def test_graphs_that_are_refused(spark, hops):
    with pytest.raises(ValueError):
        run_transformation(spark, f"name: t\nsteps:\n- {{id: a, type: Dummy}}\n- {{id: b, type: Dummy}}\nhops:\n{hops}\n")


def test_steps_that_are_refused(spark):
    for kind in ("Dummy", "NoSuchStep"):
        with pytest.raises(ValueError):
            run_transformation(spark, {"name": "t", "steps": [{"id": "a", "type": kind}], "hops": []})


def job(entries, hops):
    return load_job({"name": "j", "entries": [{"id": i, "type": t, "params": p} for i, t, p in entries], "hops": [{"from": a, "to": b, "evaluation": e} for a, b, e in hops]})


def test_jobs(spark, tmp_path):
    there, missing = str(tmp_path), str(tmp_path / "no")
    mark = lambda n: ("SetVariable", {"variableName": n, "variableValue": "1"})
    c = JobContext(spark)
    gate = job([("g", "FileExists", {"filePath": missing}), ("yes", *mark("yes")), ("no", *mark("no")), ("end", *mark("end"))], [("g", "yes", "success"), ("g", "no", "failure"), ("yes", "end", None), ("no", "end", None)])
    assert run_job(spark, gate, c) is True and c.values == {"no": "1", "end": "1"}
    c = JobContext(spark)
    both = job([("s", "Start", {}), ("a", "FileExists", {"filePath": there}), ("b", "FileExists", {"filePath": missing}), ("c", *mark("c"))], [("s", "a", None), ("s", "b", None), ("a", "c", "success"), ("b", "c", "success")])
    assert run_job(spark, both, c) is True and c.values == {}  # the last entry is skipped, so nothing speaks against
    assert run_job(spark, job([("s", "Start", {}), ("x", "Abort", {}), ("ok", "Success", {})], [("s", "x", None), ("s", "ok", None)])) is False
    with pytest.raises(PermissionError):
        run_job(spark, job([("e", "ExecProcess", {"command": "true"}), ("d", *mark("d"))], [("e", "d", "failure")]))
    assert run_job(spark, job([("e", "ExecProcess", {"command": "exit 2"}), ("d", "Success", {})], [("e", "d", "failure")]), JobContext(spark, allow_exec=True)) is True
    with pytest.raises(ValueError):
        run_job(spark, job([("e", "NoSuch", {})], []))


def test_service(spark, tmp_path):
    s = Service(spark, folder=str(tmp_path / "records"))
    good = s.submit_transformation({"name": "t", "steps": [{"id": "a", "type": "RowGenerator", "params": {"field.0": "x"}}], "hops": []})
    bad = s.submit_transformation({"name": "t", "steps": [{"id": "a", "type": "Dummy"}], "hops": []})
    aborted = s.submit_job({"name": "j", "entries": [{"id": "x", "type": "Abort"}], "hops": []})
    assert s.wait(good, 60).status == "COMPLETED" and s.wait(bad, 60).status == "FAILED" and s.wait(aborted, 60).result is False
    again = Service(spark, folder=str(tmp_path / "records"))
    assert len(again.list()) == 3 and again.get(bad).error_message and again.get("none") is None


def test_projects(spark, tmp_path):
    """Upload, convert, run, list: the files of one project are found by each other's names."""
    step = '<transformation><info><name>t</name></info><step><name>g</name><type>RowGenerator</type><limit>3</limit><fields><field><name>a</name><nullif>x</nullif></field></fields></step><step><name>o</name><type>TextFileOutput</type><file><name>{}/o.csv</name></file></step><order><hop><from>g</from><to>o</to></hop></order></transformation>'
    job = '<job><name>j</name><entries><entry><name>START</name><type>SPECIAL</type><start>Y</start></entry><entry><name>t</name><type>TRANS</type><filename>/old/place/t.ktr</filename></entry></entries><hops><hop><from>START</from><to>t</to><enabled>Y</enabled><unconditional>Y</unconditional></hop></hops></job>'
    s = Service(spark)
    good = s.create_project("p", ("j.kjb", job.encode()), {"t.ktr": step.format(tmp_path).encode()})
    bad = s.create_project("q", ("j.kjb", b"<job><entries>"), {})
    with pytest.raises(ValueError):
        s.execute_project(good)
    assert s.convert_project(bad).status == "FAILED" and s.project(bad).error_message
    p = s.convert_project(good)
    assert p.status == "CONVERTED" and set(p.definitions) == {"j.yaml", "t.yaml"} and {x.name for x in s.projects()} == {"p", "q"}
    e = s.execute_project(good)
    assert s.wait(e, 120).status == "COMPLETED", s.get(e).error_message
    assert [x.id for x in s.executions(good)] == [e] and not s.executions(bad) and (tmp_path / "o.csv").exists()


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, v int").parquet(str(tmp_path / "in"))
    out = stream_steps(stream, [("FilterRows", {"column": "0", "operator": "NEQ", "value": "b"}), ("StringOperations", {"column": "k", "operation": "upper"}), ("Calculator", {"colA": "1", "valueB": "10", "operation": "MULTIPLY", "fieldName": "x"})])
    q = out.writeStream.format("memory").queryName("steps_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.sql("SELECT * FROM steps_out").collect()] == [("A", 1, 10.0)]
    with pytest.raises(ValueError):
        stream_steps(stream, [("Unique", {})])


def test_typed_and_text_frames_agree_on_rows(spark):
    from millrace.plans.reference_queries import queries

    assert len(queries()) > 60

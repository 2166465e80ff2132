from millrace.operators.nested import child_table, definition_links, definition_tables

FILES, TEXTS = "id string, content binary", "id string, content string"
XML = """<?xml version="1.0" encoding="ISO-8859-1"?>
<transformation><info><name> té </name><parameters><parameter><name>P</name><default_value/></parameter></parameters></info>
<!-- <step><name>gone</name></step> -->
<order><hop><from>a</from><to>f</to><enabled>N</enabled></hop></order>
<step><name>a</name><type>CsvInput</type><fields><field name=" x "/><field><name><![CDATA[y & z]]></name><type>Date</type></field><field/></fields></step>
<step><name>b</name><type>CsvInput</type><fieldNames>u, v,,w</fieldNames></step>
<step><name>f</name><type>FilterRows</type><compare><condition><operator>OR</operator><conditions>
<condition><leftvalue>x</leftvalue></condition>
<condition><conditions><condition/><condition><conditions><condition/></conditions></condition></conditions></condition></conditions></condition></compare></step>
</transformation>"""


def links(spark, xml=(), text=()):
    got = definition_links(spark.createDataFrame(list(xml), FILES), spark.createDataFrame(list(text), TEXTS)).collect()
    return {tuple(r)[1:] for r in got}


def test_xml(spark):
    assert links(spark, [("1", XML.encode("latin-1"))]) == {
        ("step", "té", "a"), ("step", "té", "b"), ("step", "té", "f"), ("param", "té", "P"), ("hop", "a", "f"),
        ("field", "a", "x"), ("field", "a", "y & z"), ("field", "b", "u"), ("field", "b", "v"), ("field", "b", "w"),
        ("condition", "f", "f#1"), ("condition", "f#1", "f#1.1"), ("condition", "f#1", "f#1.2"), ("condition", "f#1.2", "f#1.2.1"), ("condition", "f#1.2", "f#1.2.2"), ("condition", "f#1.2.2", "f#1.2.2.1"),
    }


def test_encodings(spark):
    xml = '<job><name>ü</name><entries><entry><name>S</name></entry></entries></job>'
    want = {("entry", "ü", "S")}
    for encoding, declared in (("utf-8", "UTF-8"), ("utf-8-sig", "utf-8"), ("utf-16", "UTF-16"), ("cp1252", "windows-1252"), ("gbk", "gbk")):
        data = f'<?xml version="1.0" encoding="{declared}"?>{xml}'.encode(encoding)
        assert links(spark, [("1", data)]) == want, encoding
    assert links(spark, [("1", f'<?xml version="1.0" encoding="UTF-8"?>{xml}'.encode("latin-1"))]) == set()


def test_yaml_and_json(spark):
    text = 'name: "j "\nparameters: {A: "", B: 1}\nentries:\n- id: 1\n  type: Start\n  params:\n- {type: Mail, id: m, params: {to: x, "from": y}}\nhops: [{from: 1, to: m, enabled: false}]\n'
    want = {("param", "j", "A"), ("param", "j", "B"), ("entry", "j", "1"), ("entry", "j", "m"), ("param", "m", "to"), ("param", "m", "from"), ("hop", "1", "m")}
    assert links(spark, text=[("1", text)]) == want
    assert links(spark, text=[("2", '{"name": "n", "steps": [{"id": "s", "type": "Dummy", "params": {"k": 1}}], "hops": []}')]) == {("step", "n", "s"), ("param", "s", "k")}


def test_damaged_null_empty_repeated(spark):
    bad = [("1", b"<transformation>"), ("2", None), ("3", b""), ("4", b"<other/>"), ("5", b"<transformation/>")]
    texts = [("6", 'name: "x'), ("7", None), ("8", ""), ("9", "- a"), ("10", "just text"), ("11", "{"), ("12", "name: e\nsteps:\nhops:\nparameters:\n")]
    assert links(spark, bad, texts) == set()
    assert definition_links(spark.createDataFrame([("1", XML.encode("latin-1"))] * 3, FILES), spark.createDataFrame([], TEXTS)).count() == 16


def test_tables_keep_positions(spark):
    t = definition_tables(spark.createDataFrame([("1", XML.encode("latin-1"))], FILES), spark.createDataFrame([], TEXTS))
    assert [(r["child_key"], r["position"]) for r in t["parts"].orderBy("position").collect()] == [("a", 1), ("b", 2), ("f", 3)]
    assert {(r["child_key"], r["type"]) for r in t["fields"].where("parent_key = 'a'").collect()} == {("x", ""), ("y & z", "Date")}


def test_deep_and_long(spark):
    deep = "<condition>" + "<conditions><condition>" * 60 + "</condition></conditions>" * 60 + "</condition>"
    got = links(spark, [("1", f"<transformation><name>n</name><step><name>s</name><compare>{deep}</compare></step></transformation>".encode())])
    assert ("condition", "s#1" + ".1" * 59, "s#1" + ".1" * 60) in got and len(got) == 62
    wide = "".join(f"<field name='f{i}'/>" for i in range(30_000))
    assert len(links(spark, [("1", f"<transformation><name>n</name><step><name>s</name><fields>{wide}</fields></step></transformation>".encode())])) == 30_001


def test_child_table(spark):
    df = spark.createDataFrame(
        [(1, [{"a": "x", "more": [{"b": 1}, {"b": None}]}, {"a": None, "more": []}]), (2, None), (3, []), (4, [{"a": "y", "more": None}, None])],
        "id int, items array<struct<a string, more array<struct<b int>>>>",
    )
    assert {tuple(r) for r in child_table(df, ["id"], "items").collect()} == {(1, 1, "x"), (1, 2, None), (4, 1, "y"), (4, 2, None)}
    assert {tuple(r) for r in child_table(df, ["id"], "items.more").collect()} == {(1, 1, 1, 1), (1, 1, 2, None)}
    clash = spark.createDataFrame([(1, [{"id": 5, "pos_items": 6}])], "id int, items array<struct<id int, pos_items int>>")
    assert child_table(clash, ["id"], "items").columns == ["id", "pos_items", "item_id", "item_pos_items"]
    scalars = spark.createDataFrame([(1, ["a", None])], "id int, tags array<string>")
    assert {tuple(r) for r in child_table(scalars, ["id"], "tags").collect()} == {(1, 1, "a"), (1, 2, None)}


def test_conditions_of_some_thousand_levels(spark):
    n = 3000
    deep = "<condition>" + "<conditions><condition>" * n + "</condition></conditions>" * n + "</condition>"
    xml = f"<transformation><name>n</name><step><name>s</name><compare>{deep}</compare></step></transformation>"
    good = "<transformation><name>m</name><step><name>t</name></step></transformation>"
    got = definition_tables(spark.createDataFrame([("1", xml.encode()), ("2", good.encode())], FILES), spark.createDataFrame([], TEXTS))
    assert got["conditions"].count() == n + 1 and got["parts"].count() == 2

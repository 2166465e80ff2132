"""Scripts, Java snippets and sub-flows."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.core.runtime import map_arrow
from millrace.frame import Frame
from millrace.functions.script import UNDEFINED, compile_script, to_text
from millrace.registry import Context, Params, step


def _identifier(name: str) -> str:
    name = re.sub(r"[^A-Za-z0-9_$]", "_", name.strip())
    return "_" + name if not name or name[0].isdigit() else name


@step("ScriptValueMod")
def script_value_mod(ins: list[Frame], p: Params, c: Context) -> Frame:
    """Runs a script for each row. Fields are bound as texts, null as undefined; outputFields are read back: a field of
    that name is replaced, and with an outputRename (or where there is no such field) one is appended."""
    f = ins[0]
    text = p.required("script")
    compile_script(text)  # refused here rather than on a worker
    names = [x.strip() for x in p.text("fieldNames", "").split(",")] if p.text("fieldNames") else list(f.names)
    names = [*names, *(f"f{i}" for i in range(len(names), f.width))][: f.width]
    outputs = p.items_of("outputFields")
    renames = [x.strip() for x in p.text("outputRename", "").split(",")]
    plan, added = [], []
    low = [n.lower() for n in names]
    for k, o in enumerate(outputs):
        new = renames[k] if k < len(renames) and renames[k] else ""
        at = low.index(o.lower()) if o.lower() in low else -1
        append = at < 0 or (new and new.lower() != o.lower())
        plan.append((_identifier(o), at, bool(append)))
        if append:
            added.append(new or o)
    order, width, n = f.keep(), f.width, len(added)
    source = f.df.select(*[F.col(f"c{i}").cast("string").alias(f"c{i}") for i in range(width)], *order)
    bound = [_identifier(x) for x in names]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        script = compile_script(text)
        back = lambda v: None if v is UNDEFINED or v is None else to_text(v)
        for b in batches:
            columns = [b.column(f"c{i}").to_pylist() for i in range(width)]
            more: list[list] = [[] for _ in range(n)]
            for r in range(b.num_rows):
                left = script({x: UNDEFINED if columns[i][r] is None else columns[i][r] for i, x in enumerate(bound)})
                k = 0
                for name, at, append in plan:
                    value = back(left.get(name, UNDEFINED))
                    if at >= 0:
                        columns[at][r] = value
                    if append:
                        more[k].append(value)
                        k += 1
            new = [pa.array(x, pa.string()) for x in [*columns, *more]]
            yield pa.RecordBatch.from_arrays([*new, *(b.column(o) for o in order)], [*(f"c{i}" for i in range(width + n)), *order])

    kinds = dict(source.dtypes)
    schema = ", ".join([f"c{i} string" for i in range(width + n)] + [f"`{o}` {kinds[o]}" for o in order])
    return Frame(map_arrow(source, run, schema), (*f.names, *added), f.order, True)


_JAVA = """
public class %s implements org.apache.spark.sql.api.java.UDF1<Object, Object>, java.io.Serializable {
  private static final String[] NAMES = new String[] {%s};
  private String[] process(String[] fields, String[] fieldNames) { %s }
  public Object call(Object row) {
    scala.collection.Seq values = (scala.collection.Seq) row;
    String[] fields = new String[values.length()];
    for (int i = 0; i < fields.length; i++) { fields[i] = values.apply(i) == null ? null : values.apply(i).toString(); }
    String[] out = process((String[]) fields.clone(), NAMES);
    return out == null ? fields : out;
  }
}
"""


@step("UserDefinedJavaClass")
def user_defined_java(ins: list[Frame], p: Params, c: Context) -> Frame:
    """A Java method body over (String[] fields, String[] fieldNames) that returns the new fields (null: as they were).
    It is compiled once, given to the executors as a jar, and runs there without leaving the JVM.

    `outputCount` says how many fields it returns if not as many as come in."""
    f = ins[0]
    names = p.items_of("fieldNames") or list(f.names)
    jvm, name = c.spark.sparkContext._jvm, "Mr" + uuid.uuid4().hex
    quoted = ", ".join('"' + n.replace("\\", "\\\\").replace('"', '\\"') + '"' for n in names)
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
    try:
        compiler.cook(_JAVA % (name, quoted, p.required("script")))
    except Exception as e:
        raise ValueError(f"the Java code doesn't compile: {e}") from None
    jar = os.path.join(tempfile.mkdtemp(prefix="millrace-java-"), f"{name}.jar")
    codes = compiler.getBytecodes()
    with zipfile.ZipFile(jar, "w") as z:
        for k in list(codes.keySet()):
            z.writestr(k.replace(".", "/") + ".class", bytes(codes.get(k)))
    c.spark.sql(f"ADD JAR '{jar}'")
    made = c.spark._jsparkSession.sharedState().jarClassLoader().loadClass(name).getDeclaredConstructor(c.spark.sparkContext._gateway.new_array(jvm.java.lang.Class, 0)).newInstance(c.spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 0))
    kind = c.spark._jsparkSession.parseDataType(T.ArrayType(T.StringType()).json())
    c.spark._jsparkSession.udf().register(name, made, kind)
    n = p.integer("outputCount", f.width)
    got = F.call_function(name, F.array(*[x.cast("string") for x in f.fields()]))
    g = Frame(f.df.withColumn("__j", got), f.names, f.order, True)
    return g.put([F.get(F.col("__j"), F.lit(i)) for i in range(n)], [f.names[i] if i < f.width else f"f{i}" for i in range(n)])


@step("MetaInject")
def meta_inject(ins: list[Frame], p: Params, c: Context) -> Frame:
    raise NotImplementedError("MetaInject isn't available")


@step("Mapping", "SimpleMapping")
def mapping(ins: list[Frame], p: Params, c: Context) -> Frame:
    """Another transformation in this one's place; its plan becomes part of this plan."""
    from millrace.plans.compiler import build
    from millrace.plans.model import load_transformation

    sub = Context(c.spark, dict(c.variables), c.base_path, c.allow_exec, {}, ins[0] if ins else None, c.fetch, c.log)
    build(load_transformation(p.required("transformationPath")), sub)
    if "mapping" not in sub.results:
        raise ValueError("the sub-flow has no MappingOutput")
    return sub.results["mapping"]

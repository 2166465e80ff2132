"""Row steps on streams: every step that looks at one row at a time works on a streaming DataFrame unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import millrace.plans.compiler  # noqa: F401  registers the steps
from millrace.frame import Frame
from millrace.registry import STEPS, Context, Params

#: steps whose result for a row depends on this row alone
ROW_STEPS = frozenset(
    "SelectValues Constant SetValueConstant SetValueField ConcatFields CloneRow Dummy GetVariable StringOperations ReplaceString StringCut RegexEval ValueMapper IfNull NullIf Calculator Formula CheckSum SplitFieldToRows3 Validator NumberRange ScriptValueMod Abort FileExists FileLocked GetFilesRowsCount Rest".split()
)


def stream_steps(stream: DataFrame, steps: list[tuple[str, dict]], text: bool = False, context: Context | None = None) -> DataFrame:
    """`stream` after the steps [(type, params), ...]; names are kept. FilterRows keeps the rows that pass."""
    fields = [F.col(f"`{c}`").cast("string") if text else F.col(f"`{c}`") for c in stream.columns]
    f = Frame(stream.select(*[x.alias(f"c{i}") for i, x in enumerate(fields)]), tuple(stream.columns), (), text)
    c = context or Context(stream.sparkSession)
    for kind, params in steps:
        if kind == "FilterRows":
            f = STEPS[kind]([f], Params(dict(params) | {"trueStep": "yes", "falseStep": ""}), c)["yes"]
        elif kind in ROW_STEPS:
            f = STEPS[kind]([f], Params(params), c)
        else:
            raise ValueError(f"{kind} looks at more than one row")
    return f.to_df()

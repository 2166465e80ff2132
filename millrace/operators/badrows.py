"""Separate unreadable delimited lines from readable ones, with the reason of the failure.

From a schema one anchored pattern for whole rows is generated; lines that match it are typed from its groups. The
others pass through patterns of growing prefixes (quoting, column count, then field after field), and the first that
fails names the reason. Everything is a built-in expression; all repetitions are possessive, so that neither long lines
nor odd quoting make the matcher recurse or backtrack.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: blanks that are ignored around an unenclosed value
BLANK = r"[ \t]"
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_PLAIN = r'[^",]*+'
_ANY = f"(?:{_QUOTED}|{_PLAIN})"


def number_up_to(limit: int, least: int = 0) -> str:
    """A pattern of ASCII digits with any number of leading zeros and a value from `least` (0 or 1) to `limit`."""
    digits = str(limit)
    parts = [f"[0-9]{{1,{len(digits) - 1}}}"] if len(digits) > 1 else []
    for i, x in enumerate(digits):
        if int(x) > 0:
            low = "0" if i or len(digits) == 1 else "1"
            if int(x) - 1 >= int(low):
                parts.append(digits[:i] + f"[{low}-{int(x) - 1}]" + "[0-9]" * (len(digits) - i - 1))
    parts.append(digits)
    nonzero = "(?=[0-9]*[1-9])" if least else ""
    return nonzero + "0*(?:" + "|".join(f"(?:{p})(?![0-9])" for p in reversed(parts)) + ")"


def signed_up_to(bits: int) -> str:
    top = 2 ** (bits - 1)
    return f"(?:-{number_up_to(top)}|{number_up_to(top - 1)})"


DECIMAL = r"-?[0-9]++(?:\.[0-9]++)?"


@dataclass(frozen=True)
class Field:
    """One column of the lines: its Spark type, and the pattern of its value (None: anything)."""

    name: str
    type: str = "string"
    pattern: str | None = None
    optional: bool = True

    def regex(self) -> str:
        if self.pattern is None:
            return _ANY
        value = f"(?:{self.pattern})" + "?" * self.optional
        return f'(?:"{value}"|{BLANK}*+{value}{BLANK}*+)(?=,|\\z)'


def row_pattern(fields: list[Field], upto: int | None = None) -> str:
    """The anchored pattern of a whole row, or of the prefix that ends with field number `upto`."""
    checked = [f.regex() if upto is None or i <= upto else _ANY for i, f in enumerate(fields)]
    return r"\A" + ",".join(checked) + r"\z"


def quoting_pattern() -> str:
    return rf"\A{_ANY}(?:,{_ANY})*+\z"


def count_pattern(n: int) -> str:
    return rf"\A{_ANY}(?:,{_ANY}){{{n - 1}}}\z"


def line_body(line: Column) -> Column:
    """The line without one carriage return at its end; null is the empty line."""
    line = F.coalesce(line, F.lit(""))
    return F.when(line.endswith("\r"), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)


def failure_reason(line: Column, fields: list[Field]) -> Column:
    """Null for a good line, else `broken_quoting`, `column_count` or `bad_<field>`, the first that applies.

    A null line counts as an empty one.
    """
    line = line_body(line)
    why = F.when(line.rlike(row_pattern(fields)), None).when(~line.rlike(quoting_pattern()), "broken_quoting").when(~line.rlike(count_pattern(len(fields))), "column_count")
    for i, f in enumerate(fields):
        if f.pattern is not None:
            why = why.when(~line.rlike(row_pattern(fields, i)), f"bad_{f.name}")
    return why


def split_lines(df: DataFrame, line: str, fields: list[Field]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): good lines with one typed column for each field, bad lines with the column `reason`.

    All other columns are kept; one that clashes with a field's name is kept under the name `_<name>` in `good`, and
    one named `reason` under `_reason` in `bad`. An empty value is null. Repeated lines are kept.
    """
    why = "__why"
    tagged = df.withColumn(why, failure_reason(F.col(line), fields))
    bad = tagged.where(F.col(why).isNotNull())
    bad = bad.select(*[F.col(c).alias(_free(c, {"reason"}, df.columns)) for c in df.columns], F.col(why).alias("reason"))
    names = {f.name for f in fields}
    groups = r"\A" + ",".join(f"({_ANY})" for _ in fields) + r"\z"
    good = tagged.where(F.col(why).isNull())
    kept = [F.col(c).alias(_free(c, names, df.columns)) for c in df.columns]
    good = good.select(*kept, F.array(*[F.regexp_extract(line_body(F.col(line)), groups, i + 1) for i in range(len(fields))]).alias("__raw"))
    unquoted = F.transform("__raw", _unquote)
    good = good.withColumn("__raw", unquoted)
    out = [c for c in good.columns if c != "__raw"]
    return good.select(*out, *[F.expr(f"try_cast(nullif(__raw[{i}], '') AS {f.type})").alias(f.name) for i, f in enumerate(fields)]), bad


def _unquote(v: Column) -> Column:
    inner = F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))
    return F.when(v.startswith('"'), inner).otherwise(F.regexp_replace(v, rf"\A{BLANK}++|{BLANK}++\z", ""))


def _free(name: str, taken: set[str], others: list[str]) -> str:
    low = {x.lower() for x in taken}
    if name.lower() not in low:
        return name
    new = "_" + name
    while new.lower() in low or new.lower() in {x.lower() for x in others}:
        new = "_" + new
    return new

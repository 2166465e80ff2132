"""Column expressions with the semantics of string rows: all stay within code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: white space that a Java trim takes away (fixed value)
_LOW = r"[\x00-\x20]"
#: white space that a Java strip takes away: all but the non-breaking spaces (fixed value)
_SPACE = r"[\t-\r\x1c-\x20\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{2028}\x{2029}\x{205f}\x{3000}]"


def number(c: Column) -> Column:
    """The field as a double; null where it doesn't parse."""
    return F.trim(c.cast("string")).try_cast("double")


def shown(c: Column, text: bool) -> Column:
    return c.cast("string") if text else c


def literal(pattern: str) -> str:
    """A pattern that matches this text only."""
    return "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def java_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{_LOW}+|{_LOW}+\z", "")


def string_operation(c: Column, operation: str) -> Column:
    """trim, ltrim, rtrim, upper, lower, initcap; anything else trims. Null stays null."""
    match operation:
        case "ltrim":
            return F.regexp_replace(c, rf"\A{_SPACE}+", "")
        case "rtrim":
            return F.regexp_replace(c, rf"{_SPACE}+\z", "")
        case "upper":
            return F.upper(c)
        case "lower":
            return F.lower(c)
        case "initcap":
            return F.initcap(F.regexp_replace(F.regexp_replace(c, r"\A\s+|\s+\z", ""), r"\s+", " "))
    return java_trim(c)


def compare(c: Column, operator: str, value: str | None, numeric: Column | None = None) -> Column:
    """A filter's condition, null or false where it doesn't pass; a null field never passes, an unknown operator is
    equality. `numeric` is the field as a number if its column is numeric: such comparisons reach the scan."""
    op = operator.upper()
    s = c.cast("string")
    v = F.lit(value)
    if op in ("NEQ", "NE", "NOT_EQUAL", "<>", "!="):
        got = s != v if value is not None else c.isNotNull()
    elif op in ("CONTAINS", "STARTS_WITH", "ENDS_WITH"):
        got = {"CONTAINS": s.contains, "STARTS_WITH": s.startswith, "ENDS_WITH": s.endswith}[op](F.lit(value or ""))
    elif op in ("GT", "LT", "GTE", "LTE", "GE", "LE", "GREATER_EQUAL", "LESS_EQUAL"):
        of = {"GT": Column.__gt__, "LT": Column.__lt__, "GTE": Column.__ge__, "GE": Column.__ge__, "GREATER_EQUAL": Column.__ge__}.get(op, Column.__le__)
        if numeric is not None and re.fullmatch(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*", value or "0"):
            return of(numeric, F.lit(float(value or "0")))
        a, b = number(c), F.trim(F.lit("0" if value is None else value)).try_cast("double")
        got = F.when(a.isNotNull() & b.isNotNull(), of(a, b)).otherwise(of(s, F.lit(value or "")))
    else:
        got = s == v
    return c.isNotNull() & got


def calculate(a: Column, b: Column, operation: str) -> Column:
    """IEEE arithmetic on doubles: division by zero gives an infinity or NaN, as does its remainder; null gives null."""
    inf = F.lit(float("inf"))
    match operation.upper():
        case "ADD":
            return a + b
        case "SUBTRACT":
            return a - b
        case "MULTIPLY":
            return a * b
        case "DIVIDE":
            zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, inf).otherwise(-inf)
            return F.when(b == 0, F.when(a.isNotNull(), zero)).otherwise(a / F.when(b != 0, b))
        case "MODULO":
            return F.when(b == 0, F.when(a.isNotNull(), F.lit(float("nan")))).otherwise(a % F.when(b != 0, b))
    raise ValueError(f"unknown operation {operation}")


def substring(c: Column, start: int, end: int) -> Column:
    """Characters from start to before end (-1: to the last), both clamped to the text."""
    start = max(start, 0)
    stop = F.length(c) if end < 0 else F.least(F.lit(end), F.length(c))
    return F.substring(c, F.lit(start + 1), F.greatest(stop - start, F.lit(0)))


def checksum(columns: list[Column], algorithm: str) -> Column:
    """Lower-case hex of the values' UTF-8, nulls left out, nothing in between. CRC32 gives null, as it is no digest."""
    joined = F.concat_ws("", *[c.cast("string") for c in columns]) if columns else F.lit("")
    match re.sub("[^A-Z0-9]", "", algorithm.upper()):
        case "MD5":
            return F.md5(joined)
        case "SHA1" | "SHA":
            return F.sha1(joined)
        case "SHA256" | "SHA384" | "SHA512" | "SHA224" as s:
            return F.sha2(joined, int(s[3:]))
    return F.lit(None).cast("string")


def aggregate(c: Column, n: Column, function: str, position: Column, unknown: Column) -> Column:
    """COUNT counts rows; SUM, MIN, MAX and AVG take n, the field as a number; FIRST and LAST go by position."""
    match function.upper():
        case "COUNT":
            return F.count(F.lit(1))
        case "SUM":
            return F.sum(n)
        case "MIN":
            return F.min(n)
        case "MAX":
            return F.max(n)
        case "AVG":
            return F.avg(n)
        case "FIRST":
            return F.min_by(F.struct(c.alias("v")), position)["v"]
        case "LAST":
            return F.max_by(F.struct(c.alias("v")), position)["v"]
    return unknown

"""The formula language, compiled to column expressions.

    value     := IF(condition; value; value) | CONCATENATE(value; ...) | [field] | "text" | (value) | number or word
    condition := value (> | < | >= | <= | = | <>) value

Comparisons are numeric where both sides parse as numbers, else of texts; with a null side they are false. CONCATENATE
leaves nulls out. An unknown field is null. What follows a complete value is ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.scalar import number

_TOKEN = re.compile(r"""\s*(?:(?P<field>\[[^\]]*\])|(?P<text>"(?:\\.|[^"\\])*")|(?P<op><=|>=|<>|[<>=])|(?P<mark>[();])|(?P<word>[^;()\[\]"<>=]+))""", re.S)


class _Parser:
    def __init__(self, text: str, field):
        self.tokens = [(m.lastgroup, m[m.lastgroup].strip()) for m in _TOKEN.finditer(text)]
        self.at, self.field = 0, field

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ("end", "")

    def expect(self, mark: str) -> None:
        if self.next() != ("mark", mark):
            raise ValueError(f"expected {mark!r} in the formula")

    def value(self) -> Column:
        kind, x = self.next()
        if kind == "field":
            return self.field(x[1:-1].strip())
        if kind == "text":
            return F.lit(re.sub(r"\\(.)", r"\1", x[1:-1], flags=re.S))
        if (kind, x) == ("mark", "("):
            inner = self.value()
            self.expect(")")
            return inner
        if kind == "word":
            if self.peek() == ("mark", "(") and x.upper() in ("IF", "CONCATENATE"):
                self.next()
                return self.choice() if x.upper() == "IF" else self.joined()
            return F.lit(x)
        raise ValueError("the formula ends where a value should be")

    def choice(self) -> Column:
        condition = self.condition()
        self.expect(";")
        yes = self.value()
        self.expect(";")
        no = self.value()
        self.expect(")")
        return F.when(condition, yes.cast("string")).otherwise(no.cast("string"))

    def joined(self) -> Column:
        parts = [self.value()]
        while self.peek() == ("mark", ";"):
            self.next()
            parts.append(self.value())
        self.expect(")")
        return F.concat_ws("", *[p.cast("string") for p in parts])

    def condition(self) -> Column:
        a = self.value()
        kind, op = self.next()
        if kind != "op":
            raise ValueError("expected a comparison in the formula")
        b = self.value()
        of = {">": Column.__gt__, "<": Column.__lt__, ">=": Column.__ge__, "<=": Column.__le__, "=": Column.__eq__, "<>": Column.__ne__}[op]
        x, y = number(a), number(b)
        got = F.when(x.isNotNull() & y.isNotNull(), of(x, y)).otherwise(of(a.cast("string"), b.cast("string")))
        return F.coalesce(got, F.lit(False))


def compile_formula(text: str, names: tuple[str, ...] | list[str], columns: list[Column]) -> Column:
    at = {n: c for n, c in reversed(list(zip(names, columns, strict=False)))}
    return _Parser(text, lambda n: at.get(n, F.lit(None).cast("string"))).value().cast("string")

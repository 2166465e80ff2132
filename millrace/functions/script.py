"""A subset of ES5 JavaScript, compiled to Python closures.

var, assignments, if, for, while, functions, return, the usual operators, arrays, string and Math members. What lies
outside of it is refused when the script is compiled, with the place.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<num>0[xX][0-9a-fA-F]+|\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')
    |(?P<name>[A-Za-z_$][\w$]*)|(?P<op>===|!==|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|[-+*/%<>=!?:;,.(){}\[\]])""",
    re.S | re.X,
)
_LEVELS = [["||"], ["&&"], ["==", "!=", "===", "!=="], ["<", ">", "<=", ">="], ["+", "-"], ["*", "/", "%"]]


class Undefined:
    def __repr__(self):
        return "undefined"

    def __reduce__(self):
        return "UNDEFINED"  # the one there is, in every process


UNDEFINED = Undefined()


class _Return(Exception):
    pass


class _Break(Exception):
    pass


class _Continue(Exception):
    pass


def to_text(v) -> str:
    if v is UNDEFINED:
        return "undefined"
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int | float):
        if v != v:
            return "NaN"
        if v in (math.inf, -math.inf):
            return "Infinity" if v > 0 else "-Infinity"
        return str(int(v)) if v == int(v) and abs(v) < 1e21 else repr(float(v))
    if isinstance(v, list):
        return ",".join("" if x is None or x is UNDEFINED else to_text(x) for x in v)
    return str(v)


def to_number(v) -> float:
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, int | float):
        return float(v)
    if v is None:
        return 0.0
    if v is UNDEFINED:
        return math.nan
    s = to_text(v).strip()
    if not s:
        return 0.0
    try:
        return float(int(s, 16)) if s[:2].lower() == "0x" else float(s) if re.fullmatch(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?Infinity", s) else math.nan
    except ValueError:
        return math.nan


def truth(v) -> bool:
    return not (v is None or v is UNDEFINED or v is False or v == "" or (isinstance(v, int | float) and (v == 0 or v != v)))


def _strict(a, b) -> bool:
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
    if number(a) and number(b):
        return float(a) == float(b)
    return a is b if a is UNDEFINED or b is UNDEFINED or a is None or b is None else type(a) is type(b) and a == b


def _loose(a, b) -> bool:
    none = (None, UNDEFINED)
    if any(a is n for n in none) or any(b is n for n in none):
        return any(a is n for n in none) and any(b is n for n in none)
    if isinstance(a, str) and isinstance(b, str) or type(a) is type(b):
        return _strict(a, b)
    return to_number(a) == to_number(b)


def _less(a, b) -> bool:
    return a < b if isinstance(a, str) and isinstance(b, str) else to_number(a) < to_number(b)


def _not_above(a, b) -> bool:
    return a <= b if isinstance(a, str) and isinstance(b, str) else to_number(a) <= to_number(b)


def _divided(a, b) -> float:
    x, y = to_number(a), to_number(b)
    return x / y if y else math.nan if x == 0 or x != x else math.copysign(math.inf, x) * math.copysign(1, y)


def _plus(a, b):
    return to_text(a) + to_text(b) if isinstance(a, str | list) or isinstance(b, str | list) else to_number(a) + to_number(b)


_BINARY: dict[str, Callable] = {
    "+": _plus,
    "-": lambda a, b: to_number(a) - to_number(b),
    "*": lambda a, b: to_number(a) * to_number(b),
    "/": _divided,
    "%": lambda a, b: math.fmod(to_number(a), to_number(b)) if to_number(b) and math.isfinite(to_number(a)) else math.nan,
    "<": _less,
    ">": lambda a, b: _less(b, a),
    "<=": _not_above,
    ">=": lambda a, b: _not_above(b, a),
    "==": _loose,
    "!=": lambda a, b: not _loose(a, b),
    "===": _strict,
    "!==": lambda a, b: not _strict(a, b),
}


def _whole(v, default: int = 0) -> int:
    n = to_number(v)
    return default if n != n else int(max(min(n, 1e15), -1e15))


def _substring(s: str, a=0, b=UNDEFINED) -> str:
    x = min(max(_whole(a), 0), len(s))
    y = len(s) if b is UNDEFINED else min(max(_whole(b), 0), len(s))
    return s[min(x, y) : max(x, y)]


def _slice(s, a=0, b=UNDEFINED):
    return s[_whole(a) : None if b is UNDEFINED else _whole(b)]


def _substr(s: str, a=0, n=UNDEFINED) -> str:
    x = _whole(a)
    x = max(len(s) + x, 0) if x < 0 else x
    return s[x:] if n is UNDEFINED else s[x : x + max(_whole(n), 0)]


def _at(s: str, i=0) -> str:
    k = _whole(i)
    return s[k] if 0 <= k < len(s) else ""


_STRING: dict[str, Callable] = {
    "toUpperCase": lambda s: s.upper(),
    "toLowerCase": lambda s: s.lower(),
    "trim": lambda s: s.strip(),
    "charAt": _at,
    "charCodeAt": lambda s, i=0: float(ord(_at(s, i))) if _at(s, i) else math.nan,
    "indexOf": lambda s, x, i=0: float(s.find(to_text(x), max(_whole(i), 0))),
    "lastIndexOf": lambda s, x: float(s.rfind(to_text(x))),
    "substring": _substring,
    "substr": _substr,
    "slice": _slice,
    "split": lambda s, x=UNDEFINED: [s] if x is UNDEFINED else list(s) if x == "" else s.split(to_text(x)),
    "concat": lambda s, *x: s + "".join(map(to_text, x)),
    "replace": lambda s, a, b: s.replace(to_text(a), to_text(b), 1),
    "toString": lambda s: s,
    "startsWith": lambda s, x: s.startswith(to_text(x)),
    "endsWith": lambda s, x: s.endswith(to_text(x)),
    "includes": lambda s, x: to_text(x) in s,
}
_ARRAY: dict[str, Callable] = {
    "join": lambda a, x=",": to_text(x).join("" if v is None or v is UNDEFINED else to_text(v) for v in a),
    "push": lambda a, *x: (a.extend(x), float(len(a)))[1],
    "pop": lambda a: a.pop() if a else UNDEFINED,
    "reverse": lambda a: (a.reverse(), a)[1],
    "slice": _slice,
    "concat": lambda a, *x: a + [v for y in x for v in (y if isinstance(y, list) else [y])],
    "indexOf": lambda a, x: float(next((i for i, v in enumerate(a) if _strict(v, x)), -1)),
    "toString": to_text,
}


def _fixed(v, n=0) -> str:
    from decimal import ROUND_HALF_UP, Decimal

    x = to_number(v)
    return str(Decimal(x).quantize(Decimal(1).scaleb(-_whole(n)), ROUND_HALF_UP)) if math.isfinite(x) else to_text(x)


def _parse_int(v, base=10.0) -> float:
    b = _whole(base, 10) or 10
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:b]
    m = re.match(rf"\s*([+-]?)([{digits}]+)", to_text(v), re.I)
    return float(int(m[1] + m[2], b)) if m else math.nan


def _parse_float(v) -> float:
    m = re.match(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", to_text(v))
    return float(m[0]) if m else math.nan


_MATH = {"floor": lambda x: float(math.floor(to_number(x))), "ceil": lambda x: float(math.ceil(to_number(x))), "round": lambda x: float(math.floor(to_number(x) + 0.5)), "abs": lambda x: abs(to_number(x)), "max": lambda *x: max(map(to_number, x), default=-math.inf), "min": lambda *x: min(map(to_number, x), default=math.inf), "pow": lambda a, b: to_number(a) ** to_number(b), "sqrt": lambda x: math.sqrt(to_number(x)) if to_number(x) >= 0 else math.nan, "PI": math.pi}
_GLOBALS = {"parseInt": _parse_int, "parseFloat": _parse_float, "String": lambda v="": to_text(v), "Number": lambda v=0.0: to_number(v), "Boolean": lambda v=False: truth(v), "isNaN": lambda v=UNDEFINED: to_number(v) != to_number(v), "Math": _MATH, "undefined": UNDEFINED, "NaN": math.nan, "Infinity": math.inf, "null": None, "true": True, "false": False}


def _member(v, name):
    if isinstance(v, dict):
        return v.get(name, UNDEFINED)
    if name == "length" and isinstance(v, str | list):
        return float(len(v))
    table = _STRING if isinstance(v, str) else _ARRAY if isinstance(v, list) else {"toFixed": _fixed, "toString": to_text} if isinstance(v, int | float) else None
    if table is None:
        raise TypeError(f"can't read {name} of {to_text(v)}")
    f = table.get(name)
    return UNDEFINED if f is None else lambda *a: f(v, *a)


def _item(v, i):
    if isinstance(v, str | list) and isinstance(i, int | float):
        k = int(i)
        return v[k] if 0 <= k < len(v) else UNDEFINED
    return _member(v, to_text(i))


class Scope(dict):
    def __init__(self, outer: Scope | None = None, **own):
        super().__init__(own)
        self.outer = outer

    def home(self, name: str) -> Scope | None:
        s: Scope | None = self
        while s is not None and name not in s:
            s = s.outer
        return s


class _Compiler:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"script: can't read {text[at : at + 20]!r} at {at}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0], at))
            at = m.end()
        self.i = 0

    def peek(self, *values: str) -> bool:
        return self.i < len(self.tokens) and self.tokens[self.i][0] in ("op", "name") and self.tokens[self.i][1] in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            self.fail(f"expected {value!r}")

    def fail(self, why: str):
        where = self.tokens[self.i] if self.i < len(self.tokens) else ("", "the end", -1)
        raise ValueError(f"script: {why} at {where[1]!r} ({where[2]})")

    def name(self) -> str:
        if self.i < len(self.tokens) and self.tokens[self.i][0] == "name":
            self.i += 1
            return self.tokens[self.i - 1][1]
        self.fail("expected a name")

    def program(self) -> Callable:
        return self.block_until(None)

    def block_until(self, end: str | None) -> Callable:
        parts = []
        while self.i < len(self.tokens) and not (end and self.peek(end)):
            parts.append(self.statement())
        if end:
            self.need(end)

        def run(s: Scope) -> None:
            for p in parts:
                p(s)

        return run

    def statement(self) -> Callable:
        if self.take("{"):
            return self.block_until("}")
        if self.take(";"):
            return lambda s: None
        if self.take("var", "let", "const"):
            return self.declaration()
        if self.take("if"):
            self.need("(")
            test = self.expression()
            self.need(")")
            yes = self.statement()
            no = self.statement() if self.take("else") else None
            return lambda s: yes(s) if truth(test(s)) else no(s) if no else None
        if self.take("while"):
            self.need("(")
            test = self.expression()
            self.need(")")
            return self.loop(None, test, None, self.statement())
        if self.take("for"):
            self.need("(")
            first = None if self.peek(";") else self.declaration(False) if self.take("var", "let") else self.expression()
            self.need(";")
            test = None if self.peek(";") else self.expression()
            self.need(";")
            each = None if self.peek(")") else self.expression()
            self.need(")")
            return self.loop(first, test, each, self.statement())
        if self.take("function"):
            name = self.name()
            make = self.function()
            return lambda s: s.__setitem__(name, make(s))
        if self.take("return"):
            value = None if self.peek(";", "}") else self.expression()
            self.take(";")

            def leave(s):
                raise _Return(value(s) if value else UNDEFINED)

            return leave
        for word, kind in (("break", _Break), ("continue", _Continue)):
            if self.take(word):
                self.take(";")

                def jump(s, kind=kind):
                    raise kind

                return jump
        if self.peek("switch", "try", "throw", "do", "with", "new", "class"):
            self.fail("not supported")
        e = self.expression()
        self.take(";")
        return e

    def loop(self, first, test, each, body) -> Callable:
        def run(s: Scope) -> None:
            if first:
                first(s)
            while test is None or truth(test(s)):
                try:
                    body(s)
                except _Continue:
                    pass
                except _Break:
                    break
                if each:
                    each(s)

        return run

    def declaration(self, close: bool = True) -> Callable:
        parts = []
        while True:
            name = self.name()
            value = self.assignment() if self.take("=") else None
            parts.append((name, value))
            if not self.take(","):
                break
        if close:
            self.take(";")

        def run(s: Scope) -> None:
            for n, v in parts:
                if v is not None:
                    s[n] = v(s)
                else:
                    s.setdefault(n, UNDEFINED)

        return run

    def function(self) -> Callable:
        self.need("(")
        names = []
        while not self.take(")"):
            names.append(self.name())
            self.take(",")
        self.need("{")
        body = self.block_until("}")

        def make(outer: Scope) -> Callable:
            def call(*args):
                s = Scope(outer, **dict(zip(names, [*args, *[UNDEFINED] * len(names)], strict=False)))
                try:
                    body(s)
                except _Return as r:
                    return r.args[0]
                return UNDEFINED

            return call

        return make

    def expression(self) -> Callable:
        e = self.assignment()
        while self.take(","):
            a, b = e, self.assignment()
            e = lambda s, a=a, b=b: (a(s), b(s))[1]
        return e

    def assignment(self) -> Callable:
        left = self.conditional()
        for op in ("=", "+=", "-=", "*=", "/=", "%="):
            if self.take(op):
                put = getattr(left, "put", None)
                if put is None:
                    self.fail("can't assign")
                right = self.assignment()
                f = _BINARY.get(op[:-1])
                return (lambda s: put(s, right(s))) if f is None else (lambda s: put(s, f(left(s), right(s))))
        return left

    def conditional(self) -> Callable:
        test = self.binary(0)
        if not self.take("?"):
            return test
        yes = self.assignment()
        self.need(":")
        no = self.assignment()
        return lambda s: yes(s) if truth(test(s)) else no(s)

    def binary(self, level: int) -> Callable:
        if level == len(_LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek(*_LEVELS[level]):
            op = self.tokens[self.i][1]
            self.i += 1
            a, b = left, self.binary(level + 1)
            if op in ("&&", "||"):
                left = (lambda s, a=a, b=b: b(s) if truth(x := a(s)) else x) if op == "&&" else (lambda s, a=a, b=b: x if truth(x := a(s)) else b(s))
            else:
                left = lambda s, a=a, b=b, f=_BINARY[op]: f(a(s), b(s))
        return left

    def unary(self) -> Callable:
        if self.take("!"):
            e = self.unary()
            return lambda s: not truth(e(s))
        if self.take("-"):
            e = self.unary()
            return lambda s: -to_number(e(s))
        if self.take("+"):
            e = self.unary()
            return lambda s: to_number(e(s))
        if self.take("typeof"):
            e = self.unary()
            kind = lambda v: "undefined" if v is UNDEFINED else "boolean" if isinstance(v, bool) else "number" if isinstance(v, int | float) else "string" if isinstance(v, str) else "function" if callable(v) else "object"
            return lambda s: kind(e(s))
        for op, by in (("++", 1.0), ("--", -1.0)):
            if self.take(op):
                e = self.unary()
                return lambda s, by=by: e.put(s, to_number(e(s)) + by)
        e = self.postfix(self.primary())
        for op, by in (("++", 1.0), ("--", -1.0)):
            if self.take(op):

                def bump(s, by=by):
                    old = to_number(e(s))
                    e.put(s, old + by)
                    return old

                return bump
        return e

    def primary(self) -> Callable:
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.assignment())
                self.take(",")
            return lambda s: [x(s) for x in items]
        if self.take("function"):
            return self.function()
        if self.i >= len(self.tokens):
            self.fail("the script ends early")
        kind, text, _ = self.tokens[self.i]
        if kind == "op":
            self.fail("unexpected")
        self.i += 1
        if kind == "num":
            value = float(int(text, 16)) if text[:2].lower() == "0x" else float(text)
            return lambda s: value
        if kind == "str":
            plain = re.sub(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "0": "\0"}.get(m[1], m[1]), text[1:-1], flags=re.S)
            return lambda s: plain
        if text == "new":
            self.fail("not supported")

        def read(s: Scope):
            home = s.home(text)
            if home is not None:
                return home[text]
            if text in _GLOBALS:
                return _GLOBALS[text]
            raise NameError(f"{text} is not defined")

        def put(s: Scope, v):
            home = s.home(text)
            (s if home is None else home)[text] = v
            return v

        read.put = put
        return read

    def postfix(self, e: Callable) -> Callable:
        while True:
            if self.take("."):
                e = lambda s, o=e, n=self.name(): _member(o(s), n)
            elif self.take("["):
                index = self.expression()
                self.need("]")
                o = e

                def put(s, v, o=o, index=index):
                    target, k = o(s), _whole(index(s))
                    target += [UNDEFINED] * (k + 1 - len(target))
                    target[k] = v
                    return v

                e = lambda s, o=o, i=index: _item(o(s), i(s))
                e.put = put
            elif self.take("("):
                args = []
                while not self.take(")"):
                    args.append(self.assignment())
                    self.take(",")
                e = lambda s, f=e, args=args: f(s)(*[a(s) for a in args])
            else:
                return e


def compile_script(text: str) -> Callable[[dict], dict]:
    """A function from the names it finds to the names it leaves; every call starts afresh."""
    program = _Compiler(text).program()

    def run(names: dict) -> dict:
        scope = Scope(None, **names)
        program(scope)
        return scope

    return run

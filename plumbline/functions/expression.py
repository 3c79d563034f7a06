"""Predicates, arithmetic and assignments written as text, turned into Columns.

Precedence from loose to tight: ``||``, ``&&``, ``!``, comparison, ``+ -``,
``* /``, unary minus, parentheses and functions.  A value is a number or a
truth value, and the two don't mix.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = {"abs": F.abs, "ceil": F.ceil, "floor": F.floor, "sqrt": F.sqrt, "exp": F.exp, "log": F.ln, "log10": F.log10, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "round": F.rint}
LOGICAL = {"isnan": F.isnan}
CONSTANTS = {"pi": 3.141592653589793, "e": 2.718281828459045}

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_][\w.]*)|(\|\||&&|==|!=|<=|>=|[-+*/()<>!=,]))")


class ExpressionError(ValueError):
    """A text that isn't a predicate, an arithmetic expression or an assignment."""


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ExpressionError(f"unexpected {text[at]!r} at {at} of {text!r}")
            self.tokens.append(m.group(m.lastindex) if m.lastindex else "")
            at = m.end()
        self.at, self.text = 0, text

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise ExpressionError(f"{wanted!r} is missing in {self.text!r}")

    def check(self, value: tuple[str, Column], kind: str) -> Column:
        if value[0] != kind:
            raise ExpressionError(f"a {kind} is needed, not a {value[0]}, in {self.text!r}")
        return value[1]

    def any_of(self) -> tuple[str, Column]:
        left = self.all_of()
        while self.take("||"):
            left = ("truth", self.check(left, "truth") | self.check(self.all_of(), "truth"))
        return left

    def all_of(self) -> tuple[str, Column]:
        left = self.negation()
        while self.take("&&"):
            left = ("truth", self.check(left, "truth") & self.check(self.negation(), "truth"))
        return left

    def negation(self) -> tuple[str, Column]:
        if self.take("!"):
            return "truth", ~self.check(self.negation(), "truth")
        return self.comparison()

    def comparison(self) -> tuple[str, Column]:
        left = self.total()
        sign = self.take("==", "!=", "<=", ">=", "<", ">")
        if not sign:
            return left
        a, b = self.check(left, "number"), self.check(self.total(), "number")
        return "truth", {"==": a == b, "!=": a != b, "<=": a <= b, ">=": a >= b, "<": a < b, ">": a > b}[sign]

    def total(self) -> tuple[str, Column]:
        left = self.product()
        while sign := self.take("+", "-"):
            a, b = self.check(left, "number"), self.check(self.product(), "number")
            left = ("number", a + b if sign == "+" else a - b)
        return left

    def product(self) -> tuple[str, Column]:
        left = self.signed()
        while sign := self.take("*", "/"):
            a, b = self.check(left, "number"), self.check(self.signed(), "number")
            left = ("number", a * b if sign == "*" else F.when(b != 0, a / b))
        return left

    def signed(self) -> tuple[str, Column]:
        if self.take("-"):
            return "number", -self.check(self.signed(), "number")
        return self.primary()

    def primary(self) -> tuple[str, Column]:
        token = self.peek()
        if token is None:
            raise ExpressionError(f"{self.text!r} ends too soon")
        self.at += 1
        if token == "(":
            inner = self.any_of()
            self.need(")")
            return inner
        if token[0].isdigit() or token[0] == ".":
            return "number", F.lit(float(token))
        if not re.match(r"[A-Za-z_]", token):
            raise ExpressionError(f"unexpected {token!r} in {self.text!r}")
        if self.take("("):
            if self.take(")"):
                if token.lower() in CONSTANTS:
                    return "number", F.lit(CONSTANTS[token.lower()])
                raise ExpressionError(f"unknown function {token!r}")
            inner = self.check(self.any_of(), "number")
            self.need(")")
            if token.lower() in NUMERIC:
                return "number", NUMERIC[token.lower()](inner).cast("double")
            if token.lower() in LOGICAL:
                return "truth", LOGICAL[token.lower()](inner)
            raise ExpressionError(f"unknown function {token!r}")
        return "number", F.col(token).cast("double")

    def done(self) -> None:
        if self.peek() is not None:
            raise ExpressionError(f"unexpected {self.peek()!r} in {self.text!r}")


def condition(text: str) -> Column:
    parser = _Parser(text)
    out = parser.check(parser.any_of(), "truth")
    parser.done()
    return out


def arithmetic(text: str) -> Column:
    parser = _Parser(text)
    out = parser.check(parser.any_of(), "number")
    parser.done()
    return out


def assignment(text: str) -> tuple[str, Column, Column | None]:
    """(dimension, value, condition or None) of ``Dim = expression [WHERE condition]``."""
    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(?!=)\s*(.+?)(?:\s+WHERE\s+(.+))?\s*", text, re.I | re.S)
    if not m:
        raise ExpressionError(f"not an assignment: {text!r}")
    return m[1], arithmetic(m[2]), condition(m[3]) if m[3] else None


def ranges(text: str) -> Column:
    """``Dim[low:high]`` with ``(`` for a bound left out and ``!`` before the bracket for the opposite.

    Ranges of one dimension are alternatives; different dimensions must all hold.
    """
    by_name: dict[str, list[Column]] = {}
    rest = text.strip()
    while rest:
        m = re.match(r"\s*([A-Za-z_]\w*)\s*(!?)\s*([\[(])\s*([^:\])]*):([^\])]*)([\])])\s*,?", rest)
        if not m:
            raise ExpressionError(f"not a range: {rest!r}")
        name, negated, left, low, high, right = m.groups()
        c, parts = F.col(name), []
        if low.strip():
            parts.append(c >= float(low) if left == "[" else c > float(low))
        if high.strip():
            parts.append(c <= float(high) if right == "]" else c < float(high))
        inside = reduce(lambda a, b: a & b, parts, F.lit(True))
        by_name.setdefault(name, []).append(~inside if negated else inside)
        rest = rest[m.end() :].strip()
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, v) for v in by_name.values()], F.lit(True))


def mongo(spec: str | dict) -> Column:
    """A JSON predicate: ``$eq $ne $gt $gte $lt $lte $in $nin`` under ``$and $or $not $nor``."""
    spec = json.loads(spec) if isinstance(spec, str) else spec

    def value(v: object) -> Column:
        return F.col(v) if isinstance(v, str) else F.lit(v)

    def test(name: str, what: object) -> Column:
        c = F.col(name)
        if not isinstance(what, dict):
            return c == value(what)
        one = {"$eq": c.__eq__, "$ne": c.__ne__, "$gt": c.__gt__, "$gte": c.__ge__, "$lt": c.__lt__, "$lte": c.__le__}
        parts = []
        for sign, v in what.items():
            if sign in one:
                parts.append(one[sign](value(v)))
            elif sign == "$in":
                parts.append(c.isin(*v))
            elif sign == "$nin":
                parts.append(~c.isin(*v))
            elif sign == "$not":
                parts.append(~test(name, v))
            else:
                raise ExpressionError(f"unknown {sign!r}")
        return reduce(lambda a, b: a & b, parts)

    parts = []
    for name, what in spec.items():
        if name in ("$and", "$or", "$nor"):
            every = [mongo(x) for x in what]
            joined = reduce((lambda a, b: a & b) if name == "$and" else (lambda a, b: a | b), every)
            parts.append(~joined if name == "$nor" else joined)
        elif name == "$not":
            parts.append(~mongo(what))
        else:
            parts.append(test(name, what))
    return reduce(lambda a, b: a & b, parts, F.lit(True))

"""The C expression subset of filters and lets, parsed into Spark columns.

Operators by binding, weakest first: ?:, ||, &&, |, ^, &, == !=, < <= > >=, << >>, + -, * / %, unary ! - ~ +. Between whole
numbers / truncates. Casts are ignored, and `return` and `;` around the expression as well.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)[uUlLfF]*|(?P<name>[A-Za-z_][A-Za-z0-9_]*(?:::[A-Za-z_][A-Za-z0-9_]*)*)|(?P<text>\"(?:[^\"\\]|\\.)*\")|(?P<sign><<|>>|<=|>=|==|!=|&&|\|\||[-+*/%<>!&|^~?:(),]))")
#: Binary operators with their binding strength.
_BINDING = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, "<=": 7, ">": 7, ">=": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
_CAST_TYPES = frozenset("int long unsigned signed short char float double bool size_t int32_t int64_t uint32_t uint64_t std::size_t".split())


class ExpressionError(ValueError):
    pass


class Typed:
    """A column and whether it is a fraction, text or truth value; what is none of these is a whole number."""

    def __init__(self, column: Column, kind: str = "int"):
        self.column, self.kind = column, kind

    def truth(self) -> Column:
        return self.column if self.kind == "bool" else self.column != 0

    def number(self) -> Column:
        return self.column.cast("long") if self.kind == "bool" else self.column


def _binary(op: str, a: Typed, b: Typed) -> Typed:
    if op == "||":
        return Typed(a.truth() | b.truth(), "bool")
    if op == "&&":
        return Typed(a.truth() & b.truth(), "bool")
    if op in ("==", "!="):
        x, y = (a.column, b.column) if a.kind == b.kind else (a.number(), b.number())
        return Typed(x == y if op == "==" else x != y, "bool")
    x, y = a.number(), b.number()
    if op in ("<", "<=", ">", ">="):
        return Typed({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "bool")
    kind = "float" if "float" in (a.kind, b.kind) else "int"
    if op == "/":
        return Typed(x / y if kind == "float" else _div(x, y), kind)
    if op in "+-*%":
        return Typed({"+": x + y, "-": x - y, "*": x * y, "%": x % y}[op], kind)
    if op in ("<<", ">>"):
        return Typed(F.call_function("shiftleft" if op == "<<" else "shiftright", x, y.cast("int")))
    return Typed({"&": x.bitwiseAND(y), "|": x.bitwiseOR(y), "^": x.bitwiseXOR(y)}[op])


def _div(x: Column, y: Column) -> Column:
    """Whole division towards zero; SQL's div is the one that stays exact beyond 2^53."""
    return F.call_function("div", x.cast("long"), y.cast("long"))


_FUNCTIONS: dict[str, Callable[[list[Typed]], Typed]] = {
    "abs": lambda a: Typed(F.abs(a[0].number()), a[0].kind),
    "min": lambda a: Typed(F.least(*(x.number() for x in a)), a[0].kind),
    "max": lambda a: Typed(F.greatest(*(x.number() for x in a)), a[0].kind),
}


class _Parser:
    def __init__(self, text: str, env: dict[str, Typed]):
        body = re.sub(r"^\s*return\b", "", text.strip()).strip().rstrip(";").strip()
        self.text, self.env, self.tokens, at = text, env, [], 0
        while at < len(body):
            if not (m := _TOKEN.match(body, at)):
                raise ExpressionError(f"cannot read {body[at:at + 20]!r} in {text!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> str | None:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else None

    def take(self, expected: str | None = None):
        if self.at >= len(self.tokens) or (expected and self.peek() != expected):
            raise ExpressionError(f"expected {expected or 'more'} in {self.text!r}")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> Typed:
        found = self.choice()
        if self.peek() is not None:
            raise ExpressionError(f"unexpected {self.peek()!r} in {self.text!r}")
        return found

    def choice(self) -> Typed:
        test = self.binary(1)
        if self.peek() != "?":
            return test
        self.take("?")
        yes = self.choice()
        self.take(":")
        no = self.choice()
        return Typed(F.when(test.truth(), yes.column).otherwise(no.column), "float" if "float" in (yes.kind, no.kind) else yes.kind)

    def binary(self, least: int) -> Typed:
        left = self.unary()
        while (strength := _BINDING.get(self.peek() or "", 0)) >= least:
            _, op = self.take()
            left = _binary(op, left, self.binary(strength + 1))
        return left

    def unary(self) -> Typed:
        kind, value = self.take()
        if kind == "number":
            whole = value.isdigit()
            return Typed(F.lit(int(value)).cast("long") if whole else F.lit(float(value)), "int" if whole else "float")
        if kind == "text":
            return Typed(F.lit(re.sub(r"\\(.)", r"\1", value[1:-1])), "str")
        if kind == "name":
            return self.named(value)
        if value == "(":
            if self.peek() in _CAST_TYPES:
                while self.peek() in _CAST_TYPES:
                    self.take()
                self.take(")")
                return self.unary()
            inner = self.choice()
            self.take(")")
            return inner
        if value in "!-~+":
            x = self.unary()
            return x if value == "+" else Typed(~x.truth(), "bool") if value == "!" else Typed(-x.number(), x.kind) if value == "-" else Typed(F.bitwise_not(x.number()))
        raise ExpressionError(f"unexpected {value!r} in {self.text!r}")

    def named(self, name: str) -> Typed:
        if name in ("true", "false"):
            return Typed(F.lit(name == "true"), "bool")
        if name == "static_cast":
            self.take("<")
            while self.peek() != ">":
                self.take()
            self.take(">")
            self.take("(")
            inner = self.choice()
            self.take(")")
            return inner
        if self.peek() == "(":
            made = _FUNCTIONS.get(name.removeprefix("std::"))
            if not made:
                raise ExpressionError(f"no function {name} in {self.text!r}")
            self.take("(")
            args = [self.choice()]
            while self.peek() == ",":
                self.take()
                args.append(self.choice())
            self.take(")")
            return made(args)
        if name not in self.env:
            raise ExpressionError(f"{name} is not bound in {self.text!r}")
        return self.env[name]


def names_in(code: str) -> set[str]:
    """The identifiers of an expression that may be variables."""
    plain = re.sub(r"\"(?:[^\"\\]|\\.)*\"", "", code)
    return set(re.findall(r"(?<![\w.:])[A-Za-z_]\w*(?!\s*\(|\w|::)", plain)) - _CAST_TYPES - {"return", "true", "false", "static_cast"}


def environment(types: dict[str, str]) -> dict[str, Typed]:
    """Variables by name, with the kinds of their Spark types."""
    kind = lambda t: "float" if t in ("float", "double") or t.startswith("decimal") else "str" if t == "string" else "bool" if t == "boolean" else "int"
    return {v: Typed(F.col(f"`{v}`"), kind(t)) for v, t in types.items()}


def column_of(code: str | Callable, types: dict[str, str], order: Iterable[str] = ()) -> Column:
    """The value of an expression over the variables in types; a function gets the columns in `order`."""
    if callable(code):
        return code(*(F.col(f"`{v}`") for v in order))
    return _Parser(code, environment(types)).whole().column


def condition_of(code: str | Callable, types: dict[str, str], order: Iterable[str] = ()) -> Column:
    return column_of(code, types, order) if callable(code) else _Parser(code, environment(types)).whole().truth()


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)

"""Predicates over typed tuples with three-valued logic, as data: a tree that gives a Column, a text form and back."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS = {"=": "__eq__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


@dataclass(frozen=True)
class Predicate:
    """kind: bool, and, or, not, cmp (column, op, literal), colcmp (column, op, column), isnull (column)."""

    kind: str
    args: tuple[Any, ...]

    def column(self, types: dict[str, str] | None = None) -> Column:
        """A Column of it. Comparisons of unlike classes (text with number) are unknown, not cast; types has each column's class."""
        k, a = self.kind, self.args
        if k == "bool":
            return F.lit(a[0])
        if k in ("and", "or"):
            out = F.lit(k == "and")
            for p in a:
                out = out & p.column(types) if k == "and" else out | p.column(types)
            return out
        if k == "not":
            return ~a[0].column(types)
        if k == "isnull":
            return F.col(a[0]).isNull()
        left, op, right = a
        unlike = types is not None and self._class(left, types, True) != self._class(right, types, k == "colcmp")
        if unlike or (k == "cmp" and right is None):
            return F.lit(None).cast("boolean")
        return getattr(F.col(left), _OPS[op])(F.col(right) if k == "colcmp" else F.lit(right))

    @staticmethod
    def _class(x: Any, types: dict[str, str], is_column: bool) -> str:
        kind = types.get(x, "text") if is_column else {int: "number", float: "number", bool: "number", bytes: "blob"}.get(type(x), "text")
        return "number" if kind in ("integer", "real", "number", "bigint", "double", "int") else kind

    def dumps(self) -> str:
        return json.dumps([self.kind, *[json.loads(a.dumps()) if isinstance(a, Predicate) else a for a in self.args]])

    @staticmethod
    def loads(text: str) -> Predicate:
        def build(x: list[Any]) -> Predicate:
            kind, *args = x
            return Predicate(kind, tuple(build(a) if kind in ("and", "or", "not") else a for a in args))

        return build(json.loads(text))


def cmp(column: str, op: str, value: Any) -> Predicate:
    return Predicate("cmp", (column, op, value))


def colcmp(left: str, op: str, right: str) -> Predicate:
    return Predicate("colcmp", (left, op, right))


def between(column: str, lo: Any, hi: Any) -> Predicate:
    return Predicate("and", (cmp(column, ">=", lo), cmp(column, "<=", hi)))


def is_null(column: str) -> Predicate:
    return Predicate("isnull", (column,))


def both(*p: Predicate) -> Predicate:
    return Predicate("and", p)


def either(*p: Predicate) -> Predicate:
    return Predicate("or", p)


def negate(p: Predicate) -> Predicate:
    return Predicate("not", (p,))


TRUE = Predicate("bool", (True,))

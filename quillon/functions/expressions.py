"""Typed, null-strict column expressions that become ordinary Spark columns.

An expression is bound to a schema, which settles its type by the promotion rules, and gives one
Column. A null anywhere among its columns makes it null, under AND and OR too; only expressions with
AND, OR or NOT need a guard for that, so plain comparisons still reach the file scan as filters.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import ColumnNotFound, TypeMismatch, UnsupportedExpression
from quillon.types import is_integral, promote

_ARITHMETIC = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": None, "%": operator.mod}
_COMPARISON = {"==": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
_LOGIC = {"and": operator.and_, "or": operator.or_}


@dataclass(frozen=True)
class Bound:
    column: Column
    type: T.DataType
    leaves: frozenset[str]
    logic: bool = False  # holds AND or OR
    guard: bool = False  # a filter needs the guard too: OR, or NOT above AND or OR


class Expr:
    """Operators build expressions: + - * / %, comparisons, & and | and ~ for logic."""

    name = "expr"

    def _with(self, op: str, other: object, swap: bool = False) -> Expr:
        other = other if isinstance(other, Expr) else Lit(other)
        return Binary(op, other, self) if swap else Binary(op, self, other)

    def __bool__(self) -> bool:
        raise UnsupportedExpression("use & | ~ for logic on expressions")

    def alias(self, name: str) -> Expr:
        return Alias(self, name)

    def resolve(self, schema: T.StructType) -> Bound:
        raise NotImplementedError

    def bind(self, schema: T.StructType, as_filter: bool = False) -> Column:
        """The Column of the expression on this schema; as_filter spares the guard where dropped rows are the same."""
        b = self.resolve(schema)
        if as_filter and not isinstance(b.type, T.BooleanType):
            raise TypeMismatch(f"a filter must be boolean, not {b.type.simpleString()}")
        if not (b.guard if as_filter else b.logic) or not b.leaves:
            return b.column
        known = reduce(operator.and_, [F.col(f"`{n}`").isNotNull() for n in sorted(b.leaves)])
        return F.when(known, b.column)


for _op, _names in {"+": ("__add__", "__radd__"), "-": ("__sub__", "__rsub__"), "*": ("__mul__", "__rmul__"), "/": ("__truediv__", "__rtruediv__"), "%": ("__mod__", "__rmod__"), "and": ("__and__", "__rand__"), "or": ("__or__", "__ror__")}.items():
    setattr(Expr, _names[0], lambda self, other, op=_op: self._with(op, other))
    setattr(Expr, _names[1], lambda self, other, op=_op: self._with(op, other, True))
for _op, _name in {"==": "__eq__", "!=": "__ne__", ">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__"}.items():
    setattr(Expr, _name, lambda self, other, op=_op: self._with(op, other))
Expr.__invert__ = lambda self: Not(self)
Expr.__hash__ = object.__hash__


class Col(Expr):
    def __init__(self, name: str, type: T.DataType | None = None) -> None:
        self.name, self.expected = name, type

    def resolve(self, schema: T.StructType) -> Bound:
        for f in schema.fields:
            if f.name.lower() == self.name.lower():
                if self.expected is not None and f.dataType != self.expected:
                    raise TypeMismatch(f"{f.name} is {f.dataType.simpleString()}, not {self.expected.simpleString()}")
                return Bound(F.col(f"`{f.name}`"), f.dataType, frozenset([f.name]))
        raise ColumnNotFound(self.name, schema.names)


class Lit(Expr):
    def __init__(self, value: object) -> None:
        if value is None:
            raise UnsupportedExpression("a null literal has no type")
        if isinstance(value, Column):
            raise UnsupportedExpression("a Spark Column is not an expression of this library")
        self.value, self.name = value, str(value)

    def resolve(self, schema: T.StructType) -> Bound:
        v = self.value
        if isinstance(v, int) and not isinstance(v, bool):
            kind = T.IntegerType() if -(1 << 31) <= v < 1 << 31 else T.LongType()
        else:
            kind = T._infer_type(v)
        return Bound(F.lit(v), kind, frozenset())


class Alias(Expr):
    def __init__(self, of: Expr, name: str) -> None:
        self.of, self.name = of, name

    def resolve(self, schema: T.StructType) -> Bound:
        return self.of.resolve(schema)


class Not(Expr):
    def __init__(self, of: Expr) -> None:
        self.of, self.name = of, f"NOT {of.name}"

    def resolve(self, schema: T.StructType) -> Bound:
        b = self.of.resolve(schema)
        if not isinstance(b.type, T.BooleanType):
            raise TypeMismatch("NOT takes a boolean")
        return Bound(~b.column, b.type, b.leaves, b.logic, b.logic)


class Binary(Expr):
    def __init__(self, op: str, left: Expr, right: Expr) -> None:
        self.op, self.left, self.right = op, left, right
        self.name = f"({left.name} {op} {right.name})"

    def resolve(self, schema: T.StructType) -> Bound:
        a, b = self.left.resolve(schema), self.right.resolve(schema)
        leaves, logic, guard = a.leaves | b.leaves, a.logic or b.logic, a.guard or b.guard
        if self.op in _LOGIC:
            if not (isinstance(a.type, T.BooleanType) and isinstance(b.type, T.BooleanType)):
                raise TypeMismatch(f"{self.op.upper()} takes booleans")
            return Bound(_LOGIC[self.op](a.column, b.column), T.BooleanType(), leaves, True, guard or self.op == "or")
        kind = self._common(a, b)
        left, right = (x.column if x.type == kind else x.column.cast(kind) for x in (a, b))
        if self.op in _COMPARISON:
            return Bound(_COMPARISON[self.op](left, right), T.BooleanType(), leaves, logic, guard)
        if not isinstance(kind, T.NumericType):
            raise TypeMismatch(f"{self.op} takes numbers")
        return Bound(_arithmetic(self.op, left, right, kind), kind, leaves, logic, guard)

    def _common(self, a: Bound, b: Bound) -> T.DataType:
        """A literal takes the column's type where it fits in, else both are promoted."""
        for literal, other, bound in ((self.left, b, a), (self.right, a, b)):
            if isinstance(literal, Lit) and isinstance(bound.type, (T.IntegerType, T.LongType)) and isinstance(other.type, (T.FloatType, T.DecimalType)) or (
                isinstance(literal, Lit) and isinstance(other.type, T.FloatType) and isinstance(bound.type, T.DoubleType)
            ):
                return other.type
            if isinstance(literal, Lit) and isinstance(literal.value, str) and isinstance(other.type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                return other.type
        return promote(a.type, b.type)


def _arithmetic(op: str, left: Column, right: Column, kind: T.DataType) -> Column:
    if op == "/" and is_integral(kind):
        return F.call_function("div", left, right).cast(kind)  # towards zero; by zero is an error
    if isinstance(kind, (T.FloatType, T.DoubleType)) and op in "/%":  # IEEE: infinite, or not a number
        below = right.cast("string") == "-0.0"  # a zero's sign, which no comparison tells
        by_zero = left * F.when(below, float("-inf")).otherwise(float("inf")).cast(kind) if op == "/" else left * F.lit(float("nan")).cast(kind)
        return F.when(right == 0, by_zero).otherwise(left / right if op == "/" else left % right).cast(kind)
    if op == "/":
        return (left / right).cast(kind)
    return _ARITHMETIC[op](left, right).cast(kind)


def col(name: str, type: T.DataType | None = None) -> Col:
    return Col(name, type)


def lit(value: object) -> Lit:
    return Lit(value)


def not_(of: Expr) -> Not:
    return Not(of)

"""Grouped and whole-column aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import QuillonError, SchemaError, TypeMismatch
from quillon.functions.expressions import Col, Expr
from quillon.types import field, is_integral, require, require_unique, sum_type

STANDARD = ("count", "sum", "min", "max", "mean")


@dataclass(frozen=True)
class Aggregate:
    """A function of a column or expression under a name; of is None for row_count."""

    function: str | Callable[[Column], Column]
    of: str | Expr | None = None
    name: str | None = None


def count(of: str | Expr, name: str | None = None) -> Aggregate:
    """Values that aren't null."""
    return Aggregate("count", of, name)


def row_count(name: str = "count") -> Aggregate:
    return Aggregate("row_count", None, name)


def sum_(of: str | Expr, name: str | None = None) -> Aggregate:
    """Long, double or the decimal's own type; 0 for a group of nulls alone."""
    return Aggregate("sum", of, name)


def min_(of: str | Expr, name: str | None = None) -> Aggregate:
    return Aggregate("min", of, name)


def max_(of: str | Expr, name: str | None = None) -> Aggregate:
    return Aggregate("max", of, name)


def mean(of: str | Expr, name: str | None = None) -> Aggregate:
    """Double; null for a group of nulls alone."""
    return Aggregate("mean", of, name)


def _expr(of: str | Expr) -> Expr:
    return Col(of) if isinstance(of, str) else of


def _built(df: DataFrame, a: Aggregate) -> Column:
    if a.function == "row_count":
        return F.count(F.lit(1)).alias(a.name or "count")
    of = _expr(a.of)
    kind, column, name = of.resolve(df.schema).type, of.bind(df.schema), a.name or of.name
    if callable(a.function):
        return a.function(column).alias(name)
    if a.function in ("sum", "mean") and not isinstance(kind, T.NumericType):
        raise TypeMismatch(f"{a.function} takes numbers, {of.name} is {kind.simpleString()}")
    if a.function == "sum":
        return F.coalesce(F.sum(column), F.lit(0)).cast(sum_type(kind)).alias(name)
    if a.function == "mean":
        return F.avg(column.cast("double")).alias(name)
    if a.function not in STANDARD:
        raise SchemaError(f"no aggregate {a.function!r}")
    return getattr(F, a.function)(column).alias(name)


def group_by(df: DataFrame, keys: Sequence[str | Expr] | str, aggregates: Sequence[Aggregate] = ()) -> DataFrame:
    """Keys (names or expressions), then aggregates; null is a key. Without aggregates the distinct keys."""
    exprs = [_expr(k) for k in ([keys] if isinstance(keys, (str, Expr)) else keys)]
    if not exprs:
        raise SchemaError("group by at least one key")
    names = [field(df, k.name).name if isinstance(k, Col) else k.name for k in exprs]
    columns = [k.bind(df.schema).alias(n) for k, n in zip(exprs, names, strict=True)]
    if not aggregates:
        require_unique(names)
        return df.select(*columns).distinct()
    made = [_built(df, a) for a in aggregates]
    require_unique([*names, *(a.name or (a.of if isinstance(a.of, str) else a.of.name if a.of is not None else "count") for a in aggregates)])
    return df.groupBy(*columns).agg(*made)


def group_by_dict(df: DataFrame, keys: Sequence[str] | str, functions: dict[str, str]) -> DataFrame:
    """One aggregate a column, under the column's name."""
    return group_by(df, keys, [Aggregate(f, c, c) for c, f in functions.items()])


def custom_aggregate(df: DataFrame, keys: Sequence[str] | str, of: str, function: Callable[[pd.Series], object], kind: str, name: str) -> DataFrame:
    """A Python function of a group's values (a pandas Series), for what no SQL aggregate does; a group has to fit in a task."""
    udaf = F.pandas_udf(_typed(function), kind)
    return df.groupBy(*([keys] if isinstance(keys, str) else keys)).agg(udaf(F.col(of)).alias(name))


def _typed(function: Callable[[pd.Series], object]) -> Callable:
    def run(values: pd.Series) -> float:
        return function(values)

    return run


def median(of: str | Expr, name: str | None = None) -> Aggregate:
    return Aggregate(lambda c: F.median(c), of, name)


def distinct(df: DataFrame, columns: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Distinct rows; or the first row, in order, of each combination of columns. Null is equal to null."""
    if not columns:
        return df.distinct()
    names = require(df, list(columns))
    if not order:
        raise SchemaError("the first row of each needs an order")
    w = Window.partitionBy(*names).orderBy(*(F.col(o).asc_nulls_last() for o in require(df, list(order))))
    return df.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


# --- reductions of a column to a value on the driver ----------------------------------------------


def _reduced(df: DataFrame, name: str, *columns: Column) -> tuple:
    return tuple(df.agg(*columns, F.count("*")).first())


def column_sum(df: DataFrame, name: str) -> object:
    """0 if all are null; an error if there are no rows."""
    f = field(df, name)
    total, rows = _reduced(df, name, F.coalesce(F.sum(f.name), F.lit(0)).cast(sum_type(f.dataType)))
    if not rows:
        raise QuillonError("no rows to sum")
    return total


def column_extreme(df: DataFrame, name: str, largest: bool) -> object:
    value, _ = _reduced(df, name, (F.max if largest else F.min)(field(df, name).name))
    if value is None:
        raise QuillonError("no values")
    return value


def column_mean(df: DataFrame, name: str) -> float:
    """Not a number if all are null; an error if there are no rows."""
    value, rows = _reduced(df, name, F.avg(field(df, name).name))
    if not rows:
        raise QuillonError("no rows to average")
    return float("nan") if value is None else float(value)


def series_average(df: DataFrame, name: str) -> object:
    """In the column's own type, so that integers divide towards zero; an error if there are no values."""
    f = field(df, name)
    total, n, _ = _reduced(df, name, F.sum(f.name), F.count(f.name))
    if not n:
        raise QuillonError("no values")
    return int(total / n) if is_integral(f.dataType) and abs(total) < 1 << 52 else (abs(total) // n * (1 if total >= 0 else -1) if is_integral(f.dataType) else total / n)

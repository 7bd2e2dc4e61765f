"""Projections, renames, filters, user functions and nulls of columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.errors import SchemaError
from quillon.functions.expressions import Expr
from quillon.types import field, require, require_free, require_unique


def select(df: DataFrame, *of: str | Expr, names: Sequence[str] | None = None) -> DataFrame:
    """Columns by name and expressions, under their own names, or under names."""
    if not of:
        raise SchemaError("select at least one column")
    made = [(F.col(field(df, x).name), field(df, x).name) if isinstance(x, str) else (x.bind(df.schema), x.name) for x in of]
    out = list(names) if names else [n for _, n in made]
    require_unique(out)
    return df.select(*(c.alias(n) for (c, _), n in zip(made, out, strict=True)))


def select_and_rename(df: DataFrame, mapping: dict[str, str | None]) -> DataFrame:
    """Only the columns in the mapping, under their new names; None keeps a name."""
    names = require(df, list(mapping))
    new = [to or n for n, to in zip(names, mapping.values(), strict=True)]
    require_unique(new)
    return df.select(*(F.col(n).alias(t) for n, t in zip(names, new, strict=True)))


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    old = {field(df, k).name: v for k, v in mapping.items()}
    require_unique([old.get(c, c) for c in df.columns])
    return df.withColumnsRenamed(old)


def exclude(df: DataFrame, *names: str) -> DataFrame:
    gone = set(require(df, list(names)))
    if len(gone) == len(df.columns):
        raise SchemaError("a frame keeps one column at least")
    return df.drop(*gone)


def with_column(df: DataFrame, name: str, of: Expr) -> DataFrame:
    """A new column; a name that is taken is an error."""
    require_free(df, name)
    return df.withColumn(name, of.bind(df.schema))


def filter_(df: DataFrame, condition: Expr) -> DataFrame:
    """Rows where it is true; null drops a row."""
    return df.where(condition.bind(df.schema, as_filter=True))


def filter_by_mask(df: DataFrame, mask: str) -> DataFrame:
    """Rows where the boolean column is true, without that column."""
    f = field(df, mask)
    if f.dataType.typeName() != "boolean":
        raise SchemaError(f"{f.name} is no boolean")
    return df.where(F.col(f.name)).drop(f.name)


def where_row(df: DataFrame, predicate: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Rows that a Python predicate of a pandas DataFrame holds for: in Arrow batches, for what no expression says."""
    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            yield b[predicate(b).fillna(False).astype(bool)]

    return df.mapInPandas(run, df.schema)


def transform(df: DataFrame, of: str, function: Callable[[Column], Column] | Callable, kind: str | None = None, to: str | None = None) -> DataFrame:
    """A column through a function: of Columns without a kind; else of Python values, null in and null out."""
    name = field(df, of).name
    if kind is None:
        return df.withColumn(to or name, F.when(F.col(name).isNotNull(), function(F.col(name))))
    mapped = F.pandas_udf(_over_values(function), kind)
    return df.withColumn(to or name, mapped(F.col(name)))


def _over_values(function: Callable) -> Callable:
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or v != v else function(v) for v in values.astype(object).where(values.notna(), None)], index=values.index, dtype=object)

    return run


def zip_columns(df: DataFrame, a: str, b: str, function: Callable, to: str, kind: str | None = None) -> DataFrame:
    """Two columns through a function, null if either is: of Columns without a kind, else of Python values."""
    x, y = field(df, a).name, field(df, b).name
    require_free(df, to)
    if kind is None:
        return df.withColumn(to, F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), function(F.col(x), F.col(y))))

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        both = left.notna() & right.notna()
        return pd.Series([function(v, w) if ok else None for v, w, ok in zip(left, right, both, strict=True)], dtype=object)

    return df.withColumn(to, F.pandas_udf(run, kind)(F.col(x), F.col(y)))


def with_computed(df: DataFrame, to: str, columns: Sequence[str], function: Callable[..., Column]) -> DataFrame:
    """A new column of a function of Columns; null if one of them is."""
    require_free(df, to)
    names = require(df, list(columns))
    known = F.lit(True)
    for n in names:
        known = known & F.col(n).isNotNull()
    return df.withColumn(to, F.when(known, function(*(F.col(n) for n in names))))


def fill_null(df: DataFrame, of: str, value: object) -> DataFrame:
    f = field(df, of)
    return df.withColumn(f.name, F.coalesce(F.col(f.name), F.lit(value).cast(f.dataType)))


def drop_nulls(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=require(df, list(columns)) if columns else None)


def null_counts(df: DataFrame) -> DataFrame:
    """One row: how many nulls each column has."""
    return df.agg(*(F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(c) for c in df.columns))


def null_positions(df: DataFrame, of: str, order: str) -> DataFrame:
    """The order column's values of the rows where `of` is null."""
    return df.where(F.col(field(df, of).name).isNull()).select(order)

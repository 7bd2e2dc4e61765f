"""Scores of row vectors: an array column, or several numeric columns taken as one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import SchemaError, TypeMismatch
from quillon.types import field, require


def as_vector(df: DataFrame, columns: str | Sequence[str]) -> Column:
    """An array column as it is; a list of numeric columns as an array of doubles, null if one of them is."""
    if isinstance(columns, str):
        f = field(df, columns)
        if not isinstance(f.dataType, T.ArrayType):
            raise TypeMismatch(f"{f.name} is no array")
        return F.col(f.name).cast("array<double>")
    names = require(df, list(columns))
    if any(not isinstance(field(df, n).dataType, T.NumericType) for n in names):
        raise TypeMismatch("vectors are made of numbers")
    return F.array(*(F.col(n).cast("double") for n in names))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)  # a null element makes the sum null


def _query(query: Sequence[float | None]) -> Column:
    return F.array(*(F.lit(None if q is None else float(q)).cast("double") for q in query))


def dot(vector: Column, query: Sequence[float | None]) -> Column:
    """Null where the row or the query has a null. Widths that differ are an error of the row."""
    width = F.size(vector) == len(query)
    return F.when(width, _sum(F.zip_with(vector, _query(query), lambda a, b: a * b))).when(vector.isNotNull(), F.raise_error(F.lit(f"a vector isn't {len(query)} wide")).cast("double"))


def norm(vector: Column) -> Column:
    return F.sqrt(_sum(F.transform(vector, lambda a: a * a)))


def cosine(vector: Column, query: Sequence[float | None]) -> Column:
    """dot / (norms' product); not a number for a zero vector."""
    if not len(query):
        raise SchemaError("a query needs at least one value")
    if any(q is None for q in query):
        return F.lit(None).cast("double")
    size = sum(float(q) ** 2 for q in query) ** 0.5
    below = norm(vector) * F.lit(size)
    return F.when(below == 0, F.lit(float("nan"))).otherwise(dot(vector, query) / F.when(below != 0, below))


def row_dot(df: DataFrame, columns: str | Sequence[str], query: Sequence[float | None], to: str = "score") -> DataFrame:
    return df.withColumn(to, dot(as_vector(df, columns), query))


def row_cosine(df: DataFrame, columns: str | Sequence[str], query: Sequence[float | None], to: str = "score") -> DataFrame:
    return df.withColumn(to, cosine(as_vector(df, columns), query))


def row_norms(df: DataFrame, columns: str | Sequence[str], to: str = "norm") -> DataFrame:
    return df.withColumn(to, norm(as_vector(df, columns)))


def search(df: DataFrame, columns: str | Sequence[str], query: Sequence[float], k: int, label: str, to: str = "score") -> DataFrame:
    """The k rows most like the query by cosine, ties by label: one TakeOrderedAndProject, no shuffle of all rows."""
    scored = row_cosine(df, columns, query, to).where(F.col(to).isNotNull() & ~F.isnan(to))
    return scored.orderBy(F.col(to).desc(), F.col(label)).limit(k)


def matmul(left: DataFrame, right: DataFrame) -> DataFrame:
    """Matrices as (row, col, value): the product in the same form, by a join on the inner index."""
    a = left.select(F.col("row"), F.col("col").alias("k"), F.col("value").alias("a"))
    b = right.select(F.col("row").alias("k"), F.col("col"), F.col("value").alias("b"))
    return a.join(b, "k").groupBy("row", "col").agg(F.sum(F.col("a") * F.col("b")).alias("value"))


def transpose(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def embed(df: DataFrame, text_col: str, function: object, to: str = "embedding") -> DataFrame:
    """A column of vectors that a function makes of a pandas Series of texts, in Arrow batches."""
    make = F.pandas_udf(function, "array<float>")
    return df.withColumn(to, make(F.col(text_col)))


def as_rows(df: DataFrame, columns: Sequence[str], to: str = "vector") -> DataFrame:
    """Number columns packed into one of arrays; they go, the others stay."""
    packed = F.array(*(F.col(f"`{c}`").cast("double") for c in columns))
    return df.withColumn(to, packed).drop(*(c for c in columns if c != to))


def flattened(df: DataFrame, vector: str, names: Sequence[str]) -> DataFrame:
    """The other way round: a column for each place of an array, null beyond its end."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c != vector), *(F.get(vector, F.lit(i)).alias(n) for i, n in enumerate(names)))

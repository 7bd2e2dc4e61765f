"""Type rules: numeric promotion, and schemas that are compared exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillon.errors import ColumnNotFound, SchemaError, TypeMismatch

_SMALL = (T.ByteType, T.ShortType, T.IntegerType)


def is_integral(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


def promote(a: T.DataType, b: T.DataType) -> T.DataType:
    """The common type of two operands: small integers meet in int, float beats long, decimals meet floats in double."""
    if not (isinstance(a, T.NumericType) and isinstance(b, T.NumericType)):
        if a == b:
            return a
        raise TypeMismatch(f"{a.simpleString()} and {b.simpleString()} have no common type")
    kinds = (a, b)
    decimals = [t for t in kinds if isinstance(t, T.DecimalType)]
    floats = [t for t in kinds if isinstance(t, (T.FloatType, T.DoubleType))]
    if decimals:
        return T.DoubleType() if floats else T.DecimalType(38, max(t.scale for t in decimals))
    if any(isinstance(t, T.DoubleType) for t in kinds):
        return T.DoubleType()
    if floats:
        return T.FloatType()
    return T.LongType() if any(isinstance(t, T.LongType) for t in kinds) else T.IntegerType()


def sum_type(t: T.DataType) -> T.DataType:
    """What a sum comes in: long for integers, double for floats, a decimal as it was."""
    if is_integral(t):
        return T.LongType()
    return t if isinstance(t, T.DecimalType) else T.DoubleType()


def field(df: DataFrame, name: str) -> T.StructField:
    """The column by name, in any case."""
    for f in df.schema.fields:
        if f.name.lower() == name.lower():
            return f
    raise ColumnNotFound(name, df.columns)


def require(df: DataFrame, names: list[str] | tuple[str, ...]) -> list[str]:
    """The names as the frame spells them; at least one."""
    if not names:
        raise SchemaError("name at least one column")
    return [field(df, n).name for n in names]


def require_free(df: DataFrame, name: str) -> None:
    if not name or not name.strip():
        raise SchemaError("a column needs a name")
    if name.lower() in {c.lower() for c in df.columns}:
        raise SchemaError(f"there is a column {name!r} already")


def require_unique(names: list[str]) -> None:
    low = [n.lower() for n in names]
    if len(set(low)) < len(low):
        raise SchemaError(f"repeated column names: {', '.join(sorted({n for n in names if low.count(n.lower()) > 1}))}")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]

"""Rolling, cumulative, shifted and ranked columns. Each appends one column under a free name.

Rows have no order of their own, so each takes one: `order`, names of columns that together are
unique. With `partition`, Spark's windows do the work. Without it all rows are one sequence, which no
task should sort alone: rows are numbered (rows.numbered, which starts a job) and cut into blocks of
neighbours. Rolling and shifted columns see the few rows before and after their block as well;
cumulative columns are worked out in each block and joined with what stands before it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from decimal import Decimal
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import OrderError, SchemaError, TypeMismatch
from quillon.operators.rows import numbered
from quillon.types import field, require, require_free

#: Rows that one task puts in order.
BLOCK = 1 << 16
Names = str | Sequence[str]


def _names(names: Names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def _over(df: DataFrame, order: Names, partition: Names = ()) -> WindowSpec:
    if not _names(order):
        raise OrderError("name the columns that order the rows")
    keys = [F.col(c).asc_nulls_last() for c in require(df, _names(order))]
    return Window.partitionBy(*_names(partition)).orderBy(*keys)


def _number(df: DataFrame, of: str) -> tuple[Column, T.DataType]:
    f = field(df, of)
    if not isinstance(f.dataType, T.NumericType):
        raise TypeMismatch(f"{f.name} is {f.dataType.simpleString()}, no number")
    return F.col(f.name), f.dataType


def _with_neighbours(df: DataFrame, order: Names, before: int, after: int) -> tuple[DataFrame, WindowSpec]:
    """df in blocks, each with copies of the rows next to it; copies have __own false. And the window over a block."""
    block = max(BLOCK, 4 * (before + after))
    out = numbered(df, _order(order), "__n")
    own, place = F.floor(F.col("__n") / block), F.col("__n") % block
    blocks = F.array_compact(F.array(own, F.when(place >= block - before, own + 1), F.when((place < after) & (own > 0), own - 1)))
    out = out.withColumn("__block", F.explode(blocks)).withColumn("__own", F.col("__block") == own)
    return out, Window.partitionBy("__block").orderBy("__n")


def _order(order: Names) -> list[str]:
    if not _names(order):
        raise OrderError("name the columns that order the rows")
    return _names(order)


def rolling(df: DataFrame, function: str, of: str, to: str, size: int, order: Names, min_periods: int | None = None, null_value: object = None, partition: Names = ()) -> DataFrame:
    """sum, mean, min or max of this row and the size - 1 before it.

    Null unless min_periods values are there: size of them, or 1 with a null_value, which stands for nulls. mean is
    double, the others keep the column's type.
    """
    if size < 1 or (min_periods is not None and not 1 <= min_periods <= size):
        raise SchemaError("a window has at least a row, and min_periods from 1 to its size")
    require_free(df, to)
    value, kind = _number(df, of)
    if null_value is not None:
        value = F.coalesce(value, F.lit(null_value).cast(kind))
    columns, out = df.columns, df
    if _names(partition):
        w = _over(df, order, partition)
    else:
        out, w = _with_neighbours(df, order, size - 1, 0)
    w = w.rowsBetween(1 - size, 0)
    made = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[function](value).over(w)
    least = min_periods or (1 if null_value is not None else size)
    out = out.withColumn(to, F.when(F.count(value).over(w) >= least, made).cast("double" if function == "mean" else kind))
    return out if _names(partition) else out.where("__own").select(*(F.col(f"`{c}`") for c in [*columns, to]))


def _so_far(df: DataFrame, value: Column, function: str, order: Names, to: str) -> DataFrame:
    """df with a column `to`: sum, min, max, product, count or last of the values so far, nulls passed over, block by block."""
    made = {"sum": F.sum, "min": F.min, "max": F.max, "product": F.product, "count": F.count, "last": lambda c: F.last(c, ignorenulls=True)}[function]
    whole = F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("__n"))) if function == "last" else made("__v")
    again = {"count": F.sum}.get(function, made)
    both = {"sum": lambda a, b: F.coalesce(a + b, a, b), "count": lambda a, b: F.coalesce(a, F.lit(0)) + b, "min": F.least, "max": F.greatest, "product": lambda a, b: F.coalesce(a * b, a, b), "last": lambda a, b: F.coalesce(b, a)}[function]
    blocks = numbered(df.withColumn("__v", value), _order(order), "__n").withColumn("__block", F.floor(F.col("__n") / BLOCK))
    inside = made("__v").over(Window.partitionBy("__block").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0))
    totals = blocks.groupBy("__block").agg(whole.alias("__whole"))  # a row for BLOCK rows: what one task can put in order
    before = totals.select("__block", again("__whole").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    met = blocks.withColumn("__inside", inside).join(before, "__block")
    return met.select(*(F.col(f"`{c}`") for c in df.columns), both(F.col("__before"), F.col("__inside")).alias(to))


def _times(a: int, b: int) -> int:
    """The product, kept at 2 ** 63 in size at most: beyond that only a zero changes anything."""
    return max(-(1 << 63), min(1 << 63, a * b))


def _exact_products(df: DataFrame, value: Column, order: Names, to: str, partition: Names) -> DataFrame:
    """df with the product so far of integers, to the last digit; one that doesn't fit a long is an error."""
    names, kind = _names(partition), "decimal(20,0)"
    blocks = (numbered(df, _order(order), "__n") if not names else df.withColumn("__n", F.row_number().over(_over(df, order, names)) - 1)).withColumn("__v", value.cast("long"))
    blocks = blocks.withColumn("__block", F.floor(F.col("__n") / BLOCK))

    def running(values: Iterable[int | None], start: int = 1) -> list[Decimal]:
        out, now = [], start
        for v in values:
            now = now if v is None else _times(now, int(v))
            out.append(Decimal(now))
        return out

    def inside(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("__n")
        return rows.append_column("__inside", pa.array(running(rows.column("__v").to_pylist()), pa.decimal128(20)))

    def ahead(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("__block")
        before = [Decimal(1), *running(int(x) for x in rows.column("__whole").to_pylist())][:-1]
        return rows.drop_columns("__whole").append_column("__before", pa.array(before, pa.decimal128(20)))

    made = blocks.groupBy(*names, "__block").applyInArrow(inside, T.StructType([*blocks.schema.fields, T.StructField("__inside", T.DecimalType(20))]))
    totals = made.groupBy(*names, "__block").agg(F.max_by("__inside", "__n").alias("__whole"))
    schema = T.StructType([*totals.schema.fields[:-1], T.StructField("__before", T.DecimalType(20))])
    starts = totals.groupBy(*names).applyInArrow(ahead, schema) if names else totals.withColumn("__one", F.lit(1)).groupBy("__one").applyInArrow(lambda t: ahead(t.drop_columns("__one")), schema)
    same = reduce(and_, [F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for n in [*names, "__block"]])
    product = F.col("__before") * F.col("__inside")
    fits = F.when(F.abs(product) < F.lit(Decimal(1 << 63)), product.cast("long")).otherwise(F.raise_error(F.lit(f"a product in {to} doesn't fit a long")).cast("long"))
    met = made.alias("l").join(starts.alias("r"), same)
    return met.select(*(F.col(f"l.`{c}`") for c in df.columns), fits.alias(to))


def cumulative(df: DataFrame, function: str, of: str, to: str, order: Names, null_value: object = None, partition: Names = ()) -> DataFrame:
    """sum, min, max or product so far, in the column's type; null where the value is null, which the next rows pass over.

    Products of integers are exact.
    """
    require_free(df, to)
    value, kind = _number(df, of)
    if null_value is not None:
        value = F.coalesce(value, F.lit(null_value).cast(kind))
    if function == "product" and isinstance(kind, T.IntegralType):
        out = _exact_products(df, value, order, to, partition)
    elif not _names(partition):
        out = _so_far(df, value, function, order, to)
    else:
        w = _over(df, order, partition).rowsBetween(Window.unboundedPreceding, 0)
        out = df.withColumn(to, {"sum": F.sum, "min": F.min, "max": F.max, "product": F.product}[function](value).over(w))
    return out.withColumn(to, F.when(value.isNotNull(), F.col(f"`{to}`")).cast(kind))


def cumulative_count(df: DataFrame, of: str, to: str, order: Names, partition: Names = ()) -> DataFrame:
    require_free(df, to)
    value = F.col(f"`{field(df, of).name}`")
    if _names(partition):
        out = df.withColumn(to, F.count(value).over(_over(df, order, partition).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        out = _so_far(df, value, "count", order, to)
    return out.withColumn(to, F.when(value.isNotNull(), F.col(f"`{to}`")))


def cumulative_sum_global(df: DataFrame, of: str, to: str, order: Names) -> DataFrame:
    """The running sum over all rows: cumulative without a partition, which never sorts them in one task."""
    return cumulative(df, "sum", of, to, order)


def shift(df: DataFrame, of: str, to: str, periods: int, order: Names, fill: object = None, partition: Names = ()) -> DataFrame:
    """The value `periods` rows before, or after if negative; beyond the ends fill, else null."""
    require_free(df, to)
    name, columns, out = field(df, of).name, df.columns, df
    if _names(partition):
        w = _over(df, order, partition)
    else:
        out, w = _with_neighbours(df, order, max(periods, 0), max(-periods, 0))
    made = F.lag(name, periods, fill) if periods >= 0 else F.lead(name, -periods, fill)
    out = out.withColumn(to, made.over(w))
    return out if _names(partition) else out.where("__own").select(*(F.col(f"`{c}`") for c in [*columns, to]))


def lead(df: DataFrame, of: str, to: str, periods: int, order: Names, fill: object = None, partition: Names = ()) -> DataFrame:
    return shift(df, of, to, -periods, order, fill, partition)


def rank(df: DataFrame, function: str, to: str, order_by: Names, partition: Names = (), ties: Names = ()) -> DataFrame:
    """row_number, rank, dense_rank or percent_rank by order_by; a row with a null among these keys has none and isn't counted.

    row_number takes ties by the columns in ties.
    """
    require_free(df, to)
    keys = require(df, _names(order_by))
    nulls = F.lit(False)
    for k in keys:
        nulls = nulls | F.col(k).isNull()
    order = [F.col(k).asc() for k in [*keys, *(_names(ties) if function == "row_number" else [])]]
    w = Window.partitionBy(*_names(partition), nulls).orderBy(*order)
    return df.withColumn(to, F.when(~nulls, getattr(F, function)().over(w)).cast("double" if function == "percent_rank" else "long"))


def row_number(df: DataFrame, to: str, order: Names, partition: Names = ()) -> DataFrame:
    """Numbers of the rows in their order, nulls in it last."""
    require_free(df, to)
    if not _names(partition):
        return numbered(df, _order(order), to).withColumn(to, F.col(f"`{to}`") + 1)
    return df.withColumn(to, F.row_number().over(_over(df, order, partition)).cast("long"))


def fill(df: DataFrame, of: str, order: Names, forward: bool = True, partition: Names = (), strict: bool = False) -> DataFrame:
    """Nulls take the last value before them (or the next after them). strict: it is an error if there is none."""
    name = field(df, of).name
    if _names(partition):
        w = _over(df, order, partition)
        made = F.last(name, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if forward else F.first(name, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    elif forward:
        df, made = _so_far(df, F.col(f"`{name}`"), "last", order, "__filled"), F.col("__filled")
    else:
        back = numbered(df, _order(order), "__place").withColumn("__place", -F.col("__place"))
        df, made = _so_far(back, F.col(f"`{name}`"), "last", "__place", "__filled").drop("__place"), F.col("__filled")
    if strict:
        made = F.coalesce(made, F.raise_error(F.lit(f"nothing to fill {name} with")).cast(df.schema[name].dataType))
    return df.withColumn(name, made).drop("__filled")

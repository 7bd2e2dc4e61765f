"""Order and position: sorting, slices, rows by number, top-k, concatenation, splits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.errors import OrderError, QuillonError, SchemaError, TypeMismatch
from quillon.functions.expressions import Expr
from quillon.sources.scratch import written
from quillon.types import field, require, require_unique


@dataclass(frozen=True)
class SortKey:
    """Where nulls go doesn't depend on the direction; they are last unless nulls_first."""

    of: str | Expr
    ascending: bool = True
    nulls_first: bool = False

    def column(self, df: DataFrame) -> Column:
        c = F.col(field(df, self.of).name) if isinstance(self.of, str) else self.of.bind(df.schema)
        return getattr(c, f"{'asc' if self.ascending else 'desc'}_nulls_{'first' if self.nulls_first else 'last'}")()


def sort(df: DataFrame, *keys: str | Expr | SortKey, stable_by: Sequence[str] = ()) -> DataFrame:
    """By the keys in turn; ties by stable_by, without which equal rows stand in any order."""
    if not keys:
        raise SchemaError("sort by at least one key")
    made = [k if isinstance(k, SortKey) else SortKey(k) for k in keys]
    return df.orderBy(*(k.column(df) for k in made), *(F.col(c).asc_nulls_last() for c in stable_by))


def _ordered(df: DataFrame, order: str | Sequence[str]) -> DataFrame:
    names = [order] if isinstance(order, str) else list(order)
    if not names:
        raise OrderError("name the columns that order the rows")
    return df.orderBy(*(F.col(c).asc_nulls_last() for c in require(df, names)))


def take(df: DataFrame, n: int, order: str | Sequence[str]) -> DataFrame:
    return slice_(df, 0, n, order)


def skip(df: DataFrame, n: int, order: str | Sequence[str]) -> DataFrame:
    """All but the first n rows in order; starts a job (numbered)."""
    if n < 0:
        raise SchemaError("a number of rows isn't negative")
    return numbered(df, order, "__row").where(F.col("__row") >= n).drop("__row")


def slice_(df: DataFrame, start: int, length: int, order: str | Sequence[str], strict: bool = False) -> DataFrame:
    """length rows from start on, fewer at the end; strict: that is an error."""
    if start < 0 or length < 0:
        raise SchemaError("a number of rows isn't negative")
    if strict and (n := df.count()) < start + length:
        raise QuillonError(f"rows {start} to {start + length} of {n}")
    out = _ordered(df, order)
    return (out.offset(start) if start else out).limit(length)


def numbered(df: DataFrame, order: str | Sequence[str], to: str = "row_id") -> DataFrame:
    """df with the number of each row in order, from 0, without sorting all rows in one task.

    Starts a job: rows are range-partitioned, sorted and written to shared storage with their partition and place, since
    sampled ranges mustn't change between two uses. What is added up before each partition are the partitions' sizes
    alone. The order has to be unique.
    """
    names = require(df, [order] if isinstance(order, str) else list(order))
    keys = [F.col(f"`{c}`").asc_nulls_last() for c in names]
    dealt = written(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    return _added_up(dealt, df.columns, to)


def numbered_as_sorted(df: DataFrame, to: str = "row_id") -> DataFrame:
    """A sorted frame with the number of each row, from 0: Spark's sort stands, and each partition adds the sizes before it. Starts a job."""
    return _added_up(written(df.withColumn("__at", F.monotonically_increasing_id()), "sorted"), df.columns, to)


def _added_up(dealt: DataFrame, columns: Sequence[str], to: str) -> DataFrame:
    """Numbers from __at, a partition and a place in it."""
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__part", before.alias("__before")))  # a row a partition
    return dealt.join(starts, part == F.col("__part")).select(*(F.col(f"`{c}`") for c in columns), (F.col("__before") + inside).alias(to))


def select_rows(df: DataFrame, positions: Sequence[int], order: str | Sequence[str], strict: bool = True) -> DataFrame:
    """The rows at these places of the order, as listed, repeats included; strict: a place beyond the end is an error.

    Only the rows up to the last place are ordered.
    """
    if any(p < 0 for p in positions):
        raise SchemaError("a place isn't negative")
    if not positions:
        return df.limit(0)
    if strict and df.limit(max(positions) + 1).count() <= max(positions):
        raise QuillonError(f"no row {max(positions)}")
    names = [order] if isinstance(order, str) else list(order)
    head = take(df, max(positions) + 1, names)
    place = head.withColumn("__at", F.row_number().over(Window.orderBy(*(F.col(c).asc_nulls_last() for c in require(df, names)))) - 1)
    wanted = df.sparkSession.createDataFrame(list(enumerate(positions)), "__nth int, __want int")
    return place.join(F.broadcast(wanted), F.col("__at") == F.col("__want")).orderBy("__nth").select(df.columns)  # as many as the caller lists


def reorder(df: DataFrame, positions: Sequence[int], order: str | Sequence[str]) -> DataFrame:
    """select_rows with a permutation of all places."""
    if sorted(positions) != list(range(df.count())):
        raise SchemaError("no permutation of the rows")
    return select_rows(df, positions, order)


def top_k(df: DataFrame, of: str, k: int, label: str, largest: bool = True) -> DataFrame:
    """The k rows with the largest values, nulls left out, ties by label."""
    name = field(df, of).name
    order = F.col(name).desc() if largest else F.col(name).asc()
    return df.where(F.col(name).isNotNull()).orderBy(order, F.col(label)).limit(k)


def arg_sort(df: DataFrame, of: str, order: str, descending: bool = False) -> DataFrame:
    """The order column's values, sorted by `of`, nulls last, ties in order; `place` says where each stands."""
    name = field(df, of).name
    key = F.struct(F.col(name).isNull().alias("null"), F.col(name).alias("value"))
    if not descending:
        return numbered(df.select(F.col(order), key.alias("__key")), ["__key", order], "place").select(order, "place")
    # the other way round, ties first: from the end, numbers descend with the key and ascend with the order
    first = numbered(df.select(F.col(order), F.col(name).alias("__value")).where(F.col(name).isNotNull()), ["__value", order], "__n")
    ties = first.groupBy("__value").agg(F.min("__n").alias("__low"), F.max("__n").alias("__high"))
    met = first.join(ties, "__value")
    known = df.where(F.col(name).isNotNull()).count()
    out = met.select(F.col(order), (F.lit(known - 1) - F.col("__high") + F.col("__n") - F.col("__low")).alias("place"))
    rest = numbered(df.where(F.col(name).isNull()).select(order), order, "__n")
    return out.unionByName(rest.select(F.col(order), (F.col("__n") + known).alias("place")))


# --- concatenation --------------------------------------------------------------------------------


def concat_rows(frames: Sequence[DataFrame], fill: bool = True) -> DataFrame:
    """Rows of all frames by column name, in any case; fill: a missing column is null, else it is an error."""
    if not frames:
        raise SchemaError("nothing to put together")
    kinds: dict[str, tuple[str, object]] = {}
    for f in frames:
        for c in f.schema.fields:
            name, kind = kinds.setdefault(c.name.lower(), (c.name, c.dataType))
            if kind != c.dataType:
                raise TypeMismatch(f"{name} is {kind.simpleString()} and {c.dataType.simpleString()}")
    if not fill and any(len(f.columns) < len(kinds) for f in frames):
        raise SchemaError("a column is missing")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill), frames)


def concat_columns(frames: Sequence[DataFrame], orders: Sequence[str | Sequence[str]]) -> DataFrame:
    """Frames side by side, row by row in their orders; equal numbers of rows and different names."""
    require_unique([c for f in frames for c in f.columns])
    sizes = {f.count() for f in frames}
    if len(sizes) > 1:
        raise SchemaError(f"numbers of rows differ: {sorted(sizes)}")
    out = None
    for f, order in zip(frames, orders, strict=True):
        now = numbered(f, order, "__row")
        out = now if out is None else out.join(now, "__row")
    return out.drop("__row")


# --- splits and scaling ---------------------------------------------------------------------------


def train_test_split(df: DataFrame, order: str, ratio: float = 0.8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Two parts of exact sizes that a key and a seed always split the same way.

    The cut is a hash value; which one is found by counting rows in 4096 bins of the hash and ranking one bin alone.
    """
    if not 0 < ratio < 1:
        raise SchemaError("a ratio lies between 0 and 1")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(field(df, order).name).cast("string"), F.lit("null")))
    spread = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")  # 60 bits
    bin_ = F.shiftright(spread, 48)
    counts = {r["__b"]: r["n"] for r in df.groupBy(bin_.alias("__b")).agg(F.count("*").alias("n")).collect()}  # 4096 at most
    want, before, cut = int(sum(counts.values()) * ratio), 0, None
    for b in sorted(counts):
        if before + counts[b] > want:
            cut = b
            break
        before += counts[b]
    if cut is None:
        return df, df.limit(0)
    w = Window.partitionBy("__b").orderBy("__h", order)
    marked = df.withColumn("__h", spread).withColumn("__b", bin_)
    edge = marked.where(F.col("__b") == cut).withColumn("__nth", F.row_number().over(w))
    inner = marked.withColumn("__nth", F.when(F.col("__b") < cut, 0).otherwise(F.lit(want - before + 1)))
    both = inner.where(F.col("__b") != cut).unionByName(edge)
    first = F.col("__nth") <= want - before
    return tuple(both.where(p).drop("__h", "__b", "__nth") for p in (first, ~first))


def normalize(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(x - mean) / population deviation over the values that aren't null; a column of one value stays as it is.

    Integers become double. Mean and deviation come from one aggregate of one row, which is broadcast.
    """
    from quillon.types import numeric_columns

    names = require(df, list(columns)) if columns else numeric_columns(df)
    for n in names:
        if n not in numeric_columns(df):
            raise TypeMismatch(f"{n} is no number")
    stats = df.agg(*(F.avg(n).alias(f"__m{i}") for i, n in enumerate(names)), *(F.stddev_pop(n).alias(f"__s{i}") for i, n in enumerate(names)))
    met = df.join(F.broadcast(stats))
    for i, n in enumerate(names):
        kind = "float" if df.schema[n].dataType.typeName() == "float" else "double"
        flat = F.coalesce(F.col(f"__s{i}"), F.lit(0.0)) == 0
        scaled = F.when(flat, F.col(n).cast("double")).otherwise((F.col(n) - F.col(f"__m{i}")) / F.when(~flat, F.col(f"__s{i}")))
        met = met.withColumn(n, scaled.cast(kind))
    return met.select(df.columns)

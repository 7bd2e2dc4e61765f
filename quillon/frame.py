"""Frame: an immutable facade over a DataFrame that knows the order of its rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import OrderError, QuillonError, SchemaError, TypeMismatch
from quillon.functions import vectors
from quillon.functions.expressions import Expr
from quillon.operators import aggregates, columns, joins, rows, windows
from quillon.types import field, numeric_columns, require_unique


class Frame:
    """Methods return new frames and start no job; to_* methods and checks that are said to count rows do.

    order names columns that together are unique; positional methods need it.
    """

    def __init__(self, df: DataFrame, order: str | Sequence[str] = (), sort_keys: Sequence[rows.SortKey] = ()) -> None:
        if not df.columns:
            raise SchemaError("a frame has one column at least")
        require_unique(df.columns)
        self.df, self.order, self.sort_keys = df, ((order,) if isinstance(order, str) else tuple(order)), tuple(sort_keys)

    # making frames
    @classmethod
    def create(cls, spark: SparkSession, data: Sequence[Sequence], schema: str | T.StructType, numbered: bool = True) -> Frame:
        """Rows that the driver holds; numbered adds a column row_id, which orders them."""
        df = spark.createDataFrame(list(data), schema)
        if not numbered:
            return cls(df)
        kind = T.StructType([*df.schema.fields, T.StructField("row_id", T.LongType(), False)])
        return cls(spark.createDataFrame([(*r, i) for i, r in enumerate(data)], kind), "row_id")

    @classmethod
    def from_rows(cls, spark: SparkSession, labelled: Sequence[tuple[str, Sequence[float]]], names: Sequence[str] | None = None, label: str = "Label") -> Frame:
        """A label and a column for each place of the vectors: Col_0, Col_1 .. unless named."""
        widths = {len(v) for _, v in labelled}
        if len(widths) != 1:
            raise SchemaError("vectors of one width, and one row at least")
        names = list(names) if names else [f"Col_{i}" for i in range(widths.pop())]
        schema = T.StructType([T.StructField(label, T.StringType()), *(T.StructField(n, T.DoubleType()) for n in names)])
        return cls.create(spark, [(k, *map(float, v)) for k, v in labelled], schema)

    @classmethod
    def from_matrix(cls, spark: SparkSession, matrix: np.ndarray, names: Sequence[str] | None = None, labels: Sequence[str] | None = None, label: str = "Label") -> Frame:
        return cls.from_rows(spark, list(zip(labels or map(str, range(len(matrix))), matrix.tolist(), strict=True)), names, label)

    @classmethod
    def from_arrow(cls, spark: SparkSession, table: pa.Table, order: str | Sequence[str] = ()) -> Frame:
        return cls(spark.createDataFrame(table), order)

    def _next(self, df: DataFrame) -> Frame:
        kept = self.order if all(o in df.columns for o in self.order) else ()
        return Frame(df, kept)

    def _order(self) -> tuple[str, ...]:
        if not self.order:
            raise OrderError("give the frame an order first: frame.ordered(...)")
        return self.order

    def ordered(self, *order: str) -> Frame:
        return Frame(self.df, order)

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    # columns
    def select(self, *of: str | Expr, names: Sequence[str] | None = None) -> Frame:
        return self._next(columns.select(self.df, *of, names=names))

    def select_and_rename(self, mapping: dict[str, str | None]) -> Frame:
        return self._next(columns.select_and_rename(self.df, mapping))

    def rename(self, **mapping: str) -> Frame:
        return Frame(columns.rename(self.df, mapping), [mapping.get(o, o) for o in self.order])

    def exclude(self, *names: str) -> Frame:
        return self._next(columns.exclude(self.df, *names))

    def with_column(self, name: str, of: Expr) -> Frame:
        return self._next(columns.with_column(self.df, name, of))

    def with_computed(self, to: str, of: Sequence[str], function: Callable) -> Frame:
        return self._next(columns.with_computed(self.df, to, of, function))

    def transform(self, of: str, function: Callable, kind: str | None = None, to: str | None = None) -> Frame:
        return self._next(columns.transform(self.df, of, function, kind, to))

    def zip(self, a: str, b: str, function: Callable, to: str, kind: str | None = None) -> Frame:
        return self._next(columns.zip_columns(self.df, a, b, function, to, kind))

    def fill_null(self, of: str, value: object) -> Frame:
        return self._next(columns.fill_null(self.df, of, value))

    def fill_forward(self, of: str, strict: bool = True) -> Frame:
        return self._next(windows.fill(self.df, of, self._order(), True, strict=strict))

    def fill_backward(self, of: str, strict: bool = True) -> Frame:
        return self._next(windows.fill(self.df, of, self._order(), False, strict=strict))

    def drop_nulls(self, *names: str) -> Frame:
        return self._next(columns.drop_nulls(self.df, *names))

    def normalize(self, *names: str) -> Frame:
        return self._next(rows.normalize(self.df, names or None))

    # rows
    def filter(self, condition: Expr) -> Frame:
        return self._next(columns.filter_(self.df, condition))

    where = filter

    def filter_by_mask(self, mask: str) -> Frame:
        return self._next(columns.filter_by_mask(self.df, mask))

    def where_row(self, predicate: Callable) -> Frame:
        return self._next(columns.where_row(self.df, predicate))

    def sort(self, *keys: str | Expr | rows.SortKey) -> Frame:
        made = [k if isinstance(k, rows.SortKey) else rows.SortKey(k) for k in keys]
        return Frame(rows.sort(self.df, *made, stable_by=self.order), self.order, made)

    def then_by(self, *keys: str | Expr | rows.SortKey) -> Frame:
        """More keys for the sort before; all of them make one sort."""
        if not self.sort_keys:
            raise QuillonError("nothing is sorted yet")
        return self.sort(*self.sort_keys, *keys)


    def take(self, n: int) -> Frame:
        return self.slice(0, n)

    def skip(self, n: int) -> Frame:
        if self.sort_keys:
            return Frame(rows.sort(self.df, *self.sort_keys, stable_by=self.order).offset(n), self.order, self.sort_keys)
        return self._next(rows.skip(self.df, n, self._order()))

    def slice(self, start: int, length: int, strict: bool = False) -> Frame:
        if self.sort_keys:
            if start < 0 or length < 0:
                raise SchemaError("a number of rows isn't negative")
            return Frame(rows.sort(self.df, *self.sort_keys, stable_by=self.order).offset(start).limit(length), self.order, self.sort_keys)
        return self._next(rows.slice_(self.df, start, length, self._order(), strict))

    def select_rows(self, *positions: int) -> Frame:
        return self._next(rows.select_rows(self.df, positions, self._order()))

    def reorder(self, positions: Sequence[int]) -> Frame:
        return self._next(rows.reorder(self.df, positions, self._order()))

    def distinct(self, *names: str) -> Frame:
        return self._next(aggregates.distinct(self.df, names, self._order() if names else ()))

    def train_test_split(self, ratio: float = 0.8, seed: int = 0) -> tuple[Frame, Frame]:
        return tuple(self._next(p) for p in rows.train_test_split(self.df, self._order()[0], ratio, seed))

    # several frames
    def join(self, other: Frame, keys: str | Sequence, how: str = "inner", **options: str) -> Frame:
        return self._next(joins.join(self.df, other.df, keys, how, **options))

    def concat(self, *others: Frame, fill: bool = False) -> Frame:
        return Frame(rows.concat_rows([self.df, *(o.df for o in others)], fill))

    append = concat

    def combine(self, *others: Frame) -> Frame:
        return self._next(rows.concat_columns([f.df for f in (self, *others)], [f._order() for f in (self, *others)]))

    # groups and windows
    def group_by(self, *keys: str | Expr, agg: Sequence[aggregates.Aggregate] | dict[str, str] = ()) -> Frame:
        return Frame(aggregates.group_by_dict(self.df, list(keys), agg) if isinstance(agg, dict) else aggregates.group_by(self.df, list(keys), agg))

    def rolling(self, function: str, of: str, to: str, size: int, **options: Any) -> Frame:
        return self._next(windows.rolling(self.df, function, of, to, size, self._order(), **options))

    def cumulative(self, function: str, of: str, to: str, **options: Any) -> Frame:
        if function == "count":
            return self._next(windows.cumulative_count(self.df, of, to, self._order(), **options))
        return self._next(windows.cumulative(self.df, function, of, to, self._order(), **options))

    def shift(self, of: str, to: str, periods: int, fill: object = None) -> Frame:
        return self._next(windows.shift(self.df, of, to, periods, self._order(), fill))

    def lead(self, of: str, to: str, periods: int, fill: object = None) -> Frame:
        return self._next(windows.lead(self.df, of, to, periods, self._order(), fill))

    def row_number(self, to: str, order_by: str | Sequence[str] = (), partition: str | Sequence[str] = ()) -> Frame:
        if not order_by:
            return self._next(windows.row_number(self.df, to, self._order(), partition))
        return self._next(windows.rank(self.df, "row_number", to, order_by, partition, self.order))

    def rank(self, to: str, order_by: str | Sequence[str], partition: str | Sequence[str] = (), function: str = "rank") -> Frame:
        return self._next(windows.rank(self.df, function, to, order_by, partition))

    # scores
    def row_dot(self, query: Sequence[float], of: str | Sequence[str], to: str = "score") -> Frame:
        return self._next(vectors.row_dot(self.df, of, query, to))

    def row_cosine(self, query: Sequence[float], of: str | Sequence[str], to: str = "score") -> Frame:
        return self._next(vectors.row_cosine(self.df, of, query, to))

    # out of Spark
    def collect(self) -> list:
        out = self.df if self.sort_keys or not self.order else self.df.orderBy(*(F.col(o).asc_nulls_last() for o in self.order))
        return out.collect()

    def to_objects(self, make: type | None = None) -> list:
        """Rows, or make(**row) of each."""
        return [make(**r.asDict()) if make else r for r in self.collect()]

    def to_arrow(self) -> pa.Table:
        return self.df.toArrow()

    def to_tensor(self, *names: str) -> np.ndarray:
        """(rows, columns) of one numeric type; a null is an error."""
        values, known = self.to_nullable_tensor(*names)
        if not known.all():
            raise QuillonError("a tensor has no nulls")
        return values

    def to_nullable_tensor(self, *names: str) -> tuple[np.ndarray, np.ndarray]:
        """Values, zero where null, and what isn't null."""
        names = list(names) or [n for n in numeric_columns(self.df) if n not in self.order]
        kinds = {field(self.df, n).dataType for n in names}
        if len(kinds) != 1 or not isinstance(next(iter(kinds)), T.NumericType):
            raise TypeMismatch("columns of one numeric type")
        ordered = self.df if self.sort_keys or not self.order else self.df.orderBy(*(F.col(f"`{o}`").asc_nulls_last() for o in self.order))
        table = ordered.select(*(F.col(f"`{field(self.df, n).name}`").alias(f"c{i}") for i, n in enumerate(names))).toArrow()
        known = np.column_stack([c.is_valid().to_numpy() for c in table.columns])
        decimals = isinstance(next(iter(kinds)), T.DecimalType)
        values = [np.array([0 if v is None else v for v in c.to_pylist()], object) if decimals else c.fill_null(0).to_numpy() for c in table.columns]
        return np.ascontiguousarray(np.column_stack(values)), known

    def batches(self, size: int, *names: str) -> list[np.ndarray]:
        """Views of one tensor, size rows each."""
        tensor = self.to_tensor(*names)
        return [tensor[i : i + size] for i in range(0, len(tensor), size)]

    @classmethod
    def from_batches(cls, spark: SparkSession, batches: Sequence[np.ndarray], names: Sequence[str] | None = None) -> Frame:
        """Tensors of one width below each other."""
        return cls.from_matrix(spark, np.concatenate(list(batches)), names)

    def explain(self, mode: str = "formatted") -> str:
        from quillon.plans.explain import plan_text

        return plan_text(self.df, mode)

"""Series: a frame (label, value, position). Labels may repeat; the first of equals counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.errors import QuillonError, SchemaError


def create(spark: SparkSession, values: Sequence, value_type: str, labels: Sequence | None = None, label_type: str = "int", known: Sequence[bool] | None = None) -> DataFrame:
    """Labels are 0, 1, 2 .. unless given; a value that isn't known is null."""
    names = list(range(len(values))) if labels is None else list(labels)
    if len(names) != len(values):
        raise SchemaError("as many labels as values")
    if known is not None:
        values = [v if k else None for v, k in zip(values, known, strict=True)]
    return spark.createDataFrame(list(zip(names, values, range(len(values)), strict=True)), f"label {label_type}, value {value_type}, position long")


def of(df: DataFrame, label: str, value: str, order: str) -> DataFrame:
    return df.select(F.col(label).alias("label"), F.col(value).alias("value"), F.col(order).alias("position"))


def get(series: DataFrame, label: object) -> object:
    """The value of the first row with the label; KeyError without one."""
    row = series.where(F.col("label") == F.lit(label)).orderBy("position").select("value").first()
    if row is None:
        raise KeyError(label)
    return row.value


def try_get(series: DataFrame, label: object, default: object = None) -> object:
    """get, or the default without such a row."""
    try:
        return get(series, label)
    except KeyError:
        return default


def label_at(series: DataFrame, position: int) -> object:
    row = series.where(F.col("position") == position).select("label").first()
    if row is None:
        raise SchemaError(f"no row {position}")
    return row.label


def contains(series: DataFrame, label: object) -> bool:
    return not series.where(F.col("label") == F.lit(label)).isEmpty()


def align(left: DataFrame, right: DataFrame) -> DataFrame:
    """(label, left, right, position) of labels on both sides, as often as on the left; null labels meet nothing."""
    first = Window.partitionBy("label").orderBy("position")
    once = right.where("label is not null").withColumn("__nth", F.row_number().over(first)).where("__nth = 1")
    return left.select("label", F.col("value").alias("left"), "position").join(once.select("label", F.col("value").alias("right")), "label")


def add(left: DataFrame, right: DataFrame) -> DataFrame:
    return align(left, right).select("label", (F.col("left") + F.col("right")).alias("value"), "position")


def multiply(left: DataFrame, right: DataFrame | float) -> DataFrame:
    if not isinstance(right, DataFrame):
        return left.withColumn("value", F.col("value") * F.lit(right))
    return align(left, right).select("label", (F.col("left") * F.col("right")).alias("value"), "position")


def slice_(series: DataFrame, start: int, length: int) -> DataFrame:
    return series.where((F.col("position") >= start) & (F.col("position") < start + length))


def top_k(series: DataFrame, k: int) -> DataFrame:
    """Labels of the k largest values, nulls left out, ties by position."""
    return series.where("value is not null").orderBy(F.col("value").desc(), "position").limit(k).select("label", "value", "position")


def average(series: DataFrame) -> object:
    from quillon.operators.aggregates import series_average

    return series_average(series, "value")


def to_list(series: DataFrame, most: int = 1_000_000) -> list:
    """The values in order; an error beyond `most`, so that nothing of unknown size reaches the driver."""
    rows = series.orderBy("position").limit(most + 1).select("value").collect()
    if len(rows) > most:
        raise QuillonError(f"more than {most} values")
    return [r.value for r in rows]

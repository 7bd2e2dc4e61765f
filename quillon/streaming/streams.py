"""Queries over streams: what works row by row or keeps a state by key runs as it stands; what needs all rows is refused by name."""

from __future__ import annotations

import asyncio
from collections.abc import AsyncIterator, Callable, Sequence
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillon.errors import StreamingError

#: Operations that need every row before they give the first; groups and distinct rows are kept as state instead.
NEEDS_ALL_ROWS = ("sort", "then_by", "join", "rolling", "cumulative", "shift", "lead", "row_number", "rank", "take", "skip", "slice", "select_rows", "reorder", "normalize", "combine")


def read_stream(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet", files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(format).load(path)


def run_steps(df: DataFrame, steps: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Named steps in turn; on a stream, a step of NEEDS_ALL_ROWS is an error."""
    for name, step in steps:
        if df.isStreaming and name in NEEDS_ALL_ROWS:
            raise StreamingError(f"{name} needs all rows")
        df = step(df)
    return df


def write_stream(df: DataFrame, path: str, checkpoint: str, format: str = "parquet", once: bool = True, interval: str = "1 minute") -> StreamingQuery:
    """Exactly once into files; once: what is there now, in as many batches as it takes, then the query ends."""
    writer = df.writeStream.format(format).option("checkpointLocation", checkpoint).option("path", path).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def write_totals(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """For groups and distinct rows: after each batch the whole result so far stands in a folder of its own, path/batch=N."""
    def keep(now: DataFrame, batch: int) -> None:
        now.write.mode("overwrite").parquet(f"{path}/batch={batch}")  # a batch that is run again writes the same folder

    return df.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()


def latest_totals(spark: SparkSession, path: str) -> DataFrame:
    """What write_totals wrote last."""
    every = spark.read.parquet(path)
    return every.where(F.col("batch") == every.agg(F.max("batch")).first()[0]).drop("batch")


def progress(query: StreamingQuery) -> list[tuple[int, int]]:
    """(batch, rows read) of the batches that Spark still remembers."""
    return [(p["batchId"], p["numInputRows"]) for p in query.recentProgress]


async def chunks(df: DataFrame, rows: int = 10_000) -> AsyncIterator[list]:
    """Lists of rows without holding up the event loop; the next partition is fetched while one is used."""
    rest = df.toLocalIterator(prefetchPartitions=True)

    def some() -> list:
        return list(islice(rest, rows))

    while found := await asyncio.to_thread(some):
        yield found


def chunk_rows(budget_bytes: int, row_bytes: int = 100) -> int:
    """Rows of a batch that a memory budget allows, a tenth of it, from 1,000 to 100,000."""
    return max(1_000, min(100_000, budget_bytes // 10 // row_bytes))


def windowed(df: DataFrame, time_col: str, width: str, aggregates: Sequence[Column], keys: Sequence[str] = (), late: str | None = None, slide: str | None = None) -> DataFrame:
    """Aggregates by time window and keys; late: how long a stream waits for rows. Works on tables and streams alike."""
    timed = df.withWatermark(time_col, late) if late and df.isStreaming else df
    span = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    out = timed.groupBy(span.alias("window"), *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])

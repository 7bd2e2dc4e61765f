"""User sources: anything that yields Arrow batches for a list of partitions, through Spark's Python data source API."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def register(spark: SparkSession, name: str, schema: str, partitions: int, read: Callable[[int], Iterator[pa.RecordBatch]]) -> None:
    """After this, spark.read.format(name).load() reads `read(i)` for i below partitions, on the executors."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [InputPartition(i) for i in range(partitions)]

        def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
            yield from read(partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: object) -> DataSourceReader:
            return Reader()

    spark.dataSource.register(Source)


def scan(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.format(name).load()

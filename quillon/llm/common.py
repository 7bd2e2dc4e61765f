"""Shared plumbing: scratch tables in the cluster's shared folder, and reading inputs."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which every executor can reach.

    A local session without the setting gets a temporary folder once; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared root."""
    return f"{shared_root(spark)}/tables/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared scratch folder and read it back.

    Cuts the lineage the way checkpoint() does, in a compressed columnar form;
    a lost executor costs nothing, because the files are on shared storage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files behind a frame that materialize() returned and that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tables/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which at its end returns the memory that Arrow and malloc hold on to: an idle worker keeps that beside the JVM's."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        del batches
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast built-in; both branches agree on it."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def repeat_rows(df: DataFrame, times: Column, step: int = 10_000) -> DataFrame:
    """Each row `times` times over (none for 0 or null), with its number from 0 in column "nth".

    Two explodes, so that no array is longer than the larger of step and times / step.
    """
    many = df.where(times > 0).withColumn("nth_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((times - 1) / step))))
    last = F.least(times - 1, (F.col("nth_block") + 1) * step - 1)
    return many.withColumn("nth", F.explode(F.sequence(F.col("nth_block") * step, last))).drop("nth_block")


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of steps whose results are written: a long job's disk is then its largest step's."""
    import gc

    gc.collect()
    spark._jvm.System.gc()

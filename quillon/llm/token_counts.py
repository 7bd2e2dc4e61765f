"""Token counts through a digest cache.

A text is known by the SHA-256 of its normal form, a count by that digest and the digest of the
tokenizer's file and library version. Known digests are joined to their stored counts; of the
others each distinct text is encoded once, and its count is appended to the cache: a Parquet folder
by tokenizer version and job. A job writes into a folder of its own, so jobs may append at the same
time; two that meet the same new text both store it, and a reader takes one of the equal rows. The
files of a job that fails are never seen, since they are moved into place when it commits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialize, shared_root, table, tidy
from quillon.llm.encoder import encoder, tokenizer_version

CACHE = "digest binary, n_tokens long"


def normal_form(text: Column) -> Column:
    """The form whose count is stored. A byte-level vocabulary tells every two texts apart, so only null becomes empty."""
    return F.coalesce(text, F.lit(""))


def cached_counts(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) stored for this tokenizer version, one row a digest."""
    try:
        stored = spark.read.schema(CACHE).option("recursiveFileLookup", True).parquet(f"{cache}/version={tokenizer_version(tokenizer)}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = spark.createDataFrame([], CACHE)
    return stored.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))  # two jobs may have added the same text


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) for every row of docs; the cache has all its texts afterwards.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids each give a row. An empty
    table gives no rows and leaves the cache as it is. Other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    text = normal_form(F.col(text_col))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    # combined before the exchange, so that a task sends one row of a text however often it stands there
    misses = keyed.groupBy("digest").agg(F.first("text").alias("text")).join(cached_counts(spark, cache, tokenizer), "digest", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(encoder(tokenizer).batch(b.column(1), ids=False)[0])], ["digest", "n_tokens"])

    misses.select("digest", "text").mapInArrow(tidy(run), CACHE).write.parquet(f"{cache}/version={tokenizer_version(tokenizer)}/job={uuid.uuid4().hex}")
    counts = materialize(cached_counts(spark, cache, tokenizer), "counts")  # written, so that Spark can split a frequent text's rows in the join
    return keyed.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "digest").join(counts, "digest", "left").select("id", "n_bytes", "n_tokens")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is the folder token-counts in spark.checkpoint.dir and outlives the job: texts that it has are not encoded again."""
    out = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), f"{shared_root(spark)}/token-counts")
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))

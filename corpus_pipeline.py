"""From documents to training tokens: quality, near-duplicates, decontamination, mixing, token output.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and what it returns is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents.
Rows that share a doc_id are taken for one document where a stage looks decisions up by id. A null
doc_id is an id like any other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialize, table
from quillon.llm.mixing import mix
from quillon.llm.quality import THRESHOLD, scored, train
from quillon.llm.rans import token_output
from quillon.llm.shingles import RADIUS
from quillon.llm.simhash import simhash_components
from quillon.llm.winnowing import contamination

#: No SQL: stages hash with XXH64 and write files. tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def _free(name: str, docs: DataFrame) -> str:
    """name, made longer until docs has no such column in any case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at the threshold or above stay, repeated rows too; a null text counts as empty.

    Without labels that it can learn from, all stay. An empty table gives no rows.
    """
    model = train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    score = _free("pu_score", docs)
    return scored(docs, model, to=score).where(F.col(score) >= THRESHOLD if model else F.lit(True)).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents at a Jaccard similarity of 0.8 or more on five-word shingles, and what these link, the smallest doc_id stays, once if its row is repeated.

    All null, empty and wordless texts are one group. Rows without a doc_id are told apart by nothing: they all stay if
    one of them does, once for each text. An empty table gives no rows.
    """
    groups = simhash_components(docs.select("doc_id", "text"), shingle=5, radius=RADIUS, similarity=0.8)
    kept = _free("kept_id", docs)
    first = groups.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias(kept)).distinct()
    return docs.join(first, F.col("doc_id").eqNullSafe(F.col(kept)), "left_semi").dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, and with them all rows of their doc_id; null and empty texts stay. An empty table gives no rows, an empty benchmark takes none."""
    hit = _free("hit_id", docs)
    hits = contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).where("n_hit > 0").select(F.col("id").alias(hit)).distinct()
    return docs.join(hits, F.col("doc_id").eqNullSafe(F.col(hit)), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Rows of one id share its copies, rounded by their texts' hashes.

    A null source is a source of its own; null and empty texts have no words and the copies of their source's share.
    An empty table gives no rows.
    """
    of, copies, rows = (_free(n, docs) for n in ("mix_id", "mix_copies", "mix_rows"))
    taken = mix(docs.select("doc_id", "text", "source")).groupBy(F.col("id").alias(of)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows)).where(F.col(copies) > 0)
    part = F.pmod(F.xxhash64("text"), F.lit(1000)) / 1000
    times = F.when(F.col(rows) == 1, F.col(copies)).otherwise(F.floor(F.col(copies) / F.col(rows) + part)).cast("int")
    many = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(of))).withColumn(copies, times)
    return many.withColumn(copies, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).select([F.col(f"`{c}`") for c in docs.columns])  # two at most for a row


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every copy, read back from the rANS shards. A null text has the end id alone; null ids come first, an empty table gives no rows."""
    return token_output(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), ids=False).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

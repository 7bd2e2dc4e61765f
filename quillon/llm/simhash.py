"""SimHash near-duplicates by tiled exact comparison of fingerprints.

1. Every document gets a 64-bit fingerprint over its word shingles.
2. Fingerprints are made distinct; a pair within `radius` bits agrees on at least
   `blocks - radius` of `blocks` bit blocks, so each combination of that many blocks is a
   routing key that no true pair escapes.
3. Within a key, rows are sorted by population count and compared tile against tile with
   numpy XOR and bit counts; a tile pair whose population counts differ beyond the radius is
   skipped. A key with more rows than one task should hold is made finer, and what is still too
   large is cut into tiles that meet pairwise in tasks of their own, so no link is lost.
4. A task reports a spanning forest of the links that it found, never all pairs; components are
   then joined up on the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import materialize, table
from quillon.llm.components import connected_components, labels
from quillon.llm.shingles import jaccard_components
from quillon.llm.tiles import dealt, links_in_groups, majority, signed, whole_groups

SEED = 42


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of UTF-8 bytes: A-Z lower-cased, words split at ASCII white space."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_digest
    return int.from_bytes(majority(np.frombuffer(b"".join([digest(g, SEED) for g in grams]), np.uint8).reshape(-1, 8)), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) for every row of docs, fp as a signed long. A null or empty text has fingerprint 0."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType())]))


def routing_keys(fp: Column, radius: int, blocks: int) -> Column:
    """An array of one key for each way to choose the blocks that must agree."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    keys = []
    for n, kept in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in kept)
        keys.append(F.xxhash64(F.lit(n), fp.bitwiseAND(F.lit(signed(mask)))))
    return F.array(*keys)


def near_links(distinct: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """Links (a, b) whose transitive closure is that of all pairs of fp within radius bits."""
    keyed = distinct.select("fp", F.explode(routing_keys(F.col("fp"), radius, blocks)).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fps in whole_groups(batches, 2):
            a, b = links_in_groups(key, fps.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt(keyed, radius).repartition("key").sortWithinPartitions("key").select("key", "fp").mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, blocks: int = 5, similarity: float | None = None) -> DataFrame:
    """(id, fp, component_id) for every row of docs: component_id is the smallest id reachable over links.

    Texts are linked if their fingerprints are within radius bits. With a similarity, the radius only says which texts
    are compared: linked are those whose shingle sets have at least this Jaccard similarity (see shingles.py), and fp is
    left out. Null and empty texts have fingerprint 0 and are linked like any other. Rows with the same id each give a
    row. A null id stands in no component_id unless all ids of its component are null, then that is null. An empty table
    gives no rows. Other columns of docs are not looked at.
    """
    if similarity is not None:
        return jaccard_components(docs, id_col, text_col, shingle, similarity, radius)
    marked = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = connected_components(near_links(distinct.select("fp"), radius, blocks))
    return marked.join(labels(distinct.withColumnRenamed("fp", "node"), roots).withColumnRenamed("node", "fp"), "fp", "left").select("id", "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

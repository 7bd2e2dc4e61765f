"""Word tokens, vocabularies, and texts as padded ids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.errors import SourceError

#: The special tokens, with ids from 0.
SPECIAL = ("<PAD>", "<UNK>", "<BOS>", "<EOS>")
PAD, UNK, BOS, EOS = range(4)
WORD = r"[\p{L}\p{Nd}]+"
#: Words of a vocabulary that every task may hold; a larger one is joined.
HELD = 200_000


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """How many words tokenize gives, without making them; null for null."""
    return F.regexp_count(F.lower(text), F.lit(WORD))


def vocabulary(docs: DataFrame, text_col: str, max_size: int = 10_000, min_count: int = 1) -> DataFrame:
    """(token, n, id): the special tokens, then the most frequent words, ties by word; max_size with the special ones."""
    words = docs.select(F.explode(tokenize(F.col(text_col))).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    top = words.orderBy(F.col("n").desc(), "token").limit(max(0, max_size - len(SPECIAL)))  # bounded, so that one task may number them
    ranked = top.withColumn("id", F.row_number().over(Window.orderBy(F.col("n").desc(), "token")) + len(SPECIAL) - 1)
    first = {"token": SPECIAL, "n": pa.array([0] * len(SPECIAL), pa.int64()), "id": pa.array(range(len(SPECIAL)), pa.int32())}
    special = docs.sparkSession.createDataFrame(pa.table(first))  # in Arrow: tuples would start Python in the tasks
    return special.unionByName(ranked.select("token", "n", "id"))


def _buckets(spark: SparkSession, known: pa.Table) -> tuple[DataFrame, Callable[[Column], Column]]:
    """One row with an array of maps from words to ids, some one word each, and a word's place in the array.

    As a scalar subquery, the row goes out once with the tasks' code; a joined one would be copied for every text.
    """
    n = max(1, known.num_rows)

    def slot(word: Column) -> Column:
        return F.pmod(F.xxhash64(word), F.lit(n)).cast("int")

    placed = spark.createDataFrame(known).withColumn("at", slot(F.col("token"))).toArrow().sort_by("at")
    offsets = pa.array(np.searchsorted(placed.column("at").to_numpy(), np.arange(n + 1)).astype(np.int32))
    maps = pa.MapArray.from_arrays(offsets, *(placed.column(c).combine_chunks() for c in ("token", "id")))
    return spark.createDataFrame(pa.table({"buckets": pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), maps)})), slot


def encode(docs: DataFrame, vocab: DataFrame, text_col: str, key_col: str, length: int | None = None, add_ends: bool = True, to: str = "ids") -> DataFrame:
    """(key, ids): ids of the words, UNK for those without, BOS and EOS around, cut or padded to length. Keys are unique.

    A vocabulary of HELD words at most goes to the tasks, which look words up where the texts lie, in the JVM; a larger
    one meets the words in a join, so neither has to fit in memory. A null text has no words. Of a word with several ids
    the least counts.
    """
    known = vocab.where((F.col("id") >= len(SPECIAL)) & F.col("token").isNotNull()).groupBy("token").agg(F.min("id").cast("int").alias("id"))
    held = known.limit(HELD + 1).toArrow()
    if held.num_rows <= HELD:
        buckets, slot = _buckets(docs.sparkSession, held)
        rows = docs.select(key_col, F.coalesce(tokenize(F.col(text_col)), F.array().cast("array<string>")).alias("__said"), buckets.scalar().alias("__buckets"))
        ids = F.transform("__said", lambda w: F.coalesce(F.try_element_at(F.get("__buckets", slot(w)), w), F.lit(UNK)))
    else:
        found = docs.select(F.col(key_col), F.posexplode_outer(tokenize(F.col(text_col))).alias("at", "token")).join(known, "token", "left")
        pair = F.struct("at", F.coalesce("id", F.lit(UNK)).alias("id"))
        rows = found.groupBy(key_col).agg(F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), pair))).alias("__pairs"))
        ids = F.transform("__pairs", lambda p: p["id"])
    if add_ends:
        ids = F.concat(F.array(F.lit(BOS)), ids, F.array(F.lit(EOS)))
    if length is not None:
        ids = F.slice(F.concat(ids, F.array_repeat(F.lit(PAD), length)), 1, length)
    return rows.select(key_col, ids.alias(to))


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    """A JSON object an entry, with its id and word."""
    vocab.select("id", "token", "n").write.json(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    loaded = spark.read.schema("token string, n long, id int").json(path)
    if loaded.groupBy("id").count().where("count > 1 or id is null").limit(1).count():
        raise SourceError(f"{path} has an id twice, or a word without one")
    return loaded


def decode(docs: DataFrame, vocab: DataFrame, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """docs with a column of words joined by spaces: PAD and BOS skipped, up to EOS, UNK for an id without a word.

    The words lie in an array by id, which is broadcast: a vocabulary has a bounded size and its ids are dense.
    """
    words = vocab.agg(F.array_sort(F.collect_list(F.struct("id", "token"))).alias("__w")).select(F.transform("__w", lambda x: x["token"]).alias("__words"))
    ids = F.col(ids_col)
    end = F.array_position(ids, EOS)
    upto = F.when(end > 0, F.slice(ids, 1, F.greatest(end - 1, F.lit(0)).cast("int"))).otherwise(ids)
    said = F.transform(F.filter(upto, lambda i: ~i.isin(PAD, BOS)), lambda i: F.coalesce(F.get("__words", i), F.lit(SPECIAL[UNK])))
    return docs.join(F.broadcast(words)).withColumn(to, F.array_join(said, " ")).drop("__words")

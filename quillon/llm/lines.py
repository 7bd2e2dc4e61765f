"""Line dedup by a deletion-neighbourhood join, up to one edit.

Lines within an edit of each other share a variant: the line itself, or the line without one
character. Variants are hashed keys; equal ones are joined, the edit distance is verified on the
texts, and of lines that meet the earliest stays.

A line of n characters has n variants, so most are never made: two lines within an edit agree on
the first or the second half of the shorter one. Each distinct line keeps four hashed halves; these are
counted first, combined before the exchange, and only lines that share one with another emit variants.

Lines that lack the same character of one variant differ in that character alone, so all of them
are within an edit of each other: each is compared with the earliest of them, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialize, release_shuffles, table

MIN_CHARS = 20
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def variant_hashes(line: str) -> tuple[int, np.ndarray]:
    """Hash of the line, and of the line without each of its characters, in one pass."""
    letters = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    letters = (letters * np.uint64(0xBF58476D1CE4E5B9)) ^ (letters << np.uint64(29))
    powers = np.full(len(letters), _ODD, np.uint64)
    powers[:1] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * np.multiply.accumulate(powers))])
    without = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(_INVERSE)

    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))

    return int(mixed(sums[-1:])[0].view(np.int64)), mixed(without).view(np.int64)


def half_keys(line: Column, n: Column) -> list[Column]:
    """Keys of the halves of a line as one of its own length, and as one with a character too many."""
    keys = []
    for less in (0, 1):
        short = n - less
        half = F.floor(short / 2).cast("int")
        keys.append(F.xxhash64(F.lit("first"), short, F.substring(line, F.lit(1), half)))
        keys.append(F.xxhash64(F.lit("last"), short, F.substring(line, n - (short - half) + 1, short - half)))
    return keys


def _variants(lines: DataFrame) -> DataFrame:
    """(v, at, nth) of lines (nth, line): at is the place of the missing character, -1 for the line itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, places, rows, size = [], [], [], 0

            def batch(keys: list, places: list, rows: list, b: pa.RecordBatch = b) -> pa.RecordBatch:
                row = pa.array(np.concatenate(rows))
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(places)), b.column(0).take(row)], ["v", "at", "nth"])

            for i, line in enumerate(b.column(1).to_pylist()):
                own, without = variant_hashes(line)
                keys.append(np.concatenate([[own], without]))
                places.append(np.arange(-1, len(without)))
                rows.append(np.full(len(without) + 1, i))
                size += len(without)
                if size > 100_000:
                    yield batch(keys, places, rows)
                    keys, places, rows, size = [], [], [], 0
            if rows:
                yield batch(keys, places, rows)

    return lines.select("nth", "line").mapInArrow(run, "v long, at long, nth long")


def dropped_lines(docs: DataFrame, min_chars: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, dropped, kept) for every row of docs: numbers of the dropped lines, and the text that stays.

    Lines end at "\\n". One that isn't empty is dropped if an equal line stands earlier, in order of id, text hash and
    number, nulls first; one of MIN_CHARS characters or more also if a line within one edit of it (a character
    replaced, put in or left out), of any length, does. It counts what stood there before anything was dropped. With
    min_chars that is the floor for both, and shorter lines are not looked at. Rows that share id and text are one
    place and keep the same lines. A null text has no lines and stays null; an empty one has one line. An empty table
    gives no rows. Other columns of docs are not looked at.
    """
    spark = docs.sparkSession  # the small sides grow with the input: the joins with them are merge joins at any size
    least, near_chars = (1, MIN_CHARS) if min_chars is None else (min_chars, min_chars)
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash")).alias("row"), F.col(text_col).alias("text"))
    every = keyed.select("row", F.posexplode_outer(F.split("text", "\n")).alias("number", "line")).withColumn("n", F.char_length("line")).where(F.col("n") >= least)
    every = every.withColumn("lid", F.struct(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), F.col("line")).alias("h2")))
    place = F.struct("row", "number")
    compared = F.col("n") >= near_chars - 1  # a line one character short can still be the earlier twin
    keys = [f"k{i}" for i in range(4)]
    marked = every.select("lid", place.alias("place"), *(F.when(compared, h).alias(k) for k, h in zip(keys, half_keys(F.col("line"), F.col("n")), strict=True)))
    firsts = marked.groupBy("lid").agg(F.min("place").alias("first"), F.count("*").alias("times"), *(F.first(k).alias(k) for k in keys))
    firsts = materialize(firsts, "first-lines")
    release_shuffles(spark)

    halves = firsts.where("k0 is not null").select("lid", "first", F.explode(F.array(*keys)).alias("key"))
    shared = halves.groupBy("key").agg(F.min("lid.h1").alias("l0"), F.max("lid.h1").alias("l1")).where("l0 <> l1").select("key")
    shared = materialize(shared, "shared-halves")  # written, so that the join's both sides are exchanges, and Spark can split a frequent key's
    near = materialize(halves.join(shared, "key", "left_semi").select("lid", "first").distinct(), "near-lines")
    release_shuffles(spark)
    lines = every.select("lid", "line").join(near.hint("merge"), "lid").dropDuplicates(["lid"]).orderBy("first")
    lines = materialize(lines.select("lid", "line", F.monotonically_increasing_id().alias("nth")), "lines")  # numbers that ascend with the places
    release_shuffles(spark)

    variants = materialize(_variants(lines), "variants")
    lacking = variants.where("at >= 0")
    groups = materialize(lacking.groupBy("v", "at").agg(F.min("nth").alias("least"), F.count("*").alias("n")).where("n > 1"), "groups")
    replaced = lacking.join(groups, ["v", "at"]).where("least < nth").select("nth", F.col("least").alias("by"))
    whole = variants.where("at < 0").select("v", F.col("nth").alias("whole"))
    longer = lacking.join(whole, "v")
    put_in = longer.where("whole < nth").select("nth", F.col("whole").alias("by"))
    left_out = longer.where("nth < whole").groupBy("whole").agg(F.min("nth").alias("by")).select(F.col("whole").alias("nth"), "by")
    pairs = replaced.union(put_in).union(left_out).distinct()
    earlier = lines.select(F.col("nth").alias("by"), F.col("line").alias("by_line"))
    verified = pairs.join(lines, "nth").join(earlier, "by").where(F.char_length("line") >= near_chars).where(F.levenshtein("line", "by_line", 1) >= 0)
    beaten = materialize(verified.select("lid").distinct(), "beaten-lines")
    release_shuffles(spark)

    told = firsts.join(beaten.withColumn("beaten", F.lit(True)), "lid", "left").where("times > 1 or beaten").select("lid", "first", F.coalesce("beaten", F.lit(False)).alias("beaten"))
    told = materialize(told, "told-lines")
    gone = every.select("row", "number", "lid").join(told.hint("merge"), "lid").where(F.col("beaten") | (F.struct("row", "number") != F.col("first")))
    lists = gone.groupBy("row").agg(F.array_sort(F.collect_set("number")).alias("dropped"))  # at most a text's lines
    # whether each line up to the last dropped one is dropped: looking that up takes the same time for any text
    until = F.transform("dropped", lambda at, i: F.concat(F.array_repeat(F.lit(False), at - F.coalesce(F.get("dropped", i - 1), F.lit(-1)) - 1), F.array(F.lit(True))))
    lists = materialize(lists.withColumn("gone", F.flatten(until)), "dropped-lines")
    release_shuffles(spark)
    none = F.expr("cast(array() as array<int>)")
    parts = F.split("text", "\n")
    stay = F.filter(parts, lambda _, i: ~F.coalesce(F.get("gone", i), F.lit(False)))
    kept = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    return keyed.join(lists.hint("merge"), "row", "left").select("row.id", F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"), F.coalesce("dropped", none).alias("dropped"), kept.alias("kept"))


def op5_deletion_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dropped_lines(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.char_length("kept").cast("long").alias("kept_chars"), F.sha2("kept", 256).alias("kept_sha256"))

"""Suffix-array dedup: remove what lies in a byte string of a set length that also starts elsewhere.

Whole-corpus suffix arrays do not fit anywhere, so the suffixes are dealt into buckets that no two
equal strings can leave:

1. Every window of `length` bytes is known by the k-gram in it whose hash is least (the last of
   equals). Neighbouring windows with one such k-gram are a run, so a text of n bytes has some
   n / 60 runs. A run's bucket is its k-gram's hash.
2. Buckets of one run hold no repeat. Where all runs of a bucket are the same bytes, all are repeats,
   and no text is moved. Both are told by counts that combine before the exchange.
3. Of the other buckets, one run of each kind is fetched, and its suffixes are sorted bucket by
   bucket with a difference cover (suffixes.py) in blocks of bounded memory; neighbours in that
   order that share `length` bytes are repeats.
4. A bucket with more than MANY kinds of runs would make a task grow with the input. Its suffixes are
   counted one by one by their window's hash instead, again combining before the exchange.

Runs and windows that are taken for equal have equal 64-bit hashes within one 64-bit bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import drop_scratch, materialize, release_shuffles, table
from quillon.llm.suffixes import repeated_starts

LENGTH, GRAM = 200, 64
#: Kinds of runs in a bucket beyond which its suffixes are counted by hash.
MANY = 2000
#: Bytes of texts that are hashed at once, and of runs whose suffixes are sorted at once.
PIECE, BLOCK = 1 << 17, 1 << 20
_PLACE = 19  # bits of a position among those hashed at once
_ODD = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def _powers(n: int, of: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    def up(x: int) -> np.ndarray:
        out = np.full(n, x, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return up(of), up(pow(of, -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Hashes of any substring of some bytes, by sums of powers."""

    def __init__(self, data: np.ndarray) -> None:
        self.up, self.down = _powers(1 << _PLACE, _ODD)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        letters = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
        np.cumsum(letters[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    n = len(x) - w + 1
    pad = -len(x) % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def runs(data: np.ndarray, owner: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(key, hash, start, n) of the runs of windows that lie in one owner's bytes: n windows from start on."""
    empty = np.empty(0, np.int64)
    if len(data) < length:
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    hashes = Hashes(data)
    at = np.arange(len(data) - gram + 1)
    grams = hashes.of(at, at + gram)
    places = np.uint64((1 << _PLACE) - 1)
    least = _sliding_min((grams & ~places) | (places - at.astype(np.uint64)), length - gram + 1)
    inside = np.flatnonzero(owner[: len(least)] == owner[length - 1 :])
    if not len(inside):
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    anchor = (places - (least[inside] & places)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1] + 1)])
    n = np.diff(np.r_[first, len(inside)])
    start = inside[first]
    return grams[anchor[first]], hashes.of(start, start + n + length - 1), start, n


def _together(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Rows, offsets and bytes to be hashed at once; a long text comes in pieces that overlap."""
    rows, offsets, parts, size = [], [], [], 0
    for row, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - length + 1), PIECE):
            part = text[offset : offset + PIECE + length - 1]
            if len(part) < length:
                continue
            if size + len(part) > 2 * PIECE:
                yield rows, offsets, parts
                rows, offsets, parts, size = [], [], [], 0
            rows.append(row)
            offsets.append(offset)
            parts.append(part)
            size += len(part)
    if rows:
        yield rows, offsets, parts


def run_table(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """(row, key, hash, start, n) for every run of keyed (row, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, offsets, parts in _together([t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()], length):
                sizes = np.array([len(p) for p in parts])
                owner = np.repeat(np.arange(len(parts)), sizes)
                key, hash_, start, n = runs(np.frombuffer(b"".join(parts), np.uint8), owner, length, gram)
                part = owner[start]
                row = pa.array(np.array(rows)[part])
                place = start - (np.cumsum(sizes) - sizes)[part] + np.array(offsets)[part]
                numbers = [pa.array(x) for x in (key.view(np.int64), hash_.view(np.int64), place, n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), *numbers], ["row", "key", "hash", "start", "n"])

    schema = T.StructType([keyed.schema["row"]])
    for name, kind in (("key", T.LongType()), ("hash", T.LongType()), ("start", T.LongType()), ("n", T.IntegerType())):
        schema = schema.add(name, kind)
    return keyed.select("row", "text").mapInArrow(run, schema)


def fetched(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(row, key, times, start, n, bytes, window): the bytes of each wanted run, or for a run of a large bucket a row for each window's hash."""
    asked = wanted.groupBy("row").agg(F.collect_list(F.struct("key", "times", "start", "n", "large")).alias("runs"))  # at most a text's runs
    met = keyed.groupBy("row").agg(F.first("text").alias("text")).join(asked, "row")  # repeated rows are fetched once
    schema = T.StructType([keyed.schema["row"]])
    for name, kind in (("key", T.LongType()), ("times", T.LongType()), ("start", T.LongType()), ("n", T.IntegerType()), ("bytes", T.BinaryType()), ("window", T.LongType())):
        schema = schema.add(name, kind)

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for i, (text, asked_) in enumerate(zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            for r in asked_:
                own = text[r["start"] : r["start"] + r["n"] + length - 1]
                if not r["large"]:
                    yield i, r["key"], r["times"], r["start"], r["n"], own, None
                    continue
                at = np.arange(r["n"])
                for j, h in enumerate(Hashes(np.frombuffer(own, np.uint8)).of(at, at + length).view(np.int64).tolist()):
                    yield i, r["key"], r["times"], r["start"] + j, 1, None, h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, size = [], 0

            def batch(made: list[tuple], b: pa.RecordBatch = b) -> pa.RecordBatch:
                row, *columns = zip(*made, strict=True)
                row = pa.array(row)
                return pa.RecordBatch.from_arrays([b.column(0).take(row), *(pa.array(c, f) for c, f in zip(columns, kinds, strict=True))], schema.names)

            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]
            for r in rows(b):
                made.append(r)
                size += len(r[5] or b"") + 64
                if size > 4 << 20:
                    yield batch(made)
                    made, size = [], 0
            if made:
                yield batch(made)

    return met.mapInArrow(run, schema)


def sorted_repeats(fetched_runs: DataFrame, length: int) -> DataFrame:
    """(row, low, high): stretches of bytes in repeated windows of runs that stand once, by sorting suffixes."""
    schema = T.StructType([fetched_runs.schema["row"]]).add("low", T.LongType()).add("high", T.LongType())

    def repeats(rows: pa.Table) -> pa.RecordBatch:
        parts = rows.column("bytes").to_pylist()
        sizes, n, once = np.array([len(p) for p in parts]), rows.column("n").to_numpy(), rows.column("times").to_numpy() == 1
        begin = np.cumsum(sizes) - sizes
        windows = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found = repeated_starts(np.frombuffer(b"".join(parts), np.uint8), windows, length)
        row = np.searchsorted(begin, found, "right") - 1
        found, row = found[once[row]], row[once[row]]
        first = np.r_[True, (found[1:] != found[:-1] + 1) | (row[1:] != row[:-1])] if len(found) else np.empty(0, bool)
        last = np.r_[first[1:], True] if len(found) else first
        at = rows.column("start").to_numpy()[row] - begin[row] + found
        row = pa.array(row[first])
        return pa.RecordBatch.from_arrays([rows.column("row").combine_chunks().take(row), pa.array(at[first]), pa.array(at[last] + length)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = None, 0
        for b in batches:
            now = pa.Table.from_batches([b])
            held = now if held is None else pa.concat_tables([held, now])
            size += b.column(b.schema.get_field_index("bytes")).nbytes
            while size > BLOCK:  # whole buckets, as many as a block holds
                key = held.column("key").to_numpy()
                ends = np.cumsum(np.array([len(x) for x in held.column("bytes").to_pylist()]))
                cut = int(np.searchsorted(key, key[min(int(np.searchsorted(ends, BLOCK)), len(key) - 1)], "left"))
                if not cut:  # one bucket fills the block: up to its end, if that is there
                    cut = int(np.searchsorted(key, key[0], "right"))
                    if cut == len(key):
                        break
                yield repeats(held.slice(0, cut))
                held, size = held.slice(cut), int(ends[-1] - ends[cut - 1])
        if held is not None and held.num_rows:
            yield repeats(held)

    return fetched_runs.select("key", "times", "row", "start", "n", "bytes").repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, many: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept) for every row of docs: the maximal removed stretches of bytes, and the bytes that stay.

    A byte goes if it lies in a string of `length` bytes that starts at another place too, in the same or in another
    row; strings do not reach over rows. Null and short texts lose nothing, and null is empty. Repeated rows are repeats
    of each other. An empty table gives no rows. Other columns of docs are not looked at.
    """
    spark = docs.sparkSession
    many = MANY if many is None else many
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash")).alias("row"), text.alias("text"))  # a struct is equal to one with nulls in the same fields
    window_end = F.col("start") + F.col("n") + (length - 1)

    all_runs = materialize(run_table(keyed, length, gram), "runs")
    shared = all_runs.groupBy("key").agg(F.count("*").alias("all"), F.min("hash").alias("h0"), F.max("hash").alias("h1")).where(F.col("all") > 1).select("key", (F.col("h0") == F.col("h1")).alias("alike"))
    shared = materialize(shared, "shared-keys")  # written, so that the join's both sides are exchanges, and Spark can split a frequent key's
    met = materialize(all_runs.join(shared, "key"), "shared-runs")
    drop_scratch(all_runs)
    drop_scratch(shared)
    release_shuffles(spark)

    alike = met.where("alike").select("row", F.col("start").alias("low"), window_end.alias("high"))
    mixed = met.where("not alike")
    place = F.struct("row", "start", "n")
    kinds = materialize(mixed.groupBy("key", "hash").agg(F.count("*").alias("times"), F.min(place).alias("place")), "kinds")
    large = materialize(kinds.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > many).select("key", F.lit(True).alias("large")), "large-keys")
    wanted = kinds.join(large, "key", "left").select("key", "times", "place.*", F.coalesce("large", F.lit(False)).alias("large"))
    twice = mixed.join(kinds.where("times > 1").select("key", "hash"), ["key", "hash"], "left_semi").select("row", F.col("start").alias("low"), window_end.alias("high"))
    got = materialize(fetched(keyed, wanted, length), "fetched")
    release_shuffles(spark)

    by_sorting = sorted_repeats(got.where("bytes is not null"), length)
    single = got.where("window is not null").select("row", "key", "window", "times", F.col("start").alias("low"), (F.col("start") + length).alias("high"))
    again = materialize(single.groupBy("key", "window").agg(F.sum("times").alias("all")).where(F.col("all") > 1).select("key", "window"), "windows")
    by_counting = single.where("times = 1").join(again, ["key", "window"], "left_semi").select("row", "low", "high")
    stretches = alike.union(twice).union(by_sorting).union(by_counting).distinct()
    lists = materialize(stretches.groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("stretches")), "stretches")  # at most a text's windows
    release_shuffles(spark)
    return _cut(keyed, lists)


def _cut(keyed: DataFrame, lists: DataFrame) -> DataFrame:
    spans = T.ArrayType(T.StructType([T.StructField("low", T.LongType()), T.StructField("high", T.LongType())]))
    schema = T.StructType([keyed.schema["row"].dataType["id"], T.StructField("n_bytes", T.LongType()), T.StructField("spans", spans), T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, found = b.column(1).cast(pa.binary()).to_pylist(), b.column(2)
            merged, kept = [], []
            for text, at in zip(texts, found, strict=True):
                if not at.is_valid:
                    merged.append([])
                    kept.append(text)
                    continue
                low, high = (np.sort(at.values.field(f).to_numpy()) for f in (0, 1))
                # sorted apart, the next begins a span of its own if it lies behind all ends so far
                new = np.flatnonzero(low[1:] > high[:-1]) + 1
                low, high = low[np.r_[0, new]].tolist(), high[np.r_[new - 1, -1]].tolist()
                merged.append(list(zip(low, high, strict=True)))
                kept.append(b"".join(text[a:z] for a, z in zip([0, *high], [*low, len(text)], strict=True)))
            arrow = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([[{"low": a, "high": z} for a, z in m] for m in merged], arrow), pa.array(kept, pa.binary())], schema.names)

    return keyed.join(lists, "row", "left").select("row.id", "text", "stretches").mapInArrow(run, schema)


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"])
    return out.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

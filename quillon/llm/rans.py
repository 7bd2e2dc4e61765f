"""Token ids in files coded with a static range asymmetric numeral system (rANS).

All files share one frequency table. A file, or shard, holds whole documents in ascending order;
its ids are cut into independent blocks of BLOCK ids. In a block, id t belongs to lane t % LANES;
each lane has a 64-bit state, and the lanes share one stream of 32-bit words. At every CHECK ids
a checkpoint keeps the lanes' states and the place in the stream, so that a reader can start
there; blocks and checkpoints are decoded side by side as the rows of numpy arrays. Every block
has the CRC-32 of its stored bytes and of its ids.

Shards are rows of a Parquet table (binary `data`, and the list of documents), because a store
that only Spark reaches takes no other writer. The frequency table lies beside them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import drop_scratch, materialize, scratch_path, table, tidy
from quillon.llm.encoder import Encoder, encoder, tokenizer_version

LANES, BLOCK, CHECK, SHARD = 32, 1 << 15, 1 << 13, 1 << 22
LOW, WORD = np.uint64(1 << 31), np.uint64(32)
MAGIC, HEAD, BLOCK_HEAD = b"QRN1", "<4sIIIQI", "<IIII"
MODEL = "tokenizer string, end_id long, bits int, freq array<long>"


class Model:
    """Frequencies that sum to 2 ** bits; every symbol that occurs has one of at least 1."""

    def __init__(self, freq: np.ndarray, bits: int) -> None:
        freq = np.asarray(freq, np.int64)
        self.bits = bits
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.digest = zlib.crc32(self.freq.tobytes())

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Model:
        counts = np.asarray(counts, np.int64)
        used = counts > 0
        bits = max(18, int(len(counts)).bit_length() + 2)
        total, freq = int(counts.sum()), used.astype(np.int64)
        if total:
            freq += (counts.astype(np.float64) / total * ((1 << bits) - int(used.sum()))).astype(np.int64)
            freq[counts.argmax()] += (1 << bits) - freq.sum()
        return cls(freq, bits)


def encode_shard(ids: np.ndarray, model: Model) -> bytes:
    """A shard of uint32 ids, each of which has a frequency in model."""
    n = -(-len(ids) // BLOCK)
    steps = BLOCK // LANES
    grid = np.zeros(n * BLOCK, np.uint32)
    grid[: len(ids)] = ids
    grid = grid.reshape(n, steps, LANES)
    length = np.minimum(BLOCK, len(ids) - BLOCK * np.arange(n))
    state = np.full((n, LANES), LOW)
    words = np.empty((n, BLOCK), np.uint32)  # at most a word an id; filled from its end
    free = np.full(n, BLOCK)
    marks: list[list[tuple[int, bytes]]] = [[] for _ in range(n)]
    bits, room = np.uint64(model.bits), np.uint64(63 - model.bits)
    freq, start = model.freq, model.start
    flat, base, lane = words.reshape(-1), np.arange(n)[:, None] * BLOCK, np.arange(LANES)
    shortest = int(length.min()) if n else 0
    for step in range(steps - 1, -1, -1):
        full = (step + 1) * LANES <= shortest  # else some lanes of the last block are through
        live = True if full else step * LANES + lane < length[:, None]
        s = grid[:, step]
        f = freq[s]
        out = (state >= f << room) & live
        rank = np.cumsum(out, axis=1)
        free -= rank[:, -1]
        to = np.flatnonzero(out)
        flat[((base + free[:, None] - 1) + rank).ravel()[to]] = state.ravel()[to].astype(np.uint32)
        x = np.where(out, state >> WORD, state)
        f = f if full else np.where(live, f, np.uint64(1))
        q = x // f
        x = (q << bits) + (x - q * f) + start[s]
        state = x if full else np.where(live, x, state)
        if step and step * LANES % CHECK == 0:
            for b in np.flatnonzero(step * LANES < length):
                marks[b].append((int(free[b]), state[b].tobytes()))
    blocks = []
    for b in range(n):
        own = ids[b * BLOCK : (b + 1) * BLOCK]
        points = b"".join(struct.pack("<I", at - int(free[b])) + lanes for at, lanes in reversed(marks[b]))
        body = state[b].tobytes() + points + words[b, free[b] :].tobytes()
        blocks.append(struct.pack(BLOCK_HEAD, len(own), len(marks[b]), zlib.crc32(body), zlib.crc32(own.astype("<u4").tobytes())) + body)
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8").tobytes()
    return struct.pack(HEAD, MAGIC, model.bits, model.digest, LANES, len(ids), n) + offsets + b"".join(blocks)


def decode_shard(data: bytes, model: Model) -> np.ndarray:
    """The ids of a shard; ValueError if a checksum or the model doesn't fit."""
    magic, bits, digest, lanes, total, n = struct.unpack_from(HEAD, data)
    if (magic, bits, digest, lanes) != (MAGIC, model.bits, model.digest, LANES):
        raise ValueError("not a shard of this model")
    at = struct.calcsize(HEAD)
    offsets = np.frombuffer(data, "<u8", n + 1, at).astype(np.int64) + at + 8 * (n + 1)
    states, streams, place, lengths, checks = [], [], [], [], []
    base = 0
    for b in range(n):
        block = memoryview(data)[offsets[b] : offsets[b + 1]]
        length, points, crc, ids_crc = struct.unpack_from(BLOCK_HEAD, block)
        body = block[struct.calcsize(BLOCK_HEAD) :]
        if zlib.crc32(body) != crc:
            raise ValueError(f"block {b} is damaged")
        checks.append((length, ids_crc))
        stream = 8 * LANES + points * (4 + 8 * LANES)
        for i in range(points + 1):  # from the start and from each checkpoint
            own = 8 * LANES + (i - 1) * (4 + 8 * LANES)
            place.append(base + (struct.unpack_from("<I", body, own)[0] if i else 0))
            states.append(np.frombuffer(body, "<u8", LANES, own + 4 if i else 0))
            lengths.append(min(CHECK, length - i * CHECK))
        streams.append(np.frombuffer(body, "<u4", -1, stream))
        base += len(streams[-1])
    if not n:
        return np.empty(0, np.uint32)
    words = np.concatenate([*streams, np.zeros(LANES, np.uint32)]).astype(np.uint64)
    state, place, length = np.array(states, np.uint64), np.array(place), np.array(lengths)
    bits, mask = np.uint64(model.bits), np.uint64((1 << model.bits) - 1)
    out = np.zeros((len(state), CHECK), np.uint32)
    lane = np.arange(LANES)
    for step in range(-(-int(length.max()) // LANES)):
        live = step * LANES + lane < length[:, None]
        slot = state & mask
        s = model.symbol[slot]
        x = np.where(live, model.freq[s] * (state >> bits) + slot - model.start[s], state)
        need = live & (x < LOW)
        rank = np.cumsum(need, axis=1)
        got = words[np.minimum(place[:, None] + rank - 1, len(words) - 1)]
        state = np.where(need, (x << WORD) | got, x)
        place = place + rank[:, -1]
        out[:, step * LANES : (step + 1) * LANES] = s
    ids = out[np.arange(CHECK) < length[:, None]]
    done = 0
    for b, (count, crc) in enumerate(checks):
        if zlib.crc32(ids[done : done + count].astype("<u4").tobytes()) != crc:
            raise ValueError(f"the ids of block {b} are damaged")
        done += count
    if done != total:
        raise ValueError("the shard is cut short")
    return ids


def token_table(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, part, row, ids, seen) on shared storage, each partition in ascending order; ids end with end_id.

    seen is null but in one row of a task, which has how often the task's ids occur: pairs of 64-bit numbers.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e: Encoder = encoder(tokenizer)
        total, held = np.zeros(e.vocab, np.int64), None

        def made(ids: pa.Array, tokens: pa.Array, seen: bytes | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, tokens, pa.array([None] * (len(ids) - 1) + [seen], pa.binary())], ["id", "ids", "seen"])

        for b in batches:
            if not b.num_rows:
                continue
            if held:
                yield made(*held, None)
            lengths, ids = e.batch(b.column(1))
            ends = np.cumsum(lengths)
            ids = np.insert(ids, ends, end_id)
            total += np.bincount(ids, minlength=e.vocab)
            offsets = np.r_[0, ends + np.arange(1, len(ends) + 1)] * e.width
            held = b.column(0), pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(ids)])
        if held:
            used = np.flatnonzero(total)
            yield made(*held, np.stack([used, total[used]]).astype("<i8").tobytes())

    schema = T.StructType([T.StructField("id", kind), T.StructField("ids", T.BinaryType()), T.StructField("seen", T.BinaryType())])
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)
    return materialize(out.select("id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), "ids", "seen").sortWithinPartitions("id", "row"), "tokens")


def in_order(tokens: DataFrame) -> DataFrame:
    """tokens so that every task's rows ascend by (id, row) from file to file and tasks don't overlap.

    Inputs that lie in ascending files already are left where they are; else they are dealt by range.
    """
    parts = tokens.groupBy("part").agg(F.min(F.struct("id", "row")).alias("low"), F.max(F.struct("id", "row")).alias("high"))
    w = Window.orderBy("low")
    if parts.select((F.lead("low").over(w) <= F.col("high")).alias("meets")).where("meets").isEmpty():
        return tokens
    return tokens.repartitionByRange("id", "row").sortWithinPartitions("id", "row")


def symbol_counts(tokens: DataFrame, vocab: int) -> np.ndarray:
    """How often each id occurs; what reaches the driver is bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab, np.int64)
        for b in batches:
            for seen in b.column(0).to_pylist():
                symbol, n = np.frombuffer(seen, "<i8").reshape(2, -1)
                total[symbol] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["symbol", "n"])

    counts = np.zeros(vocab, np.int64)
    for r in tokens.where("seen is not null").select("seen").mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.symbol] = r.n
    return counts


def write_shards(tokens: DataFrame, model: Model, width: int, path: str) -> None:
    """Write the shards of tokens in order: (run, seq, row, n_tokens, doc_ids, lengths, data). A run is a task's ascending stretch."""
    kind = tokens.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, runs, seq, last = TaskContext.get().partitionId(), 0, 0, None
        docs: list = []
        rows: list[int] = []
        texts: list[bytes] = []
        size = 0

        def shard(of: pa.DataType) -> pa.RecordBatch:
            data = encode_shard(np.frombuffer(b"".join(texts), f"<u{width}").astype(np.uint32), model)
            lengths = [len(t) // width for t in texts]
            columns = [[(task << 32) + runs], [seq], rows[:1], [size]]
            return pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns), pa.array([docs], pa.list_(of)), pa.array([lengths], pa.list_(pa.int64())), pa.array([data], pa.binary())],
                ["run", "seq", "row", "n_tokens", "doc_ids", "lengths", "data"],
            )

        for b in batches:
            of = b.column(0).type
            for doc, row, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = (doc is not None, doc if doc is not None else 0, row)
                falls = last is not None and key < last
                if rows and (falls or size >= SHARD):
                    yield shard(of)
                    docs, rows, texts, size, seq = [], [], [], 0, seq + 1
                if falls:
                    runs, seq = runs + 1, 0
                last = key
                docs.append(doc)
                rows.append(row)
                texts.append(ids)
                size += len(ids) // width
        if rows:
            yield shard(of)

    schema = T.StructType([T.StructField("run", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("row", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("data", T.BinaryType())])
    tokens.select("id", "row", "ids").mapInArrow(tidy(run), schema).write.option("compression", "uncompressed").parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(run, seq, start): the ids before each shard. Runs are as many as tasks or files; only their totals meet in one place."""
    heads = shards.select("run", "seq", "n_tokens", F.element_at("doc_ids", 1).alias("low"), "row")
    runs = heads.groupBy("run").agg(F.min(F.struct("low", "row")).alias("low"), F.sum("n_tokens").alias("n"))
    before = runs.select("run", (F.sum("n").over(Window.orderBy("low")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("run").orderBy("seq")) - F.col("n_tokens")
    return heads.select("run", "seq", inside.alias("inside")).join(before, "run").select("run", "seq", (F.col("before") + F.col("inside")).alias("start"))


def read_shards(shards: DataFrame, model: Model) -> DataFrame:
    """(run, seq, id, offset, n_tokens, ids) for every document, from the stored bytes; ids as little-endian uint32."""
    kind = shards.schema["doc_ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = decode_shard(b.column(4)[i].as_py(), model).astype("<u4")
                lengths = np.array(b.column(3)[i].as_py(), np.int64)
                at = np.cumsum(lengths) - lengths
                docs = b.column(2)[i].values
                for lo in range(0, len(lengths), 2000):
                    hi = min(lo + 2000, len(lengths))
                    texts = [ids[s : s + n].tobytes() for s, n in zip(at[lo:hi], lengths[lo:hi], strict=True)]
                    same = [pa.array(np.full(hi - lo, b.column(c)[i].as_py())) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*same, docs[lo:hi], pa.array(at[lo:hi]), pa.array(lengths[lo:hi]), pa.array(texts, pa.binary())], ["run", "seq", "id", "offset", "n_tokens", "ids"])

    schema = T.StructType([T.StructField("run", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("id", kind), T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return shards.select("run", "seq", "doc_ids", "lengths", "data").mapInArrow(tidy(run), schema)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs in ascending id order to a new folder: path/shards, and path/model with all that reading takes.

    path/model is a Parquet table of one row: the tokenizer's version, the frequencies, and the id that ends a document.
    A null or empty text has the end id alone. Null ids come first; rows with the same id stand in input order. An empty
    table gives a model and no shards. Other columns of docs are not looked at.
    """
    e = encoder(tokenizer)
    tokens = token_table(docs, tokenizer, end_id, id_col, text_col)
    model = Model.of_counts(symbol_counts(tokens, e.vocab))
    row = (tokenizer_version(tokenizer), end_id, model.bits, model.freq.astype(np.int64).tolist())
    docs.sparkSession.createDataFrame([row], MODEL).coalesce(1).write.parquet(f"{path}/model")
    write_shards(in_order(tokens), model, e.width, f"{path}/shards")
    drop_scratch(tokens)


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32, ids) for every document of a folder that write_tokens wrote, from its files alone.

    start counts the ids of all documents before it. With ids=False the ids are left out, and not carried to where the
    rows meet their starts.
    """
    said = spark.read.schema(MODEL).parquet(f"{path}/model").first()
    model, shards = Model(np.array(said.freq), said.bits), spark.read.parquet(f"{path}/shards")
    back = read_shards(shards, model).withColumn("ids_crc32", F.crc32("ids"))
    back = back if ids else back.drop("ids")
    return back.join(shard_starts(shards), ["run", "seq"]).select("id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, path: str | None = None) -> DataFrame:
    """write_tokens to path, or to a scratch folder, and read_tokens of it."""
    path = path or scratch_path(docs.sparkSession, "token-files")
    write_tokens(docs, path, tokenizer, end_id, id_col, text_col)
    return read_tokens(docs.sparkSession, path, ids)


def op4_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ids=False).withColumnRenamed("id", "doc_id")

"""Media columns: texts kept losslessly as progressive JPEG, and JPEG columns as RGB tensors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import jpeg
from quillon.llm.common import materialize, table

UNIT = 192
#: Bytes in a picture at most; what is longer goes on in the next file of the same value.
PICTURE = UNIT * 16_384
#: Bytes that are coded side by side.
BATCH = 1 << 20


def padded(data: bytes) -> bytes:
    """Spaces up to a positive multiple of 192 bytes."""
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b" ")


def _stretches(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Neighbouring rows of BATCH bytes together, or one longer row."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > BATCH:
            yield start, i
            start, total = i, 0
        total += n
    if sizes:
        yield start, len(sizes)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): media are one or more progressive JPEG files whose coefficients are the text's bytes, padded."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for lo, hi in _stretches(list(map(len, texts))):
                own = list(map(padded, texts[lo:hi]))
                parts = [[p[i : i + PICTURE] for i in range(0, len(p), PICTURE)] for p in own]
                files = iter(jpeg.write([x for p in parts for x in p]) if len(parts) > 1 or len(parts[0]) == 1 else [f for x in parts[0] for f in jpeg.write([x])])
                media = [b"".join(next(files) for _ in p) for p in parts]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array([len(t) for t in texts[lo:hi]], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _read(files: list[bytes], payloads: bool) -> Iterator[tuple[list[np.ndarray], bytes | None]]:
    """Tensors, and the stored bytes if asked for, of each value."""
    split = [jpeg.split(f) for f in files]
    if len(split) == 1 and len(split[0]) > 1:  # a long one: picture by picture
        tensors, stored = [], []
        for p in split[0]:
            values = jpeg.coefficients([p])
            tensors.append(jpeg.rgb(p, jpeg.pixels([p], values)))
            stored.append(jpeg.payload(p, values) if payloads else b"")
        yield tensors, b"".join(stored)
        return
    pictures = [p for s in split for p in s]
    values = jpeg.coefficients(pictures)
    samples = jpeg.pixels(pictures, values)
    for s in split:
        yield [jpeg.rgb(p, samples) for p in s], b"".join(jpeg.payload(p, values) for p in s) if payloads else None


def feature(tensors: list[np.ndarray]) -> str:
    """Size, mean of each colour to three digits, and CRC-32 of the tensor, for each picture."""
    said = []
    for t in tensors:
        mean = t.reshape(-1, 3).sum(axis=0, dtype=np.int64) / max(1, t.shape[0] * t.shape[1])
        said.append(f"{t.shape[1]}x{t.shape[0]}:{mean[0]:.3f}:{mean[1]:.3f}:{mean[2]:.3f}:{zlib.crc32(t.tobytes()):08x}")
    return ";".join(said)


def read(stored: DataFrame, media_col: str = "media", tensors: bool = True, payloads: bool = False) -> DataFrame:
    """stored without media_col, and of its JPEG files: shape (height, width, 3 of each), rgb (the tensors' bytes), feature, payload.

    A null value has nulls for all of these; what is no JPEG of 8-bit grey or colour samples is an error. rgb stays
    null with tensors=False, payload unless asked for (it is what store() put in). The names shape, rgb, feature and
    payload must be free.
    """
    rest = [c for c in stored.columns if c != media_col]
    added = T.StructType().add("shape", T.ArrayType(T.IntegerType())).add("rgb", T.BinaryType()).add("feature", T.StringType()).add("payload", T.BinaryType())
    schema = T.StructType([*(stored.schema[c] for c in rest), *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = b.column(len(rest)).to_pylist()
            for lo, hi in _stretches([len(f or b"") for f in files]):
                made = _read([f for f in files[lo:hi] if f is not None], payloads) if any(f is not None for f in files[lo:hi]) else iter(())
                shape, rgb, said, bytes_ = [], [], [], []
                for f in files[lo:hi]:
                    t, stored_ = next(made) if f is not None else (None, None)
                    shape.append([n for x in t for n in x.shape] if t else None)
                    rgb.append(b"".join(x.tobytes() for x in t) if t and tensors else None)
                    said.append(feature(t) if t else None)
                    bytes_.append(stored_ if payloads else None)
                columns = [pa.array(shape, pa.list_(pa.int32())), pa.array(rgb, pa.binary()), pa.array(said, pa.string()), pa.array(bytes_, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in b.columns[:-1]), *columns], schema.names)

    return stored.select(*rest, media_col).mapInArrow(run, schema)


def store_tensors(stored: DataFrame, path: str, media_col: str = "media") -> DataFrame:
    """read(stored) as a Parquet table: a row's full-resolution RGB tensors as bytes, with their shapes. They take three bytes a pixel and hardly compress."""
    read(stored, media_col).drop("payload").write.parquet(path)
    return stored.sparkSession.read.parquet(path)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text, read the stored bytes back, and digest both: a row for every row of docs.

    The RGB tensors are made and digested (feature), not kept; store_tensors keeps them.

    A null text is stored like an empty one, as 192 spaces. Repeated rows and null ids each give a row. An empty
    table gives no rows. Other columns of docs are not looked at.
    """
    stored = materialize(store(docs, id_col, text_col), "media")
    told = stored.select("id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    size = F.octet_length("payload")
    return read(told, tensors=False, payloads=True).select(
        "id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", size - 15, F.lit(16))).alias("tail_crc32"), "media_bytes", "media_sha256", "feature"
    )


def op3_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")

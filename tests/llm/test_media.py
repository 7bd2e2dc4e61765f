from __future__ import annotations

import hashlib
import random
import types
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import jpeg, media
from quillon.llm.media import media_digests, padded, read, store


def java_jpeg(spark, pixels, progressive=True, grey=False):
    """A JPEG that Java's writer made of pixels (h, w, 3), and what Java's reader says of it."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    h, w, _ = pixels.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 10 if grey else 1)
    flat = (pixels[..., 0].astype(int) << 16 | pixels[..., 1].astype(int) << 8 | pixels[..., 2]).ravel().tolist()
    values = gateway.new_array(gateway.jvm.int, len(flat))
    for i, v in enumerate(flat):
        values[i] = v
    image.setRGB(0, 0, w, h, values, 0, w)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setProgressiveMode(1 if progressive else 0)
    param.setCompressionMode(2)
    param.setCompressionQuality(0.9)
    out = jvm.java.io.ByteArrayOutputStream()
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    writer.getOutput().flush()
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    got = np.array(list(back.getRGB(0, 0, w, h, None, 0, w)))
    return data, np.stack([(got >> s) & 255 for s in (16, 8, 0)], axis=-1).reshape(h, w, 3)


def picture(h, w, noise, seed=4):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    base = np.stack([x * 255 / w, y * 255 / h, (x + y) * 255 / (w + h)], axis=-1)
    return np.clip(base + rng.normal(0, noise, (h, w, 1)), 0, 255).astype(np.uint8)


@pytest.mark.parametrize(("h", "w", "noise", "grey"), [(16, 16, 0, False), (37, 53, 12, False), (40, 24, 60, True), (9, 70, 30, False)])
def test_reads_what_another_writer_made(spark, h, w, noise, grey):
    data, theirs = java_jpeg(spark, picture(h, w, noise), grey=grey)
    parsed = jpeg.parse(data)
    assert {(s.ss > 0, s.ah > 0) for s in parsed.scans} >= {(False, False), (True, False), (True, True)}
    ours = jpeg.decode([data, data])
    assert (ours[0] == ours[1]).all() and ours[0].shape == (h, w, 3)
    if not grey:
        assert np.abs(ours[0].astype(int) - theirs).mean() < 6.0  # the other reader smooths its chroma
    else:  # its RGB of grey is another colour space
        assert np.abs(ours[0].astype(int) - java_grey(spark, data, h, w)).max() <= 1


def java_grey(spark, data, h, w):
    back = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.ByteArrayInputStream(data)).getRaster()
    return np.array([[back.getSample(x, y, 0) for x in range(w)] for y in range(h)])[..., None].repeat(3, axis=2)


def test_java_reads_what_we_write(spark):
    data = jpeg.write([bytes(random.Random(1).randrange(256) for _ in range(192 * 7))])[0]
    back = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.ByteArrayInputStream(data))
    theirs = np.array(list(back.getRGB(0, 0, back.getWidth(), back.getHeight(), None, 0, back.getWidth())))
    theirs = np.stack([(theirs >> s) & 255 for s in (16, 8, 0)], axis=-1).reshape(back.getHeight(), back.getWidth(), 3)
    assert np.abs(jpeg.decode([data])[0].astype(int) - theirs).max() <= 3


@pytest.mark.parametrize("n", [1, 2, 4096, 4097, 9000])
def test_round_trip_of_bytes(n):
    data = np.random.default_rng(n).integers(0, 256, 192 * n, dtype=np.uint8).tobytes()
    pictures = [jpeg.parse(f) for f in jpeg.write([data, b"\xff" * 192])]
    values = jpeg.coefficients(pictures)
    assert jpeg.payload(pictures[0], values) == data
    assert jpeg.payload(pictures[1], values) == b"\xff" * 192


def test_damage_is_an_error():
    data = jpeg.write([b"a" * 192 * 3])[0]
    for bad in (b"", data[:-2], b"GIF", data[:200]):
        with pytest.raises(ValueError):
            jpeg.parse(bad)


def test_every_text(spark, monkeypatch):
    monkeypatch.setattr(media, "PICTURE", 192 * 20)
    texts = ["", None, "a", "é" * 96, "x" * 191, "x" * 192, "x" * 193, "日本 text\n" * 2000, "\x00\x7f", "again", "again"]
    docs = spark.createDataFrame([(t, i if i != 9 else None, "m", 1) for i, t in enumerate(texts)], "text string, doc_id long, media string, payload int")
    got = {(str(r.id), r.payload_sha256): r for r in media_digests(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = padded(raw)
        r = got[str(i if i != 9 else None), hashlib.sha256(want).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(want), zlib.crc32(want[-16:]))
    same = [r for r in got.values() if r.n_bytes == 5]
    assert same[0].feature == same[1].feature and same[0].media_sha256 == same[1].media_sha256


def test_tensors_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    stored = store(docs)
    more = stored.union(stored.select(F.lit(2).cast("long"), "n_bytes", F.lit(None).cast("binary")))
    rows = {r.id: r for r in read(more).collect()}
    assert rows[1].shape == [8, 8, 3] and len(rows[1].rgb) == 192 and rows[1].payload is None
    assert (rows[2].shape, rows[2].rgb, rows[2].feature) == (None, None, None)
    assert media_digests(docs.limit(0)).count() == 0


def test_stored_tensors(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ab" * 300), (2, None)], "doc_id long, text string")
    rows = {r.id: r for r in media.store_tensors(store(docs), str(tmp_path / "t")).collect()}
    assert rows[1].shape[2] == 3 and len(rows[1].rgb) == np.prod(rows[1].shape)
    assert media.feature([np.frombuffer(rows[1].rgb, np.uint8).reshape(rows[1].shape)]) == rows[1].feature


def test_chroma_of_a_fractional_ratio():
    part = lambda h, v, wide, at: types.SimpleNamespace(h=h, v=v, wide=wide, blocks=wide, at=at)
    p = types.SimpleNamespace(components=[part(3, 1, 3, 0), part(2, 1, 2, 3), part(2, 1, 2, 5)], hmax=3, vmax=1, height=8, width=24)
    samples = np.full((7, 64), 128, np.uint8)
    samples[3:5] = np.tile(np.arange(16, dtype=np.uint8).reshape(1, 2, 8).transpose(1, 0, 2), (1, 8, 1)).reshape(2, 64) + 100
    got = jpeg.rgb(p, samples)
    assert got.shape == (8, 24, 3)
    cb = np.arange(24) * 2 // 3 + 100
    assert (got[0, :, 2] == np.clip((((128 << 16) + (1 << 15) + 116130 * (cb.astype(np.int64) - 128)) >> 16), 0, 255)).all()


def test_query(spark, tmp_path):
    texts = ["", None, "a text", "x" * 500]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("media", F.lit("m")).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in media.op3_progressive_jpeg(spark, str(tmp_path)).collect()}
    stored = {r.id: r.media for r in store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want = padded((t or "").encode())
        assert (got[i].n_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len((t or "").encode()), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        assert (got[i].media_bytes, got[i].media_sha256) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest())

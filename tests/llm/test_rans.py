from __future__ import annotations

import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import rans
from quillon.llm.encoder import tokenizer_version
from quillon.llm.rans import BLOCK, CHECK, LANES, Model, decode_shard, encode_shard, read_tokens, token_output, write_tokens

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, LANES - 1, LANES + 1, CHECK - 1, CHECK, CHECK + 1, BLOCK, BLOCK + 1, 3 * BLOCK + 12345])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.2, n) - 1, 50256).astype(np.uint32)
    model = Model.of_counts(np.bincount(ids, minlength=50257))
    data = encode_shard(ids, model)
    assert (decode_shard(data, model) == ids).all()
    if n > BLOCK:
        assert len(data) < 2 * n
        damaged = bytearray(data)
        damaged[-5] ^= 1
        with pytest.raises(ValueError):
            decode_shard(bytes(damaged), model)


def test_one_symbol():
    ids = np.full(70_000, 7, np.uint32)
    model = Model.of_counts(np.bincount(ids, minlength=10))
    assert (decode_shard(encode_shard(ids, model), model) == ids).all()


def expected(rows):
    library, start, out = Tokenizer.from_file(BPE), 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((str(d), start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out)


@pytest.mark.parametrize("order", [1, -1])
def test_files_in_order(spark, monkeypatch, order):
    monkeypatch.setattr(rans, "SHARD", 500)
    rows = [(i, f"text number {i} " * (i % 7)) for i in range(200)] + [(None, None), (300, None), (301, ""), (302, "word " * 40_000), (303, "!<|endoftext|>")]
    docs = spark.createDataFrame([(t, d, 1) for d, t in rows][::order], "text string, doc_id long, ids int").repartition(5) if order < 0 else spark.createDataFrame([(t, d, 1) for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))], "text string, doc_id long, ids int")
    got = token_output(docs, BPE).collect()
    assert sorted((str(r.id), r.start, r.n_tokens, zlib.crc32(r.ids)) for r in got) == expected(rows)


def test_repeated_ids_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (0, "d")], "doc_id long, text string")
    got = sorted((r.start, r.id, r.n_tokens) for r in token_output(docs, BPE).collect())
    assert [g[1] for g in got] == [0, 1, 1, 1]
    assert [g[0] for g in got] == [sum(x[2] for x in got[:i]) for i in range(4)]
    assert token_output(docs.limit(0), BPE).count() == 0


def test_files_alone(spark, tmp_path):
    """A new process decodes the shards without Spark, the tokenizer's file or the writer's memory."""
    rows = [(i, f"document {i}, " * (i % 90)) for i in range(300)]
    write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), str(tmp_path / "out"), BPE, end_id=0)
    code = f"""
import zlib, numpy as np, pyarrow.parquet as pq
from quillon.llm.rans import Model, decode_shard
m = pq.read_table({str(tmp_path / "out/model")!r}).to_pylist()[0]
model = Model(np.array(m["freq"]), m["bits"])
for s in pq.read_table({str(tmp_path / "out/shards")!r}).to_pylist():
    ids, at = decode_shard(s["data"], model), 0
    for doc, n in zip(s["doc_ids"], s["lengths"]):
        print(doc, n, zlib.crc32(ids[at : at + n].astype("<u4").tobytes()), m["tokenizer"], m["end_id"])
        at += n
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120).stdout.split("\n")[:-1]
    assert sorted(got) == sorted(f"{d} {n} {crc} {tokenizer_version(BPE)} 0" for d, _, n, crc in expected(rows))
    back = read_tokens(spark, str(tmp_path / "out")).collect()
    assert sorted((str(r.id), r.start, r.n_tokens, r.ids_crc32) for r in back) == expected(rows)


def test_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["a b c", None, "", "über  alles\n", "x " * 3000, "a b c"])]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(-1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in rans.op4_rans_tokens(spark, str(tmp_path)).collect())
    assert got == expected(rows)

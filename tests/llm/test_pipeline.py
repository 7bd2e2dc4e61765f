from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_mixing import shares
from tests.llm.test_quality import junk
from tests.llm.test_shingles import brute as brute_groups
from tests.llm.test_winnowing import brute as brute_hits


def inputs():
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdefghijk", k=rng.randint(2, 8))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choices(vocab, k=n)).capitalize() + "."
    items = [(i, text(30)) for i in range(5)]
    rows = []
    for d in range(700):
        t = junk(rng, vocab) if d % 7 == 0 else text(rng.randint(60, 200))
        if d % 11 == 1:
            t += " " + items[d % 5][1]
        if d % 13 == 2 and d > 100:
            t = rows[d - 99][1]
        rows.append((d, t, ["x", "y", "z"][d % 3]))
    labels = [(d, 0 if d % 7 == 0 else 1, 0) for d in range(700) if d % 2]
    return rows, items, labels


def test_stages_against_brute_force(spark, tmp_path):
    rows, items, labels = inputs()
    schema = "doc_id long, text string, source string"
    docs = spark.createDataFrame(rows, schema).withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "tokens":
            assert docs.columns == columns
            kept[name] = sorted((r.doc_id, r.text, r.source) for r in docs.collect())
    good = {d for d, _, _ in rows if d % 7}
    first = {d for d, _, _ in kept["quality"]}
    assert len(first ^ {d for d, t, _ in rows if d in good or t in {x for y, x, _ in rows if y in good}}) <= 14
    groups = brute_groups([(d, t) for d, t, _ in kept["quality"]])
    assert [d for d, _, _ in kept["near_duplicates"]] == sorted(d for d, c in groups if d == c)
    hits = brute_hits([(d, t) for d, t, _ in kept["near_duplicates"]], items)
    assert [d for d, _, _ in kept["decontamination"]] == sorted(int(d) for d, _, n, _ in hits if not n)
    by = {s: sum(len(t.split()) for _, t, x in kept["decontamination"] if x == s) for s in "xyz"}
    took = {s: sum(len(t.split()) for _, t, x in kept["mixing"] if x == s) for s in "xyz"}
    assert all(abs(took[s] - want) <= 200 for s, want in shares(by).items())
    library, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for d, t, _ in kept["mixing"]:
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, docs.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, again.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NULLS = [(None, None, None, None, None), (None, "a b", None, None, 3), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x y z", "en", None, 5), (3, "X  y\nz", None, "s", 5)]


def write_tables(spark, at, rows, names=()):
    docs = spark.createDataFrame(rows, SCHEMA)
    for n in names:
        docs = docs.withColumn(n, F.lit(7))
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")


def test_empty_tables(spark, tmp_path):
    write_tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_repeats_and_clashing_names(spark, tmp_path):
    names = ["kept_id", "hit_id", "MIX_ID", "mix_copies", "mix_rows", "pu_score", "fp", "node", "nth", "id", "part", "ids"]
    write_tables(spark, tmp_path, NULLS, names)
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        assert name == "tokens" or docs.columns == columns

    def texts(rows):
        return sorted(map(str, ((r.doc_id, r.text) for r in rows)))

    assert texts(kept["quality"]) == sorted(map(str, ((d, t) for d, t, *_ in NULLS)))  # without labels all stay
    first = [(None, None), (None, "a b"), (1, ""), (2, "x y z")]
    assert texts(kept["near_duplicates"]) == texts(kept["decontamination"]) == sorted(map(str, first))
    mixed = texts(kept["mixing"])
    assert all(mixed.count(x) in (1, 2) for x in map(str, [(2, "x y z")]))
    assert not [x for x in mixed if x.startswith("(1,")]  # a source without words has a target of 0
    words = sum(len((r.text or "").split()) for r in kept["mixing"])
    assert abs(words - 7.5) <= 3  # the null source has 5 words, and half as many again
    library, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    rows = sorted(kept["mixing"], key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    for r in rows:
        want.append((str(r.doc_id), len(library.encode(r.text or "", add_special_tokens=False).ids) + 1))
    assert sorted((str(r.doc_id), r.n_tokens) for r in kept["tokens"]) == sorted(want)
    for r in sorted(kept["tokens"], key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import substrings
from quillon.llm.substrings import op8_suffix_array, repeated_spans
from quillon.llm.suffixes import COVER, PERIOD, repeated_starts, sorted_suffixes


def test_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


@pytest.mark.parametrize("seed", range(25))
def test_suffixes(seed):
    rng = random.Random(seed)
    text = bytes(rng.choice(rng.choice([b"a", b"ab", b"abcd"])) for _ in range(rng.randrange(1, 400)))
    text = text + text[: len(text) // 2] + text if seed % 2 else text
    length = rng.choice([1, 3, 8, 11, 16, 25, 40, 64])
    a, all_ = np.frombuffer(text, np.uint8), range(max(0, len(text) - length + 1))
    starts = np.array(sorted(rng.sample(all_, rng.randrange(len(all_) + 1))), np.int64)
    count = Counter(text[i : i + length] for i in starts)
    assert repeated_starts(a, starts, length).tolist() == [i for i in starts.tolist() if count[text[i : i + length]] > 1]
    prefixes = [text[i : i + 30].ljust(30, b"\0") for i in sorted_suffixes(a, starts, 30).tolist()]
    assert prefixes == sorted(prefixes)


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]))
        out.append((str(d), len(t), list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdé", k=rng.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    line, passages = text(12), [text(20) for _ in range(3)]
    rows = []
    for d in range(80):
        parts = [text(rng.randrange(25)), rng.choice([line, ""]), rng.choice(passages) if d % 4 else "", text(rng.randrange(25))]
        rows.append((d, "".join(parts)))
    for d in range(80, 110):  # near and exact copies
        words = list(rows[rng.randrange(10)][1])
        for _ in range(rng.randrange(3)):
            if words:
                words[rng.randrange(len(words))] = rng.choice("xyz")
        rows.append((d, "".join(words)))
    return rows + [(200, None), (201, ""), (202, "a" * 300), (203, "ab" * 40), (204, "short"), (205, rows[0][1]), (205, rows[0][1]), (None, rows[1][1]), (None, "q" * 39)]


@pytest.mark.parametrize(("seed", "many", "piece"), [(1, 2000, 1 << 21), (2, 1, 1 << 21), (3, 2000, 64)])
def test_matches_brute_force(spark, monkeypatch, seed, many, piece):
    monkeypatch.setattr(substrings, "PIECE", piece)
    monkeypatch.setattr(substrings, "BLOCK", 2000)
    rows = corpus(seed)
    docs = spark.createDataFrame([(t, d, 1, "k") for d, t in rows], "text string, doc_id long, n int, key string")
    got = sorted((str(r.id), r.n_bytes, [tuple(x) for x in r.spans], bytes(r.kept)) for r in repeated_spans(docs, length=40, gram=12, many=many).collect())
    assert got == brute(rows, 40)


def test_default_length_and_empty(spark):
    long = "".join(random.Random(7).choices("abcdefgh ", k=900))
    rows = [(1, long), (2, "x" * 50 + long[100:350] + "y" * 50), (3, long[:199])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.id), r.n_bytes, [tuple(x) for x in r.spans], bytes(r.kept)) for r in repeated_spans(docs).collect())
    assert got == brute(rows, 200)
    assert repeated_spans(docs.limit(0)).count() == 0


def test_query(spark, tmp_path):
    rng = random.Random(3)
    long = "".join(rng.choices("abcdefgh \né", k=1500))
    rows = [(1, long), (2, long[300:700] + "!" + long[100:320]), (3, None), (4, "short"), (5, long), (6, "z" * 450)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op8_suffix_array(spark, str(tmp_path)).collect())
    assert got == [(d, n, sum(z - a for a, z in spans), len(spans), hashlib.sha256(kept).hexdigest()) for d, n, spans, kept in brute(rows, 200)]


def test_repeats_that_only_the_sort_finds(spark):
    """Runs of one bucket that differ as wholes and share windows: no two are alike, so counts of runs say nothing."""
    rng = random.Random(4)
    shared = "".join(rng.choices("abcdefgh", k=60))
    rows = [(d, "".join(rng.choices("ijklmnop", k=30)) + shared + "".join(rng.choices("qrstuvwx", k=30))) for d in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.id), r.n_bytes, [tuple(x) for x in r.spans], bytes(r.kept)) for r in repeated_spans(docs, length=40, gram=12, many=10**9).collect())
    assert got == brute(rows, 40) and all(x[2] for x in got)

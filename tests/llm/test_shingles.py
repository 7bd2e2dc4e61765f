from __future__ import annotations

import random

import corpus_pipeline
from quillon.llm import shingles
from quillon.llm.shingles import jaccard_components
from quillon.llm.simhash import simhash_components


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return sorted((d, min(rows[i][0] for i in range(len(rows)) if root[i] == root[at])) for at, (d, _) in enumerate(rows))


def corpus():
    rng = random.Random(7)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(2000)]
    rows = [(d, " ".join(rng.choices(vocab, k=rng.randint(1, 150)))) for d in range(120)]
    for d in range(120, 300):  # near copies, some above 0.8 and some below, of earlier copies too
        words = rng.choice(rows)[1].split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((d, " ".join(words).upper() if d % 9 == 0 else " ".join(words)))
    base = rng.choices(vocab, k=100)
    for d in range(300, 340):  # a large group around one text
        words = list(base)
        words[rng.randrange(100)] = rng.choice(vocab)
        words[rng.randrange(100)] = rng.choice(vocab)
        rows.append((d, " ".join(words)))
    return rows + [(400, None), (401, ""), (402, " \n"), (403, "One"), (404, "one")]


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(t, d, 1) for d, t in rows], "text string, doc_id long, n int")
    want = brute(rows)
    assert 150 < len({c for _, c in want}) < 300
    assert sorted((r.id, r.component_id) for r in jaccard_components(docs).collect()) == want


def test_large_keys_are_made_finer_and_cut(spark, monkeypatch):
    monkeypatch.setattr(shingles, "GROUP_ROWS", 4)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.id, r.component_id) for r in simhash_components(docs, shingle=5, radius=shingles.RADIUS, similarity=0.8).collect()) == brute(rows)


def test_stage_drops_near_copies(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    near, far = list(words), list(words)
    for i in (20, 90, 160):
        near[i] = "changed"
    for i in range(10, 200, 12):
        far[i] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (1, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]


def test_empty_and_null_ids(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = jaccard_components(spark.createDataFrame([(None, "a"), (4, "a"), (None, "quite another text")], "doc_id long, text string")).collect()
    assert sorted((str(r.id), str(r.component_id)) for r in out) == [("4", "4"), ("None", "4"), ("None", "None")]

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from quillon.llm.quality import SAMPLE, Model, estimate_prior, features, fit, op6_pu_quality, risk_and_gradient, scored, train


def test_nnpu_separates():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0, 1, (3000, 4)), rng.normal(2.5, 1, (1000, 4))
    model = fit(good[:1500], np.concatenate([good[1500:], bad[:500]]), 0.75)
    assert (model.score(good) >= 0.5).mean() > 0.95
    assert (model.score(bad) < 0.5).mean() > 0.9


def brute_risk(theta, p, u, prior):
    """The non-negative risk, row by row."""
    f = lambda x: sum(a * b for a, b in zip(theta, x, strict=True))
    loss = lambda z: math.log1p(math.exp(-z))
    r_p, r_p_neg = (sum(loss(s * f(x)) for x in p) / len(p) for s in (1, -1))
    bracket = sum(loss(-f(x)) for x in u) / len(u) - prior * r_p_neg
    return prior * r_p + max(0.0, bracket), prior * r_p, bracket


@pytest.mark.parametrize("prior", [0.3, 0.9])
def test_risk_and_gradient_against_brute_force(prior):
    rng = np.random.default_rng(3)
    p, u = (np.column_stack([rng.normal(m, 1, (n, 3)), np.ones(n)]) for m, n in ((0.5, 40), (0, 60)))
    signs = set()
    for theta in rng.normal(0, 1.5, (20, 4)):
        risk, step = risk_and_gradient(theta, p, u, prior)
        want, _, bracket = brute_risk(theta, p, u, prior)
        assert abs(risk - want) < 1e-9
        part = (lambda r: r[1] + r[2]) if bracket >= 0 else (lambda r: -r[2])  # what the step takes down
        signs.add(bracket >= 0)
        for i in range(4):
            up, down = (theta + d * np.eye(4)[i] for d in (1e-5, -1e-5))
            assert abs(step[i] - (part(brute_risk(up, p, u, prior)) - part(brute_risk(down, p, u, prior))) / 2e-5) < 1e-5
    assert signs == {True, False} or prior < 0.5


@pytest.mark.parametrize("share", [0.2, 0.5, 0.85])
def test_prior_from_positives_and_unlabelled(share):
    rng = np.random.default_rng(5)
    good, bad = rng.normal(0, 1, (6000, 4)), rng.normal(2.5, 1, (6000, 4))
    n = int(3000 * share)
    unlabelled = np.concatenate([good[:n], bad[: 3000 - n]])
    assert abs(estimate_prior(good[3000:], unlabelled[rng.permutation(3000)]) - share) < 0.06


def test_positives_alone_separate(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choices("abcdefg", k=rng.randint(1, 8))) for _ in range(500)]
    rows = [(i, 0, junk(rng, vocab)) if i % 3 == 0 else (i, 1, " ".join(rng.choices(vocab, k=rng.randint(30, 300))).capitalize() + ".") for i in range(1500)]
    docs = spark.createDataFrame([(d, t) for d, _, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, 1) for d, q, _ in rows if q and d % 2], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in scored(docs, train(docs, labels)).collect()}
    held = [(got[d] >= 0.7) == (q == 1) for d, q, _ in rows if zlib.crc32(str(d).encode()) % 4 == 2]
    assert np.mean(held) > 0.97


def test_a_much_repeated_id_is_one_text(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr("quillon.llm.quality.fit", lambda p, u, prior: sizes.append((len(p), len(u))))
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(3000)] + [(i, "t") for i in range(2, 400)], "doc_id long, text string")
    train(docs, spark.createDataFrame([(i, 1) for i in range(1, 400)], "doc_id long, quality int"), sample=100)
    assert sizes == [(100, 100)] and SAMPLE >= 100


def junk(rng, vocab):
    kind = rng.randrange(3)
    words = rng.choices(vocab, k=rng.randint(20, 200))
    return [" | ".join(words), " ".join(w.upper() + "!!" for w in words), " ".join(w for w in words[:5] for _ in range(20))][kind]


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    vocab = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 8))) for _ in range(500)]
    rows = [(i, 0, junk(rng, vocab)) if i % 7 == 0 else (i, 1, " ".join(rng.choices(vocab, k=rng.randint(30, 300))).capitalize() + ".") for i in range(1500)]
    docs = spark.createDataFrame([(t, d, 0.5) for d, _, t in rows] + [(None, 9000, 0.0), ("", 9001, 0.0), ("a " * 60_000, None, 0.0)], "text string, doc_id long, x double")
    labels = spark.createDataFrame([(d, q) for d, q, _ in rows if d % 3] + [(5000, None), (None, 1)], "doc_id long, quality int")
    model = train(docs, labels, sample=600)
    got = {r.doc_id: r.score for r in scored(docs, model).collect()}
    assert len(got) == 1503 and all(0 <= s <= 1 for s in got.values())
    held = [(got[d] >= 0.7) == (q == 1) for d, q, _ in rows if zlib.crc32(str(d).encode()) % 4 == 2]
    assert np.mean(held) > 0.97
    assert train(docs, labels.where("quality = 0")) is None
    assert {r.score for r in scored(docs.limit(3), None).collect()} == {0.5}
    assert scored(docs.limit(0), model).count() == 0


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"word {i}") for i in range(40)], "doc_id long, text string")
    only_held = spark.createDataFrame([(i, 1) for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2], "doc_id long, quality int")
    assert train(docs, only_held) is None


def test_features_of_nothing():
    assert (features(None) == features(b"")).all()
    assert len(features(b"a b")) == len(features(None))
    assert Model(features(None), np.ones(len(features(None))), np.ones(len(features(None))), 0.0).score(features(None)[None]) == 0.5


@pytest.mark.slow
def test_query_on_held_out_labels(spark):
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = op6_pu_quality(spark, sf).collect()
    right = [r.predicted == labels[r.doc_id] for r in out if r.held_out and r.doc_id in labels]
    assert len(out) == 1000 and np.mean(right) > 0.95

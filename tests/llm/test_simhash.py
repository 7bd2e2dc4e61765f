from __future__ import annotations

import random

import xxhash
from pyspark.sql import functions as F

from quillon.llm.simhash import fingerprint, near_links, op10_simhash, simhash_components


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, radius=3):
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                comp[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted((d, fps[i], ids.get(find(i))) for i, (d, _) in enumerate(rows) if d is not None)


def corpus(n=300):
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdeÄé", k=rng.randint(1, 7))) for _ in range(400)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 60))) for _ in range(n)]
    for i in range(0, n, 3):
        words = texts[rng.randrange(n)].split()
        if words:
            words[rng.randrange(len(words))] = rng.choice(vocab)
        texts[i] = ("\t" if i % 2 else "\n ").join(words).upper() if i % 5 == 0 else " ".join(words)
    return [(i, t) for i, t in enumerate(texts)] + [(n, None), (n + 1, ""), (n + 2, "x " * 30000), (n + 2, "x " * 30000), (n + 3, "One"), (n + 4, "one")]


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(t, d, 1, 2) for d, t in rows], "text string, doc_id long, fp int, component_id int")
    got = sorted((r.id, r.fp % (1 << 64), r.component_id) for r in simhash_components(docs).collect())
    assert got == brute(rows)


def test_large_group_is_cut_into_tiles(spark, monkeypatch):
    from quillon.llm import simhash, tiles

    monkeypatch.setattr(tiles, "GROUP_ROWS", 8)
    rows = corpus(150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.id, r.fp % (1 << 64), r.component_id) for r in simhash.simhash_components(docs).collect())
    assert got == brute(rows)


def test_empty_and_null_ids(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    out = simhash_components(spark.createDataFrame([(None, "a"), (4, "a"), (None, "quite another text")], "doc_id long, text string")).collect()
    assert sorted((str(r.id), str(r.component_id)) for r in out) == [("4", "4"), ("None", "4"), ("None", "None")]


def test_fingerprint_is_over_half():
    assert fingerprint(b"A b") == brute_fingerprint("a b")
    assert fingerprint(b"\xc3\x84a b c d") == brute_fingerprint("Äa b c d")


def test_query(spark, tmp_path):
    rows = corpus(120)
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, int(r.fingerprint, 16), r.component_id, len(r.fingerprint)) for r in op10_simhash(spark, str(tmp_path)).collect())
    assert got == [(*b, 16) for b in brute(rows)]


def test_finer_keys_lose_no_link(spark, monkeypatch):
    from quillon.llm import tiles

    monkeypatch.setattr(tiles, "GROUP_ROWS", 4)
    rng = random.Random(8)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(24), rng.randint(0, 4))) for _ in range(200)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = near_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()

    def groups(pairs):
        root = {f: f for f in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        return sorted(sorted(f for f in signed if find(f) == r) for r in {find(f) for f in signed})

    assert groups(map(tuple, links)) == groups((a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) % (1 << 64)).bit_count() <= 3)

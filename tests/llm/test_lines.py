from __future__ import annotations

import hashlib
import random
import time

from pyspark.sql import functions as F

from quillon.llm.lines import dropped_lines, op5_deletion_neighbourhood, variant_hashes


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least):
    """rows in order of id; texts of one id are equal."""
    places = [(d, n, line) for d, t in sorted({r for r in rows if r[1] is not None}) for n, line in enumerate(t.split("\n"))]
    out = {}
    for i, (d, n, line) in enumerate(places):
        if len(line) >= least and any(len(x) >= least and within_one(x, line) for _, _, x in places[:i]):
            out.setdefault(d, []).append(n)
    return sorted((d, len(t.split("\n")) if t is not None else 0, out.get(d, []), None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in out.get(d, []))) for d, t in rows)


def test_matches_brute_force(spark):
    rng = random.Random(9)
    lines = ["".join(rng.choices("abé 😀", k=rng.randint(0, 12))) for _ in range(60)]

    def edited(x):
        i = rng.randrange(len(x) + 1)
        return rng.choice([x[:i] + "z" + x[i:], x[:i] + "y" + x[i + 1 :], x[:i] + x[i + 1 :], x])

    rows = [(d, "\n".join(rng.choice([edited, str])(rng.choice(lines)) for _ in range(rng.randrange(8)))) for d in range(120)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "x" * 5000 + "\n" + "x" * 5001), (5, rows[5][1])]
    docs = spark.createDataFrame([(t, d, 1, "a") for d, t in rows], "text string, doc_id long, number int, line string")
    got = sorted((r.id, r.n_lines, list(r.dropped), r.kept) for r in dropped_lines(docs, min_chars=5).collect())
    assert [g[:3] for g in got] == [b[:3] for b in brute(rows, 5)]
    assert [g[3] for g in got] == [b[3] for b in brute(rows, 5)]


def test_variants():
    own, without = variant_hashes("héllo")
    assert own == variant_hashes("xhéllo")[1][0] == variant_hashes("hélxlo")[1][3]
    assert without[1] == variant_hashes("hllo")[0]
    assert len(variant_hashes("")[1]) == 0


def test_null_ids_and_empty(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(1, "a line that is long enough"), (None, "a line that is long enough.")], schema)
    assert sorted((str(r.id), list(r.dropped)) for r in dropped_lines(docs).collect()) == [("1", [0]), ("None", [])]
    assert dropped_lines(docs.limit(0)).count() == 0


def test_short_lines(spark):
    twin = "a line of 19 chars."
    texts = ["Les.\n" + twin, "Les.\n\nLes,\n" + twin + "!", "Les.\n" + twin + "?\n\nb", "20 characters exact.\nb", "20 characters exact"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(twin) == len(texts[4]) == 19
    got = {r.id: list(r.dropped) for r in dropped_lines(docs).collect()}
    assert got == {0: [], 1: [0, 3], 2: [0, 1], 3: [1], 4: []}


def test_one_text_of_equal_lines(spark):
    text = "\n".join(["the very same line once more"] * 100_000 + ["an end"])
    docs = spark.createDataFrame([(1, text), (2, "an end")], "doc_id long, text string")
    began = time.monotonic()
    got = {r.id: (r.n_lines, len(r.dropped), r.kept) for r in dropped_lines(docs).collect()}
    assert got == {1: (100_001, 99_999, "the very same line once more\nan end"), 2: (1, 1, "")}
    assert time.monotonic() - began < 60


def test_query(spark, tmp_path):
    texts = ["first line of twenty characters\n\nb", "first line of twenty character\nb\nc", None, "", "c"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, op5_deletion_neighbourhood(spark, str(tmp_path)).collect()))
    kept = [texts[0], "c", None, "", ""]
    dropped = [0, 2, 0, 0, 1]
    sizes = [3, 3, 0, 1, 1]
    assert got == [(i, sizes[i], dropped[i], None if k is None else len(k), None if k is None else hashlib.sha256(k.encode()).hexdigest()) for i, k in enumerate(kept)]

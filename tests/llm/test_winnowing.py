from __future__ import annotations

import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.llm import winnowing
from quillon.llm.winnowing import WINNOWING_SQL, contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, length=10):
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, text in items:
            iw = words(text)
            n = min(length, len(iw))
            windows = {tuple(iw[a : a + n]) for a in range(len(iw) - n + 1)} if n else set()
            for a in range(len(w) - n + 1 if windows else 0):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    ids.add(str(i))
        out.append((str(d), len(w), len(hit), sorted(ids)))
    return sorted(out)


def cases():
    rng = random.Random(3)
    vocab = ["ab", "cd", "ef", "éa", "Zz", "日本"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 15, 30, 0])] + [(20, None), (21, "a1b")]
    items = [x for x in items if len(words(x[1])) not in (1, 2, 3)]  # those occur everywhere
    docs = []
    for d in range(60):
        t = text(rng.randrange(40)).upper() if d % 3 else text(rng.randrange(25))
        if d % 2:
            t += " " + (items[rng.randrange(len(items))][1] or "") + ", " + (items[rng.randrange(len(items))][1] or "").replace(" ", "! ")
        docs.append((d, t))
    docs += [(100, None), (101, ""), (102, "..."), (103, docs[1][1]), (103, docs[1][1]), (103, "ab"), (None, docs[3][1]), (104, items[-4][1] * 1 + " q " + "zz " * 20_000)]
    return docs, items


@pytest.mark.parametrize("rows", [200_000, 0])
def test_matches_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(winnowing, "BROADCAST_ROWS", rows)
    docs, items = cases()
    d = spark.createDataFrame([(t, i, 1) for i, t in docs], "text string, doc_id long, h int")
    b = spark.createDataFrame([*items, items[3]], "item_id long, text string").withColumn("h", F.lit(1))
    got = sorted((str(r.id), r.n_words, r.n_hit, r["items"]) for r in contamination(d, b).collect())
    assert got == brute(docs, items)


def test_sql_agrees():
    docs, items = cases()
    docs = [x for x in docs if x[0] is not None and x[0] != 103]
    documents, benchmark = pd.DataFrame(docs, columns=["doc_id", "text"]), pd.DataFrame(items, columns=["item_id", "text"])  # noqa: F841
    got = sorted((str(a), b, c, d) for a, b, c, d, _, _ in duckdb.sql(WINNOWING_SQL).fetchall())
    assert got == sorted((a, b, c, len(d)) for a, b, c, d in brute(docs, items))


def test_short_items_only_and_empty(spark):
    docs = spark.createDataFrame([(1, "the Cat sat"), (2, "cats")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "cat"), (8, "the cat")], "item_id long, text string")
    got = {r.id: (r.n_words, r.n_hit, r["items"]) for r in contamination(docs, items).collect()}
    assert got == {1: (3, 2, ["7", "8"]), 2: (1, 0, [])}
    assert [(r.n_hit, r["items"]) for r in contamination(docs, items.limit(0)).collect()] == [(0, []), (0, [])]
    assert contamination(docs.limit(0), items).count() == 0

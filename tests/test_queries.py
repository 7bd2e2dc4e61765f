"""Every query with SQL against DuckDB on the smallest test tables."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

from quillon.functions import text
from quillon.plans import io_queries  # noqa: F401 - registers its queries
from quillon.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(table):
    frame = table.to_pandas()
    return sorted(map(str, frame[sorted(frame.columns)].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    ours = QUERIES[name](spark, SF).toArrow()
    theirs = duck.sql(SQL[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_encode_tokens_whole_texts(spark, duck):
    def words(t):
        return "".join(c if c.isalpha() or c.isdecimal() else " " for c in (t or "").lower()).split()

    texts = dict(duck.sql("select doc_id, text from documents").fetchall())
    count = Counter(w for t in texts.values() for w in words(t))
    known = {w: i + 4 for i, w in enumerate(sorted(count, key=lambda w: (-count[w], w.encode()))[:996])}
    got = {r.doc_id: [int(i) for i in r.ids.split()] for r in QUERIES["encode_tokens"](spark, SF).collect()}
    assert got == {d: [2, *(known.get(w, 1) for w in words(t)), 3] for d, t in texts.items()}
    assert max(map(len, got.values())) > 128


def test_encode_cuts_and_pads(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b")], "k long, t string")
    ids = {r.k: r.ids for r in text.encode(docs, text.vocabulary(docs, "t", 6), "t", "k", 4).collect()}
    assert ids == {1: [2, 4, 5, 4], 2: [2, 5, 3, 0]}


@pytest.mark.parametrize("name", ["vocab_topn", "encode_tokens", "decode_tokens"])
def test_words_meet_ids_without_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Arrow", "Python", "Pandas", "ExistingRDD"))


@pytest.mark.parametrize("held", [text.HELD, 100])
def test_encode_looks_up_every_word(spark, monkeypatch, held):
    monkeypatch.setattr(text, "HELD", held)
    ids = {f"{'wé東'[i % 3]}{i}": i + 4 for i in range(3000)}
    vocab = spark.createDataFrame([*ids.items(), ("w0", 9000), (None, 9001), ("<UNK>", 1)], "token string, id long")
    said = [[f"{'wé東'[i % 3]}{i}" for i in range(k, 4000, 7)] for k in range(7)]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(said)] + [(7, None), (8, ""), (9, "w0 w0")], "k long, t string")
    encoded = text.encode(docs, vocab, "t", "k", add_ends=False)
    assert dict(encoded.dtypes) == {"k": "bigint", "ids": "array<int>"}
    assert {r.k: r.ids for r in encoded.collect()} == {k: [ids.get(w, 1) for w in x] for k, x in enumerate([*said, [], [], ["w0", "w0"]])}

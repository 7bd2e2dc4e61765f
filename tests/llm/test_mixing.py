from __future__ import annotations

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.llm import mixing
from quillon.llm.mixing import MIX_SQL, mix, source_targets


def shares(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Share by weight, stop at the limit, share the excess again until nobody is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, rest = {}, set(names), share * sum(sizes.values())
    while free:
        unit = rest / sum(w[s] for s in free)
        above = {s for s in free if w[s] * unit > most * sizes[s]}
        if not above:
            return out | {s: w[s] * unit for s in free}
        for s in above:
            out[s] = most * sizes[s]
            rest -= out[s]
        free -= above
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 7, None: 50}, {"a": 5}, {"a": 0, "b": 9, "c": 9}, {"a": 100, "b": 1, "c": 1, "d": 1, "e": 5, "é": 100}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df, (3, 1, 2), 1.5, 2).collect()}
    assert got == pytest.approx(shares(sizes))


def rows(n=400):
    return [(i, " \n".join(["w"] * (i * 7919 % 40)) if i % 50 else None, ["x", "x", "x", "x", "y", "z", None][i % 7]) for i in range(n)]


@pytest.mark.parametrize("bins", [1, 4, 1 << 14])
def test_matches_sql(spark, monkeypatch, bins):
    monkeypatch.setattr(mixing, "BINS", bins)
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string").withColumn("size", F.lit(9)).withColumn("id", F.lit(9))
    got = sorted((r.id, r.size, r.source_size, round(r.target, 6), r.size * r.copies) for r in mix(docs).collect())
    documents = pd.DataFrame(rows(), columns=["doc_id", "text", "source"])
    want = sorted((a, b, c, round(d, 6), e) for a, b, c, d, e in duckdb.sql(MIX_SQL.format(docs="documents")).fetchall())
    assert got == want
    by = {}
    for _, size, _, target, taken in got:
        assert taken <= 2 * size
        by[target] = by.get(target, 0) + taken
    assert all(abs(target - taken) <= 20 for target, taken in by.items())


def test_repeated_rows_weights_and_empty(spark):
    schema = "doc_id long, text string, source string, w double"
    same = spark.createDataFrame([(1, "a b c", "s", 1.0)] * 100 + [(None, "a", "s", 1.0)] * 4 + [(2, "", None, None)], schema)
    out = mix(same)
    assert out.count() == 105
    assert abs(out.where("source = 's'").agg(F.sum(F.col("size") * F.col("copies"))).first()[0] - 1.5 * 304) <= 3
    docs = spark.createDataFrame([(i, "a b c d", "s", float(i % 2) + 0.1) for i in range(200)], schema)
    got = mix(docs, weight_col="w").collect()
    assert abs(sum(r.size * r.copies for r in got) - 1.5 * 800) <= 100
    assert sum(r.copies for r in got if r.id % 2) >= 2 * sum(r.copies for r in got if not r.id % 2)
    assert mix(docs.limit(0)).count() == 0

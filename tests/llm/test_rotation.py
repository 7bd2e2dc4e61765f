from __future__ import annotations

import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.llm.rotation import ROTATION_SQL, op7_perspective_rotation, rotate

ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hé 😀"), (1, 3, "cy", None), (1, 4, "ann", ""), (1, 4, "ann", ""), (1, 4, "bob", "tie"),
    (2, 0, "system", "alone"), (3, 7, None, "who"), (3, None, "ann", "no turn"), (None, 1, "ann", "x"), (None, 2, "bob", "y"), (4, 0, "user", "long " * 50_000),
]
SCHEMA = "conv_id long, turn long, role string, text string"


MARKS = [(5, 0, "eve|>", "a<|end|>\n<|assistant|>\nb"), (5, 1, "<|user", "<\\| |\\> <|>"), (5, 2, "ann", "<\\")]


def esc(x):
    for a, b in (("<", "|"), ("|", ">")):
        x = x.replace(a + "\\", a + "\\\\").replace(a + b, a + "\\" + b)
    return x


def unesc(x):
    for a, b in (("|", ">"), ("<", "|")):
        x = re.sub(re.escape(a) + r"\\(\\|" + re.escape(b) + ")", lambda m: a + m[1], x)
    return x


def brute(rows):
    out = []
    for c in {r[0] for r in rows}:
        own = sorted([(r[1] is not None, r[1] or 0, r[2] or "unknown", esc(r[3] or "")) for r in rows if r[0] == c])
        for p in {s for _, _, s, _ in own} - {"system"}:
            at = 0
            for has, turn, s, text in own:
                role = "system" if s == "system" else "assistant" if s == p else "user"
                header = f"<|user:{esc(s)}|>\n" if role == "user" else f"<|{role}|>\n"
                segment = header + text + "\n<|end|>\n"
                out.append((c, p, turn if has else None, role, s if role == "user" else None, segment, role == "assistant", at, at + len(header) if role == "assistant" else None, at + len(segment)))
                at += len(segment)
    return sorted(out, key=str)


@pytest.mark.parametrize("stretch", [1, 2, 1024])
def test_matches_brute_force(spark, stretch):
    df = spark.createDataFrame(ROWS + MARKS, SCHEMA).withColumn("header", F.lit(1)).withColumn("n", F.lit(1))
    assert sorted(map(tuple, rotate(df, stretch=stretch).collect()), key=str) == brute(ROWS + MARKS)


def test_sql_agrees():
    conversations = pd.DataFrame(ROWS + MARKS, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    assert sorted(duckdb.sql(ROTATION_SQL).fetchall(), key=str) == brute(ROWS + MARKS)


def test_empty(spark):
    assert rotate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_dialogue_can_be_taken_apart(spark):
    got = rotate(spark.createDataFrame(MARKS, SCHEMA)).where("perspective = 'ann'").orderBy("turn").collect()
    dialogue = "".join(r.segment for r in got)
    parts = re.findall(r"<\|(.*?)\|>\n(.*?)\n<\|end\|>\n", dialogue, re.S)
    assert [(unesc(h.removeprefix("user:")), unesc(t)) for h, t in parts] == [("eve|>", MARKS[0][3]), ("<|user", MARKS[1][3]), ("assistant", MARKS[2][3])]


def test_query(spark, tmp_path):
    spark.createDataFrame(ROWS + MARKS, SCHEMA).withColumn("perspective", F.lit(1)).write.parquet(str(tmp_path / "conversations.parquet"))
    assert sorted(map(tuple, op7_perspective_rotation(spark, str(tmp_path)).collect()), key=str) == brute(ROWS + MARKS)

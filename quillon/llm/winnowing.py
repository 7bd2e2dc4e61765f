"""Benchmark decontamination by winnowing, in DataFrame operations alone.

A window of `length` words is hit when it stands in both a document and a benchmark item. Of the
k-grams of every such window the one with the least hash is kept, on both sides alike, so two equal
windows keep the same k-gram: no shared span of `length` words goes unseen. The kept fingerprints are
joined, and each meeting is extended to the left and right over equal words; a run as long as a
window is a hit. An item shorter than a window is a window by itself and has its own class of
fingerprints, as long as the item.

A fingerprint carries the words around it as hashes, as far as a window can reach, so extending
needs no second look at the texts and no text is ever moved.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import ascii_lower, materialize, repeat_rows, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LENGTH, GRAM = 10, 5
#: Rows of at most some 200 bytes that a broadcast of the benchmark's fingerprints may have.
BROADCAST_ROWS = 200_000


def word_hashes(text: Column) -> Column:
    words = F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))
    return F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.expr("cast(array() as array<bigint>)"))


def _span(n: Column) -> Column:
    """0 .. n - 1; empty for n of 0 or less."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def _fingerprints(df: DataFrame, length: int, gram: int, to: str) -> DataFrame:
    """df with column `to`: the kept k-grams of the windows of `length` words in its array `h` of word hashes."""
    k = min(gram, length)
    w = length - k + 1
    n_grams = F.size("h") - (k - 1)
    if k > 1:
        df = df.withColumn("g", F.transform(_span(n_grams), lambda i: F.xxhash64(*(F.get("h", i + j) for j in range(k)))))
    else:
        df = df.withColumn("g", F.col("h"))
    if w > 1:
        df = df.withColumn("m", F.transform(_span(n_grams - (w - 1)), lambda i: F.least(*(F.get("g", i + j) for j in range(w)))))
        # kept: the least of one of the windows that it stands in
        df = df.withColumn("at", F.filter(_span(F.size("g")), lambda i: F.get("g", i) == F.greatest(*(F.get("m", i - j) for j in range(w)))))
    else:
        df = df.withColumn("at", _span(F.size("g")))
    reach = length - k
    entry = lambda i: F.struct(
        F.lit(length).alias("length"), i.alias("at"), F.get("g", i).alias("fp"), F.greatest(i - reach, F.lit(0)).alias("low"), F.slice("h", F.greatest(i - reach, F.lit(0)) + 1, F.lit(length + reach)).alias("near")
    )
    return df.withColumn(to, F.transform("at", entry)).drop("g", "m", "at")


def item_fingerprints(items: DataFrame, length: int, gram: int, item_col: str, text_col: str) -> DataFrame:
    """(item, length, i_at, fp, i_low, i_near); items without words have none."""
    hashed = materialize(items.select(F.col(item_col).alias("item"), word_hashes(F.col(text_col)).alias("h")).where(F.size("h") > 0), "benchmark-words")
    parts = []
    for n in range(1, length + 1):
        own = hashed.where(F.size("h") == n) if n < length else hashed.where(F.size("h") >= n)
        # outer: from a plain explode Spark infers a filter on the array's size, and pushes it down with everything that makes the array
        parts.append(_fingerprints(own, n, gram, "f").select("item", F.explode_outer("f").alias("f")))
    flat = reduce(DataFrame.union, parts).where("f is not null")
    return flat.select("item", "f.length", F.col("f.at").alias("i_at"), "f.fp", F.col("f.low").alias("i_low"), F.col("f.near").alias("i_near"))


def _equal_words(step: int, reach: int, length: Column, gram: int) -> Column:
    """How many words in a row are equal, going from the k-gram's end (step 1) or start (step -1)."""
    k = F.least(F.lit(gram), length)
    d, i = F.col("at") - F.col("low"), F.col("i_at") - F.col("i_low")
    first = (lambda s: s - 1 + k) if step > 0 else (lambda s: -s)
    differs = lambda s: ~F.coalesce(F.get("near", d + first(s)) == F.get("i_near", i + first(s)), F.lit(False))
    return F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), F.lit(reach + 1)), differs)) - 1, F.lit(reach))


def _meeting(df: DataFrame, texts: DataFrame, bench: DataFrame, lengths: list[int], gram: int) -> DataFrame:
    """texts with a column f of the fingerprints that stand in the benchmark too, for one that is too large to broadcast.

    Fingerprints meet the benchmark's without the words around them; those come from the text's own hashes afterwards.
    """
    every = F.concat(*(F.col(f"f{n}") for n in lengths))
    light = df.select("id", "text_hash", F.explode_outer(every).alias("f")).select("id", "text_hash", "f.length", "f.at", "f.fp")
    there = materialize(bench.select("length", "fp").distinct(), "benchmark-keys")
    kept = light.join(there, ["length", "fp"], "left_semi").groupBy("id", "text_hash").agg(F.collect_set(F.struct("length", "at", "fp")).alias("kept"))  # at most a text's
    kept = materialize(kept.select(F.col("id").alias("kept_id"), F.col("text_hash").alias("kept_hash"), "kept"), "met-fingerprints")
    met = texts.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash")), "left")

    def entry(x: Column) -> Column:
        reach = x["length"] - F.least(F.lit(gram), x["length"])
        low = F.greatest(x["at"] - reach, F.lit(0))
        return F.struct(x["length"].alias("length"), x["at"].alias("at"), x["fp"].alias("fp"), low.alias("low"), F.slice("h", low + 1, x["length"] + reach).alias("near"))

    return met.select("id", "text_hash", "h", F.transform("kept", entry).alias("f"))


def contamination(docs: DataFrame, items: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, items) for every row of docs; items are the ids of items with occurring windows, as sorted strings.

    Null, empty and wordless texts have no words and no hits. Repeated rows each give a row; rows of one id and
    different texts are told apart. A null item id counts for n_hit, not among items; repeated items count once.
    Empty tables give no rows, or rows without hits. Other columns are not looked at.
    """
    bench = materialize(item_fingerprints(items, length, gram, item_col, item_text_col), "benchmark")
    lengths = sorted(r.length for r in bench.select("length").distinct().collect())  # length of them at most
    small = bench.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), word_hashes(F.col(text_col)).alias("h"))
    df = texts
    for n in lengths:
        df = _fingerprints(df, n, gram, f"f{n}")
    kind = "struct<length:int,at:int,fp:bigint,low:int,near:array<bigint>>"
    none = F.array(F.lit(None).cast(kind))  # the null stands for the row itself
    found = F.concat(none, *(F.col(f"f{n}") for n in lengths))
    if not small:
        df = _meeting(df, texts, bench, lengths, gram)
        found = F.concat(none, F.coalesce("f", F.expr(f"cast(array() as array<{kind}>)")))
    rows = df.select("id", "text_hash", F.size("h").alias("n_words"), F.explode_outer(found).alias("f")).select("id", "text_hash", "n_words", "f.*")
    met = rows.join(F.broadcast(bench) if small else bench, ["length", "fp"], "left")

    longest = length - 1
    left, right = (_equal_words(step, longest, F.col("length"), gram) for step in (-1, 1))
    k = F.least(F.lit(gram), F.col("length"))
    inner = F.slice("near", F.col("at") - F.col("low") + 1, k) == F.slice("i_near", F.col("i_at") - F.col("i_low") + 1, k)
    runs = (
        met.where(F.col("length").isNull() | F.col("i_at").isNotNull())
        .withColumn("a", F.when(F.col("length").isNotNull(), F.col("at") - left))
        .withColumn("b", F.when(F.col("length").isNotNull(), F.col("at") + k - 1 + right))
        .where(F.col("length").isNull() | (inner & (F.col("b") - F.col("a") + 1 >= F.col("length"))))
    )
    distinct = runs.groupBy("id", "text_hash", "n_words", "a", "b", "item").agg(F.count("*").alias("n"))
    of = Window.partitionBy("id", "text_hash", "n_words")
    before = F.max("b").over(of.orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("b") - F.greatest(F.col("a") - 1, F.coalesce(before, F.lit(-1))))
    per_row = (
        distinct.withColumn("fresh", F.when(F.col("b").isNotNull(), fresh))
        .groupBy("id", "text_hash", "n_words")
        .agg(F.coalesce(F.sum("fresh"), F.lit(0)).alias("n_hit"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"), F.max(F.when(F.col("b").isNull(), F.col("n"))).alias("rows"))
    )
    return repeat_rows(per_row, F.col("rows")).select("id", F.col("n_words").cast("long").alias("n_words"), "n_hit", "items")


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


WINNOWING_SQL = r"""
with d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
i as (select item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from benchmark),
p as (select item_id, w, least(len(w), 10) as l, unnest(range(1, len(w) - least(len(w), 10) + 2)) as pos from i where len(w) > 0),
g as (select distinct item_id, l, array_to_string(list_slice(w, pos, pos + l - 1), ' ') as gram from p),
q as (select d.doc_id, d.w, n.l, unnest(range(1, len(d.w) - n.l + 2)) as pos from d, (select distinct l from g) n where len(d.w) >= n.l),
x as (select doc_id, l, pos, array_to_string(list_slice(w, pos, pos + l - 1), ' ') as gram from q),
h as (select x.doc_id, x.pos, x.l, g.item_id from x join g using (l, gram)),
c as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(pos, pos + l)) as pos from h) group by doc_id),
s as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, item_id::varchar as item_id from h) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join s using (doc_id)
"""

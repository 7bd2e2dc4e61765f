"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations alone.

A source's target is a share of all words by weight, at most `max_copies` times what the source
has; what stays over is shared out again. A document's expected copies are its weight times its
source's target; the whole part is certain, and the rest, lambda, is the inclusion probability of
one copy more. Documents are ranked by u / (1 - u) over lambda / (1 - lambda), u being uniform and
fixed by the id; the copies more go to the head of that order, of a fixed size in words.

No source is ever sorted in one task: words are summed by source and bin of the order, and only the
one bin in which the size is reached is ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize, repeat_rows, table

BINS = 1 << 14
SEED = "mix-1:"
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(id_: Column) -> Column:
    """A number strictly between 0 and 1 that an id always has."""
    digits = F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(id_.cast("string"), F.lit("null")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_copies: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source, a table of the mixture's own length.

    Weights repeat along the sources by code point, null last. A source whose share by weight is above
    max_copies times its size gets just that; going up by that limit over weight, the first source below
    it ends the limited ones, and the others share the rest by weight.
    """
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("w", F.element_at(cycle, nth % len(weights) + 1)).withColumn("most", F.lit(float(max_copies)) * F.col("source_size"))
    up = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, all_ = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.lit(float(share)) * F.sum("source_size").over(all_)
    left = total - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rest = F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    limited = weighed.withColumn("limited", F.col("most") * rest <= F.col("w") * left).withColumn("total", total)
    ended = F.min(F.col("limited").cast("int")).over(up.rowsBetween(Window.unboundedPreceding, 0)) == 1
    held = limited.withColumn("limited", ended)
    free_w = F.sum(F.when(~F.col("limited"), F.col("w"))).over(all_)
    free = F.col("total") - F.coalesce(F.sum(F.when(F.col("limited"), F.col("most"))).over(all_), F.lit(0.0))
    return held.select("source", "source_size", F.when(F.col("limited"), F.col("most")).otherwise(F.col("w") * free / free_w).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_copies: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None) -> DataFrame:
    """(id, source, size, source_size, target, copies) for every row of docs.

    weight_col gives documents of a source unequal chances; null counts as 0, and without it all are equal.
    A null or empty text has size 0. A null source is a source of its own. Rows alike in id, source, size and
    weight are told apart by nothing but how many of them get one copy more. An empty table gives no rows;
    where no document has words, nobody gets copies beyond the certain ones. Equal inputs give equal mixes.
    Other columns of docs are not looked at.
    """
    weight = F.coalesce(F.greatest(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_col else F.lit(1.0)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), weight.alias("weight"))
    sized = materialize(rows.groupBy("id", "source", "size", "weight").agg(F.count("*").alias("n")), "sizes")

    words = F.col("size") * F.col("n")
    of_source = sized.groupBy("source").agg(F.sum(words).alias("source_size"), F.sum((F.col("weight") * words).cast("decimal(38,9)")).cast("double").alias("weighed"))
    targets = source_targets(of_source.select("source", "source_size"), weights, share, max_copies)
    told = targets.join(of_source.select(F.col("source").alias("s"), "weighed"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    told = materialize(told, "targets")
    expected = F.when(F.col("weighed") > 0, F.least(F.col("weight") * F.col("target") / F.col("weighed"), F.lit(float(max_copies)))).otherwise(F.lit(0.0))
    ranked = (
        sized.join(told.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("expected", expected)
        .withColumn("certain", F.floor("expected"))
        .withColumn("chance", F.col("expected") - F.col("certain"))
        .withColumn("u", uniform(F.col("id")))
        .withColumn("q", (F.col("u") / (1 - F.col("u"))) / (F.col("chance") / F.when(F.col("chance") > 0, 1 - F.col("chance"))))
        .withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * BINS).cast("int"))  # null where nothing is left to chance
    )
    bins = ranked.groupBy("source", "bin").agg(F.first("target").alias("target"), F.sum(F.col("certain") * words).alias("sure"), F.sum(F.when(F.col("bin").isNotNull(), words)).alias("more"))
    of = Window.partitionBy("source")
    upto = F.sum("more").over(of.orderBy("bin"))
    cuts = (
        bins.withColumn("room", F.col("target") - F.sum("sure").over(of))
        .withColumn("end", upto)
        .where((F.col("end") > F.col("room")) & (F.col("end") - F.col("more") <= F.col("room")) & F.col("bin").isNotNull() & (F.col("more") > 0))
        .select(F.col("source").alias("s"), F.col("bin").alias("cut"), (F.col("end") - F.col("more")).alias("before"), "room")
    )
    placed = ranked.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    clear = placed.where(F.col("bin").isNull() | F.col("cut").isNull() | (F.col("bin") != F.col("cut")))
    clear = clear.withColumn("extra", F.when(F.col("bin").isNotNull() & (F.col("cut").isNull() | (F.col("bin") < F.col("cut"))), F.col("n")).otherwise(F.lit(0)).cast("long"))
    order = of.orderBy("q", "id", "size", "weight").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum(words).over(order), F.lit(0))
    fits = F.floor((F.col("room") - ahead) / F.when(F.col("size") > 0, F.col("size")) + 0.5)  # a row is in if at least half of it is
    met = placed.where(F.col("bin") == F.col("cut")).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("n"), F.coalesce(fits, F.col("n")))).cast("long"))
    return repeat_rows(clear.unionByName(met), F.col("n")).select("id", "source", "size", "source_size", "target", (F.col("certain") + (F.col("nth") < F.col("extra")).cast("long")).alias("copies"))


def op9_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


MIX_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         (('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint + 0.5::double) / 4503599627370496::double as u
  from {docs}),
s as (
  select source, sum(size)::bigint as source_size, 2.0::double * sum(size)::double as most,
         [3.0::double, 1.0::double, 2.0::double][1 + (row_number() over (order by source nulls last) - 1) % 3] as w
  from d group by source),
o as (
  select *, 1.5::double * (sum(source_size) over ())::double as total,
         1.5::double * (sum(source_size) over ())::double - coalesce(sum(most) over up, 0) as left_,
         sum(w) over () - coalesce(sum(w) over up, 0) as rest
  from s window up as (order by most / w, source nulls last rows between unbounded preceding and 1 preceding)),
h as (
  select *, min(case when most * rest <= w * left_ then 1 else 0 end) over (order by most / w, source nulls last rows unbounded preceding) = 1 as held from o),
t as (
  select source, source_size, case when held then most else w * (total - coalesce(sum(case when held then most end) over (), 0)) / sum(case when not held then w end) over () end as target
  from h),
e as (
  select d.doc_id, d.size, d.u, d.source, t.source_size, t.target,
         case when t.source_size > 0 then least(t.target / t.source_size, 2.0::double) else 0 end as expected
  from d join t on d.source is not distinct from t.source),
r as (
  select *, target - floor(expected) * source_size as room,
         coalesce(sum(size) over (partition by source order by u, doc_id rows between unbounded preceding and 1 preceding), 0) as ahead
  from e)
select doc_id, size, source_size, target,
       (size * (floor(expected) + case when expected > floor(expected) and (room - ahead) / nullif(size, 0) + 0.5::double >= 1 then 1 else 0 end))::bigint as taken
from r
"""

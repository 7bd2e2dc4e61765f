"""Chat formatting by multi-party perspective rotation, in DataFrame operations alone.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant
and the others as users by name; what the assistant says is trained on, the rest is masked out.
Marks of the format are escaped where they stand in names and texts, so a dialogue can be taken apart
again. The rendered dialogue is kept as a row a turn, with the place of its segment and of the trained part
in the whole. Places are running sums by stretches of turns and then over the stretches, so a very
long conversation is neither gathered in one row nor in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize, table

END = "\n<|end|>\n"
STRETCH = 1024


def escaped(text: Column) -> Column:
    """No mark begins or ends in it: a backslash parts "<|" and "|>", and is doubled where it parted them already."""
    for mark, after in (("<", "|"), ("|", ">")):
        text = F.replace(F.replace(text, F.lit(mark + "\\"), F.lit(mark + "\\\\")), F.lit(mark + after), F.lit(mark + "\\" + after))
    return text


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system: str = "system", stretch: int = STRETCH) -> DataFrame:
    """(conv_id, perspective, turn, role, name, segment, trained, seg_start, mask_start, seg_end) in characters.

    Segments in order of turn, then speaker and text, make up the dialogue. Trained are the characters from
    mask_start to seg_end of the assistant's segments. System turns stay as they are and have no perspective; a
    conversation of nothing else gives no rows. A null role is a speaker "unknown", a null text is empty, null turns
    come first, and rows without a conv_id make up one conversation. Repeated rows are repeated turns. An empty
    table gives no rows. Other columns are not looked at.
    """
    said = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("speaker"), escaped(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    speakers = said.where(F.col("speaker") != system).select(F.col("c").alias("pc"), F.col("speaker").alias("perspective")).distinct()
    speakers = materialize(speakers, "speakers")  # written, so that the join's both sides are exchanges, and Spark can split a long conversation's
    met = said.join(speakers, F.col("c").eqNullSafe(F.col("pc"))).drop("pc")
    role = F.when(F.col("speaker") == system, F.lit("system")).when(F.col("speaker") == F.col("perspective"), F.lit("assistant")).otherwise(F.lit("user"))
    header = F.when(F.col("role") == "user", F.concat(F.lit("<|user:"), escaped(F.col("speaker")), F.lit("|>\n"))).otherwise(F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n")))
    rendered = (
        met.withColumn("role", role)
        .withColumn("header", header)
        .withColumn("segment", F.concat("header", "text", F.lit(END)))
        .withColumn("stretch", F.floor(F.col("turn") / stretch))
        .withColumn("n", F.char_length("segment").cast("long"))
    )
    sums = rendered.groupBy("c", "perspective", "stretch").agg(F.sum("n").alias("n"))
    over = Window.partitionBy("c", "perspective").orderBy("stretch")
    before = sums.select(F.col("c").alias("bc"), F.col("perspective").alias("bp"), F.col("stretch").alias("bs"), (F.sum("n").over(over) - F.col("n")).alias("before"))
    inside = Window.partitionBy("c", "perspective", "stretch").orderBy("turn", "speaker", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = rendered.withColumn("upto", F.sum("n").over(inside)).join(before, F.col("c").eqNullSafe(F.col("bc")) & (F.col("perspective") == F.col("bp")) & F.col("stretch").eqNullSafe(F.col("bs")))
    end = F.col("before") + F.col("upto")
    trained = F.col("role") == "assistant"
    return placed.select(
        F.col("c").alias("conv_id"), "perspective", "turn", "role", F.when(F.col("role") == "user", F.col("speaker")).alias("name"), "segment", trained.alias("trained"),
        (end - F.col("n")).alias("seg_start"), F.when(trained, end - F.col("n") + F.char_length("header")).alias("mask_start"), end.alias("seg_end"),
    )


def op7_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


ROTATION_SQL = r"""
with s as (
  select conv_id, turn, coalesce(role, 'unknown') as speaker,
         replace(replace(replace(replace(coalesce(text, ''), '<\', '<\\'), '<|', '<\|'), '|\', '|\\'), '|>', '|\>') as text
  from conversations),
p as (select distinct conv_id, speaker as perspective from s where speaker <> 'system'),
r as (
  select s.conv_id, p.perspective, s.turn, s.speaker, s.text, case when s.speaker = 'system' then 'system' when s.speaker = p.perspective then 'assistant' else 'user' end as role
  from s join p on s.conv_id is not distinct from p.conv_id),
h as (select *, case when role = 'user' then '<|user:' || replace(replace(replace(replace(speaker, '<\', '<\\'), '<|', '<\|'), '|\', '|\\'), '|>', '|\>') || '|>' || chr(10) else '<|' || role || '|>' || chr(10) end as header from r),
g as (select *, header || text || chr(10) || '<|end|>' || chr(10) as segment from h),
e as (select *, (sum(length(segment)) over (partition by conv_id, perspective order by turn nulls first, speaker, text rows unbounded preceding))::bigint as seg_end from g)
select conv_id, perspective, turn, role, case when role = 'user' then speaker end as name, segment, role = 'assistant' as trained,
       seg_end - length(segment) as seg_start, case when role = 'assistant' then seg_end - length(segment) + length(header) end as mask_start, seg_end
from e
"""

"""What Spark makes of a query: plan texts, figures of plans, figures of runs."""

from __future__ import annotations

import time
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """simple, extended, codegen, cost or formatted, as text."""
    jvm = df.sparkSession._jvm
    return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def plan_nodes(df: DataFrame) -> Counter:
    """How many of each physical operator the plan has before it runs."""
    out: Counter = Counter()
    for line in df._jdf.queryExecution().sparkPlan().treeString().splitlines():
        name = line.lstrip(" :+-*()0123456789").split(" ")[0].split("(")[0]
        if name:
            out[name] += 1
    return out


def pushed_filters(df: DataFrame) -> list[str]:
    """The filters that reach the files."""
    text = plan_text(df, "formatted")
    return [line.split(":", 1)[1].strip() for line in text.splitlines() if line.startswith("PushedFilters")]


@dataclass
class Run:
    rows: int
    seconds: float
    warnings: list[str] = field(default_factory=list)

    def report(self) -> str:
        return f"{self.rows} rows in {self.seconds:.2f} s" + "".join(f"\n- {w}" for w in self.warnings)


def measured(df: DataFrame) -> Run:
    """Run a query to its end without keeping its rows."""
    seen = Observation()
    began = time.perf_counter()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    warnings = ["a product of two tables" for n in plan_nodes(df) if n in ("CartesianProduct", "BroadcastNestedLoopJoin")]
    return Run(seen.get["rows"], time.perf_counter() - began, warnings)


def operator_figures(df: DataFrame) -> list[tuple[str, dict[str, int]]]:
    """Run a query to its end; each operator of the plan that ran, from the top, with Spark's own figures of it."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    out = []

    def visit(node: object) -> None:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return visit(node.executedPlan())
        if name.endswith("QueryStage"):
            return visit(node.plan())
        figures, each = {}, node.metrics().iterator()
        while each.hasNext():
            pair = each.next()
            figures[pair._1()] = pair._2().value()
        out.append((name, figures))
        children = node.children().iterator()
        while children.hasNext():
            visit(children.next())
        return None

    visit(execution.executedPlan())
    return out


def column_figures(df: DataFrame) -> DataFrame:
    """A row a column: its type, nulls, distinct values (about, within 5 in 100), and mean size in bytes of its text."""
    counts = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        told = F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.count(F.when(c.isNull(), 1)).alias("nulls"), F.approx_count_distinct(c).alias("distinct"), F.avg(F.octet_length(c.cast("string"))).alias("bytes"))
        counts.append(told.alias(f"c{i}"))
    one = df.agg(*counts)
    return one.select(F.explode(F.array(*one.columns)).alias("c")).select("c.*")


class Cancellable:
    """with Cancellable(spark, "tag") as c: jobs inside can be stopped by c.cancel() from another thread."""

    def __init__(self, spark: object, tag: str) -> None:
        self.spark, self.tag = spark, tag

    def __enter__(self) -> Cancellable:
        self.spark.addTag(self.tag)
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.removeTag(self.tag)

    def cancel(self) -> list[str]:
        return self.spark.interruptTag(self.tag)

"""Queries for sources, sinks, factories, streams and reductions: what is written is read back and held against SQL on the tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon import ml
from quillon.frame import Frame
from quillon.functions import activations, vectors
from quillon.functions.expressions import col
from quillon.operators import aggregates as agg
from quillon.operators import columns, joins, rows, series, windows
from quillon.plans import explain
from quillon.plans.queries import _rounded, query
from quillon.sources import custom, files
from quillon.sources.scratch import scratch_path
from quillon.streaming import streams

# --- sources and sinks ----------------------------------------------------------------------------

_NOTE = """c_name || ', "' || c_mktsegment || '"' || chr(10) || 'x'"""


@query(f"select c_custkey::integer as c_custkey, {_NOTE} as note, c_acctbal from customer")
def csv_round_trip(t):  # noqa: ANN001, ANN201
    note = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"\nx'))
    path = scratch_path(t.spark, "csv")
    files.write_csv(t("customer").select("c_custkey", note.alias("note"), "c_acctbal"), path)
    return files.scan_csv(t.spark, path)


@query("select * from (values ('key', 'int'), ('price', 'double'), ('under', 'string'), ('large', 'double'), ('yes', 'boolean'), ('day', 'timestamp'), ('name', 'string')) v(name, kind)")
def csv_inference(t):  # noqa: ANN001, ANN201
    path = scratch_path(t.spark, "csv")
    df = t("part").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("price"), F.lit("1_000").alias("under"), (F.col("p_partkey") + 3_000_000_000).alias("large"), (F.col("p_size") > 5).alias("yes"), F.lit("2024-01-02").alias("day"), F.col("p_name").alias("name"))
    files.write_csv(df, path)
    return t.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in files.csv_schema(t.spark, path)], "name string, kind string")


@query("select p_partkey, case when p_partkey % 5 <> 0 then p_size end::integer as p_size, p_name from part")
def csv_bad_cells(t):  # noqa: ANN001, ANN201
    path = scratch_path(t.spark, "csv")
    files.write_csv(t("part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, "none").otherwise(F.col("p_size").cast("string")).alias("p_size"), "p_name"), path)
    return files.scan_csv(t.spark, path, schema="p_partkey long, p_size int, p_name string")


@query('select s_suppkey::integer as "Column0", s_name as "Column1", s_acctbal as "Column2" from supplier')
def csv_options(t):  # noqa: ANN001, ANN201
    path, options = scratch_path(t.spark, "csv"), files.CsvOptions(header=False, delimiter="|", decimal=",", multi_line=False)
    files.write_csv(t("supplier").select("s_suppkey", "s_name", F.replace(F.col("s_acctbal").cast("string"), F.lit("."), F.lit(","))), path, options)
    return files.scan_csv(t.spark, path, options)


@query("select count(*) as n, sum(c_custkey)::bigint as keys from customer")
def csv_eager(t):  # noqa: ANN001, ANN201
    path = scratch_path(t.spark, "csv")
    files.write_csv(t("customer").select("c_custkey"), path)
    return files.read_csv(t.spark, path).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@query("select o_orderkey::double as o_orderkey, o_orderstatus, case when o_orderkey % 4 <> 0 then o_totalprice end as price, o_totalprice > 1000 as large from orders")
def json_lines(t):  # noqa: ANN001, ANN201
    path = scratch_path(t.spark, "json")
    made = t("orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("price"), (F.col("o_totalprice") > 1000).alias("large"))
    files.write_json(made, path)
    return files.scan_json(t.spark, path, lines=True, schema=T._parse_datatype_string("o_orderkey double, o_orderstatus string, price double, large boolean"))


@query("select n_nationkey::double as key, n_name as name from nation")
def json_loose(t):  # noqa: ANN001, ANN201
    """One array with comments, trailing commas and names in any case."""
    path = scratch_path(t.spark, "json")
    one = F.concat(F.lit('{"'), F.when(F.col("n_nationkey") % 2 == 0, "key").otherwise("KEY"), F.lit('": '), F.col("n_nationkey"), F.lit(', "name": "'), "n_name", F.lit('", /* a */ }, // b\n'))
    t("nation").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(one)), ""), F.lit("]")).alias("value")).write.text(path)
    return files.scan_json(t.spark, path).toDF("key", "name")


@query("select s_suppkey::double as s_suppkey, s_name from supplier")
def json_inferred(t):  # noqa: ANN001, ANN201
    path = scratch_path(t.spark, "json")
    files.write_json(t("supplier").select("s_suppkey", "s_name"), path)
    return files.read_json(t.spark, path, lines=True).select("s_suppkey", "s_name")


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders where o_totalprice > 50000")
def parquet_write(t):  # noqa: ANN001, ANN201
    path = scratch_path(t.spark, "parquet")
    files.write_parquet(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), path, compression="zstd", row_group_bytes=1 << 20, partition_by=["o_orderstatus"])
    return files.scan_parquet(t.spark, path).where("o_totalprice > 50000")


@query("select c_custkey as id, c_acctbal as balance from customer union all select s_suppkey, s_acctbal from supplier")
def parquet_write_batch(t):  # noqa: ANN001, ANN201
    path = scratch_path(t.spark, "parquet")
    frames = [t(n).select(F.col(k).alias("id"), F.col(v).alias("balance")) for n, k, v in (("customer", "c_custkey", "c_acctbal"), ("supplier", "s_suppkey", "s_acctbal"))]
    files.write_parquet_batch(frames, path)
    return files.scan_parquet(t.spark, path, schema=frames[0].schema)


@query("select 10 as most, 25::bigint as rows_, 3 as chunks")
def parquet_chunked(t):  # noqa: ANN001, ANN201
    sizes = [len(c) for c in files.parquet_chunks(t("nation"), 10)]
    return t.spark.createDataFrame([(max(sizes), sum(sizes), len(sizes))], "most int, rows_ long, chunks int")


@query("select * from nation")
def arrow_table(t):  # noqa: ANN001, ANN201
    return files.from_arrow(t.spark, files.to_arrow(t("nation")))


@query("select r_name as value from region")
def arrow_array(t):  # noqa: ANN001, ANN201
    return files.column_from_arrow(t.spark, files.column_to_arrow(t("region"), "r_name"))


@query("select i, i * i as squared from (select unnest(range(0, 4000)) as i)")
def custom_source(t):  # noqa: ANN001, ANN201
    def read(part: int):  # noqa: ANN202
        numbers = list(range(part * 1000, (part + 1) * 1000))
        yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array([n * n for n in numbers])], ["i", "squared"])

    custom.register(t.spark, "squares", "i long, squared long", 4, read)
    return custom.scan(t.spark, "squares")


# --- frames from the driver, and what goes back ---------------------------------------------------


@query("select * from (values (1::bigint, 'a', 1.5::double, 0::bigint), (2, null, null, 1), (null, 'c', 2.5, 2)) v(k, s, x, row_id)")
def in_memory_frame(t):  # noqa: ANN001, ANN201
    return Frame.create(t.spark, [(1, "a", 1.5), (2, None, None), (None, "c", 2.5)], "k long, s string, x double")


@query("""select * from (values ('a', 1.0::double, 2.0::double, 0::bigint), ('b', 3.0, 4.5, 1)) v("Label", "Col_0", "Col_1", row_id)""")
def frame_from_rows(t):  # noqa: ANN001, ANN201
    return Frame.from_rows(t.spark, [("a", [1, 2]), ("b", [3, 4.5])])


@query("""select * from (values ('0', 1.0::double, 2.0::double, 0::bigint), ('1', 3.0, 4.0, 1)) v("Label", x, y, row_id)""")
def frame_from_matrix(t):  # noqa: ANN001, ANN201
    import numpy as np

    return Frame.from_matrix(t.spark, np.array([[1.0, 2.0], [3.0, 4.0]]), ["x", "y"])


@query("select * from (values (0, 5::bigint, 0::bigint), (1, null, 1), (2, 7, 2)) v(label, value, position)")
def column_from_mask(t):  # noqa: ANN001, ANN201
    return series.create(t.spark, [5, 6, 7], "long", known=[True, False, True])


@query("select n_nationkey, n_name from nation")
def sink_objects(t):  # noqa: ANN001, ANN201
    made = Frame(t("nation").select("n_nationkey", "n_name"), "n_nationkey").to_objects(dict)
    return t.spark.createDataFrame([(d["n_nationkey"], d["n_name"]) for d in made], "n_nationkey int, n_name string")


@query("select s_suppkey, s_acctbal from supplier")
def sink_tensor(t):  # noqa: ANN001, ANN201
    df = t("supplier").select(F.col("s_suppkey").cast("double").alias("k"), "s_acctbal")
    return t.spark.createDataFrame([(int(k), b) for k, b in Frame(df, "k").to_tensor("k", "s_acctbal").tolist()], "s_suppkey long, s_acctbal double")


@query("select s_suppkey, [s_suppkey::double, s_acctbal][1] as a, s_acctbal as b from supplier")
def vectors_reshaped(t):  # noqa: ANN001, ANN201
    packed = vectors.as_rows(t("supplier").select("s_suppkey", F.col("s_suppkey").cast("double").alias("a"), F.col("s_acctbal").alias("b")), ["a", "b"], "v")
    return vectors.flattened(packed.select("s_suppkey", "v"), "v", ["a", "b"])


@query("select n_name as label, n_nationkey as value from nation where n_nationkey between 5 and 9")
def series_slice(t):  # noqa: ANN001, ANN201
    return series.slice_(series.of(t("nation"), "n_name", "n_nationkey", "n_nationkey"), 5, 5).select("label", "value")


@query("select n_name as label, n_nationkey as value, true as there from nation where n_nationkey in (3, 8) union all select 'NOWHERE', null, false")
def series_lookup(t):  # noqa: ANN001, ANN201
    by_name = series.of(t("nation"), "n_name", "n_nationkey", "n_nationkey")
    names = [r.n_name for r in t("nation").where("n_nationkey in (3, 8)").collect()] + ["NOWHERE"]
    found = [(n, series.try_get(by_name, n), series.contains(by_name, n)) for n in names]
    return t.spark.createDataFrame(found, "label string, value int, there boolean")


@query("select trunc(avg(l_linenumber))::bigint as whole, round(avg(l_quantity), 6) as mean from lineitem")
def series_average(t):  # noqa: ANN001, ANN201
    return t.spark.createDataFrame([(int(agg.series_average(t("lineitem"), "l_linenumber")), round(agg.series_average(t("lineitem"), "l_quantity"), 6))], "whole long, mean double")


@query("select sum(c_nationkey)::bigint as total, min(c_acctbal) as low, max(c_acctbal) as high, round(avg(c_acctbal), 6) as mean from customer")
def column_reductions(t):  # noqa: ANN001, ANN201
    df = t("customer")
    row = (agg.column_sum(df, "c_nationkey"), agg.column_extreme(df, "c_acctbal", False), agg.column_extreme(df, "c_acctbal", True), round(agg.column_mean(df, "c_acctbal"), 6))
    return t.spark.createDataFrame([row], "total long, low double, high double, mean double")


# --- operators on other types and on empty inputs -------------------------------------------------


@query("select c_custkey, c_name, null::bigint as o_orderkey from customer")
def join_empty_side(t):  # noqa: ANN001, ANN201
    none = t("orders").where("false").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return joins.left_join(t("customer").select("c_custkey", "c_name"), none, "c_custkey")


@query("select count(*) as n from orders a join orders b on a.o_orderdate = b.o_orderdate and a.o_orderstatus = b.o_orderstatus and a.o_totalprice = b.o_totalprice")
def join_key_types(t):  # noqa: ANN001, ANN201
    keys = ["o_orderdate", "o_orderstatus", "o_totalprice"]
    return joins.inner_join(t("orders").select(*keys), t("orders").select(*keys, "o_orderkey"), keys).agg(F.count("*").alias("n"))


@query("select event_id, (cast(value as integer) % 3) = 0 as b, row_number() over (order by (cast(value as integer) % 3) = 0, ts desc, event_id) - 1 as place from events")
def sort_types(t):  # noqa: ANN001, ANN201
    df = t("events").select("event_id", (F.bround("value").cast("int") % 3 == 0).alias("b"), "ts")
    made = Frame(df, "event_id").sort(rows.SortKey("b"), rows.SortKey("ts", False))
    return rows.numbered_as_sorted(made.df, "place").drop("ts")


@query(
    """select event_id, round((sum(d) over w)::double, 2) as d, sum(f) over w as f from (select event_id, cast(cast(value as integer) as decimal(18, 2)) as d, cast(value as integer)::float as f from events)
    window w as (order by event_id rows between 2 preceding and current row) qualify row_number() over (order by event_id) > 2"""
)
def rolling_types(t):  # noqa: ANN001, ANN201
    v = F.bround("value").cast("int")
    df = t("events").select("event_id", v.cast("decimal(18,2)").alias("d0"), v.cast("float").alias("f0"))
    made = windows.rolling(windows.rolling(df, "sum", "d0", "d", 3, "event_id"), "sum", "f0", "f", 3, "event_id")
    return made.where("d is not null").select("event_id", F.round(F.col("d").cast("double"), 2).alias("d"), F.col("f").cast("double").alias("f"))


@query("select n_nationkey, (24 - n_nationkey)::bigint as place from nation")
def reorder_rows(t):  # noqa: ANN001, ANN201
    made = rows.reorder(t("nation").select("n_nationkey"), list(range(24, -1, -1)), "n_nationkey").collect()
    return t.spark.createDataFrame([(r.n_nationkey, i) for i, r in enumerate(made)], "n_nationkey int, place long")


@query("select c_custkey as id from customer")
def concat_empty(t):  # noqa: ANN001, ANN201
    ids = t("customer").select(F.col("c_custkey").alias("id"))
    return rows.concat_rows([ids.where("false"), ids, ids.where("false")], fill=False)


@query("select r_name from region")
def column_to_frame(t):  # noqa: ANN001, ANN201
    return Frame(t("region")).select("r_name")


@query("select p_partkey, p_size + 1.5::double as sum_, -p_size as negative from part")
def column_arithmetic(t):  # noqa: ANN001, ANN201
    return Frame(t("part")).select("p_partkey", (col("p_size") + 1.5).alias("sum_"), (0 - col("p_size")).alias("negative"))


@query("select c_custkey, upper(c_name) as c_name from customer")
def map_strings(t):  # noqa: ANN001, ANN201
    return columns.transform(t("customer").select("c_custkey", "c_name"), "c_name", str.upper, "string")


# --- streams and runs -----------------------------------------------------------------------------


def _live(t):  # noqa: ANN001, ANN202
    path = scratch_path(t.spark, "stream-in")
    t("events").select("event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts")).repartition(4).write.parquet(path)
    return streams.read_stream(t.spark, path, t.spark.read.parquet(path).schema, files_per_trigger=2)


@query("select event_id, value * 2 as doubled from events where value > 50")
def stream_rows(t):  # noqa: ANN001, ANN201
    steps = [("filter", lambda d: d.where("value > 50")), ("select", lambda d: d.select("event_id", (F.col("value") * 2).alias("doubled")))]
    out = scratch_path(t.spark, "stream-out")
    streams.write_stream(streams.run_steps(_live(t), steps), out, out + "-state").awaitTermination()
    return t.spark.read.parquet(out)


@query("select event_type, count(*) as n, round(sum(value), 2) as total from events group by all")
def stream_group_by(t):  # noqa: ANN001, ANN201
    out = scratch_path(t.spark, "stream-out")
    made = streams.run_steps(_live(t), [("group_by", lambda d: d.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")))])
    streams.write_totals(made, out, out + "-state").awaitTermination()
    return streams.latest_totals(t.spark, out)


@query(
    """select w as window_start, w + interval 2 hour as window_end, event_type, count(*) as n
    from (select event_type, unnest([time_bucket(interval 1 hour, ts), time_bucket(interval 1 hour, ts) - interval 1 hour]) as w from events) group by all"""
)
def sliding_windows(t):  # noqa: ANN001, ANN201
    return streams.windowed(t("events"), "ts", "2 hours", [F.count(F.lit(1)).alias("n")], ["event_type"], slide="1 hour")


@query("select count(*) as rows_ from lineitem where l_quantity > 10")
def run_figures(t):  # noqa: ANN001, ANN201
    return t.spark.createDataFrame([(explain.measured(t("lineitem").where("l_quantity > 10")).rows,)], "rows_ long")


@query("select 'Filter' as node, true as there union all select 'Scan', true union all select 'Exchange', false")
def plan_operators(t):  # noqa: ANN001, ANN201
    names = explain.plan_nodes(t("lineitem").where("l_quantity > 10").select("l_orderkey"))
    return t.spark.createDataFrame([(n, any(k.startswith(n) or k == "FileScan" and n == "Scan" for k in names)) for n in ("Filter", "Scan", "Exchange")], "node string, there boolean")


# --- models and neural functions ------------------------------------------------------------------


@query("select c_custkey, coalesce(case when c_custkey % 3 <> 0 then c_acctbal end, 0) as a, c_nationkey::double as b from customer")
def feature_vectors(t):  # noqa: ANN001, ANN201
    df = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("a"), "c_nationkey")
    made = ml.to_arrays(ml.feature_matrix(df, ["a", "c_nationkey"]), "features", "v")
    return made.select("c_custkey", F.get("v", F.lit(0)).alias("a"), F.get("v", F.lit(1)).alias("b"))


@query("select vec_id, i - 1 as index, round(x, 5) as value from (select vec_id, unnest(embedding::double[]) as x, generate_subscripts(embedding, 1) as i from embeddings) where abs(x) > 0.1")
def sparse_entries(t):  # noqa: ANN001, ANN201
    made = ml.sparse_entries(t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")), "e", "vec_id", 0.1)
    return made.withColumn("value", F.round("value", 5)).withColumn("index", F.col("index").cast("long"))


@query("select doc_id, length(text)::float as a from documents")
def embedding_column(t):  # noqa: ANN001, ANN201
    made = vectors.embed(t("documents").select("doc_id", "text"), "text", _text_lengths, "e")
    return made.select("doc_id", F.get("e", F.lit(0)).alias("a"))


def _text_lengths(texts):  # noqa: ANN001, ANN202
    return texts.map(lambda x: None if x is None else [float(len(x))])


_Z = "(select p_partkey, (p_size - 25) / 10.0::double as z, (p_size % 2)::double as y from part)"


@query(f"select round(avg((z - y) * (z - y)), 6) as mse, round(sum(abs(z - y)), 4) as l1, round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 6) as bce from {_Z}")
def losses(t):  # noqa: ANN001, ANN201
    df = t("part").select(((F.col("p_size") - 25) / F.lit(10.0)).alias("z"), (F.col("p_size") % 2).cast("double").alias("y"))
    z, y = F.col("z"), F.col("y")
    return df.agg(F.round(activations.mse(z, y), 6).alias("mse"), F.round(activations.l1(z, y), 4).alias("l1"), F.round(activations.bce_with_logits(z, y), 6).alias("bce"))


@query(f"select p_partkey, round(case when z > 0 then z else z * 0.01 end, 6) as leaky, round(tanh(z), 6) as tanh_, round(greatest(-1, least(1, z)), 6) as clipped, round(z / (1 + exp(-z)), 6) as silu, round(ln(1 + exp(z)), 6) as softplus, round(case when z > 0 then z else exp(z) - 1 end, 6) as elu from {_Z}")
def more_activations(t):  # noqa: ANN001, ANN201
    z = F.col("z")
    df = t("part").select("p_partkey", ((F.col("p_size") - 25) / F.lit(10.0)).alias("z"))
    made = {"leaky": activations.leaky_relu(z), "tanh_": activations.tanh(z), "clipped": activations.clip(z, -1.0, 1.0), "silu": activations.silu(z), "softplus": activations.softplus(z), "elu": activations.elu(z)}
    return df.select("p_partkey", *(F.round(c, 6).alias(n) for n, c in made.items()))


@query("select vec_id, round(exp(embedding[1]::double) / list_sum(list_transform(embedding::double[], lambda x: exp(x))), 6) as first_ from embeddings")
def softmax_rows(t):  # noqa: ANN001, ANN201
    v = F.col("embedding").cast("array<double>")
    return t("embeddings").select("vec_id", F.round(F.get(activations.softmax(v), F.lit(0)), 6).alias("first_"))


"""One query for each operator of the library over the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.frame import Frame
from quillon.functions import activations, text, vectors
from quillon.functions.expressions import col, not_
from quillon.operators import aggregates as agg
from quillon.operators import columns, joins, rows, series, windows
from quillon.sources.files import scan_parquet
from quillon.sources.scratch import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


class Tables:
    """A reader of the test tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.folder = spark, sf_dir.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        return scan_parquet(self.spark, f"{self.folder}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    """Register a function that takes Tables."""
    def add(function: Callable) -> Callable:
        QUERIES[function.__name__] = lambda spark, sf_dir: _frame(function(Tables(spark, sf_dir)))
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def _frame(made: DataFrame | Frame) -> DataFrame:
    return made.df if isinstance(made, Frame) else made


def _rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


# --- scans, projections, filters ------------------------------------------------------------------


@query("select * from region")
def scan_table(t):  # noqa: ANN001, ANN201
    return t("region")


@query("select c_custkey, c_mktsegment from customer")
def select_columns(t):  # noqa: ANN001, ANN201
    return Frame(t("customer")).select("c_custkey", "c_mktsegment")


@query("select l_orderkey, round(l_extendedprice * (1 - l_discount), 4) as net, l_quantity * 2 as doubled from lineitem")
def select_computed(t):  # noqa: ANN001, ANN201
    made = Frame(t("lineitem")).select("l_orderkey", (col("l_extendedprice") * (1 - col("l_discount"))).alias("net"), (col("l_quantity") * 2).alias("doubled"))
    return _rounded(made.df, "net")


@query("select n_nationkey as id, n_name as nation, n_regionkey from nation")
def rename_columns(t):  # noqa: ANN001, ANN201
    return Frame(t("nation")).rename(n_nationkey="id", n_name="nation")


@query("select n_name as nation, n_regionkey from nation")
def select_and_rename(t):  # noqa: ANN001, ANN201
    return Frame(t("nation")).select_and_rename({"n_name": "nation", "n_regionkey": None})


@query("select p_partkey, p_name, p_brand, p_type, p_size from part")
def exclude_columns(t):  # noqa: ANN001, ANN201
    return Frame(t("part")).exclude("p_retailprice")


@query("select *, p_size + 1 as next_size from part")
def with_column(t):  # noqa: ANN001, ANN201
    return Frame(t("part")).with_column("next_size", col("p_size") + 1)


@query("select o_orderkey, o_totalprice from orders where o_totalprice >= 200000.0 and o_orderstatus = 'F'")
def filter_compare(t):  # noqa: ANN001, ANN201
    return Frame(t("orders")).filter((col("o_totalprice") >= 200000.0) & (col("o_orderstatus") == "F")).select("o_orderkey", "o_totalprice")


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where not (l_quantity > 10 and l_discount < 0.05) or l_returnflag = 'R'")
def filter_and_or_not(t):  # noqa: ANN001, ANN201
    made = Frame(t("lineitem")).filter(not_((col("l_quantity") > 10.0) & (col("l_discount") < 0.05)) | (col("l_returnflag") == "R"))
    return made.select("l_orderkey", "l_linenumber", "l_quantity")


@query("select o_orderkey from orders where o_orderkey % 7 = 3")
def filter_modulo(t):  # noqa: ANN001, ANN201
    return Frame(t("orders")).filter(col("o_orderkey") % 7 == 3).select("o_orderkey")


_NULLED = "(select event_id, case when event_id % 7 = 0 then null else value end as a, case when event_id % 5 = 0 then null else user_id end as b from events)"


def _nulled(t):  # noqa: ANN001, ANN202
    return t("events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("b"))


@query(f"select event_id from {_NULLED} where a is not null and b is not null and (a > 50 or b > 100)")
def filter_null_strict_or(t):  # noqa: ANN001, ANN201
    return Frame(_nulled(t)).filter((col("a") > 50.0) | (col("b") > 100)).select("event_id")


@query(f"select event_id, case when a is not null and b is not null then (a > 50 or b > 100) end as either, case when a is not null and b is not null then (a > 50 and b > 100) end as both_ from {_NULLED}")
def null_strict_projection(t):  # noqa: ANN001, ANN201
    return Frame(_nulled(t)).select("event_id", ((col("a") > 50.0) | (col("b") > 100)).alias("either"), ((col("a") > 50.0) & (col("b") > 100)).alias("both_"))


@query("select c_custkey, c_name from (select *, c_acctbal > 0 as good from customer) where good")
def filter_by_mask(t):  # noqa: ANN001, ANN201
    return Frame(t("customer").withColumn("good", F.col("c_acctbal") > 0)).filter_by_mask("good").select("c_custkey", "c_name")


@query("select c_custkey, c_acctbal from customer where c_acctbal > 1000 and length(c_name) > 5")
def filter_row_function(t):  # noqa: ANN001, ANN201
    return columns.where_row(t("customer").select("c_custkey", "c_acctbal", "c_name"), lambda b: (b.c_acctbal > 1000) & (b.c_name.str.len() > 5)).select("c_custkey", "c_acctbal")


@query("select p_partkey, p_size + p_partkey as int_plus_long, cast(p_size as float) * cast(2.5 as float) as float_times, p_size + p_retailprice as int_plus_double from part")
def arith_promotion(t):  # noqa: ANN001, ANN201
    df = t("part").withColumn("f", F.lit(2.5).cast("float"))
    return Frame(df).select("p_partkey", (col("p_size") + col("p_partkey")).alias("int_plus_long"), (col("p_size") * col("f")).alias("float_times"), (col("p_size") + col("p_retailprice")).alias("int_plus_double"))


@query("select p_partkey, (p_size - 25) // 4 as quotient, (p_size - 25) % 4 as rest, round(p_retailprice / p_size, 4) as price from part")
def integer_division(t):  # noqa: ANN001, ANN201
    made = Frame(t("part")).select("p_partkey", ((col("p_size") - 25) / 4).alias("quotient"), ((col("p_size") - 25) % 4).alias("rest"), (col("p_retailprice") / col("p_size")).alias("price"))
    return _rounded(made.df, "price")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, upper(l_returnflag) || '!' as flag, l_quantity * l_quantity as squared from lineitem")
def udf_transform(t):  # noqa: ANN001, ANN201
    df = t("lineitem").select(*_LINE, "l_returnflag", "l_quantity")
    made = columns.transform(df, "l_returnflag", lambda v: v.upper() + "!", "string", "flag")
    return columns.transform(made, "l_quantity", lambda c: c * c, to="squared").drop("l_returnflag", "l_quantity")


@query(f"select event_id, a * b as product from {_NULLED}")
def zip_columns(t):  # noqa: ANN001, ANN201
    return columns.zip_columns(_nulled(t), "a", "b", lambda x, y: x * y, "product").select("event_id", "product")


@query("select c_custkey, c_acctbal * c_nationkey as weighed from customer")
def with_computed(t):  # noqa: ANN001, ANN201
    return Frame(t("customer")).with_computed("weighed", ["c_acctbal", "c_nationkey"], lambda a, b: a * b).select("c_custkey", "weighed")


@query(f"select event_id, coalesce(a, 0.0) as a, b from {_NULLED}")
def fill_null(t):  # noqa: ANN001, ANN201
    return Frame(_nulled(t)).fill_null("a", 0.0)


@query(f"select event_id, last_value(a ignore nulls) over (order by event_id rows unbounded preceding) as a from {_NULLED}")
def fill_forward(t):  # noqa: ANN001, ANN201
    return Frame(_nulled(t).select("event_id", "a"), "event_id").fill_forward("a", strict=False)


@query(f"select event_id, first_value(a ignore nulls) over (order by event_id rows between current row and unbounded following) as a from {_NULLED}")
def fill_backward(t):  # noqa: ANN001, ANN201
    return Frame(_nulled(t).select("event_id", "a"), "event_id").fill_backward("a", strict=False)


@query(f"select * from {_NULLED} where a is not null and b is not null")
def drop_nulls(t):  # noqa: ANN001, ANN201
    return Frame(_nulled(t)).drop_nulls("a", "b")


@query(f"select count(*) filter (event_id is null) as event_id, count(*) filter (a is null) as a, count(*) filter (b is null) as b from {_NULLED}")
def null_counts(t):  # noqa: ANN001, ANN201
    return columns.null_counts(_nulled(t))


@query(f"select event_id from {_NULLED} where a is null")
def null_positions(t):  # noqa: ANN001, ANN201
    return columns.null_positions(_nulled(t), "a", "event_id")


@query("select p_partkey, round((p_size - avg(p_size) over ()) / stddev_pop(p_size) over (), 4) as p_size, round((p_retailprice - avg(p_retailprice) over ()) / stddev_pop(p_retailprice) over (), 4) as p_retailprice from part")
def normalize_zscore(t):  # noqa: ANN001, ANN201
    return _rounded(rows.normalize(t("part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]), "p_size", "p_retailprice")


# --- joins ----------------------------------------------------------------------------------------

_C, _O = "(select c_custkey + 100 as c_custkey, c_name from customer)", "(select o_custkey as c_custkey, o_orderkey from orders)"


def _sides(t):  # noqa: ANN001, ANN202
    return t("customer").select((F.col("c_custkey") + 100).alias("c_custkey"), "c_name"), t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")


@query(f"select c.c_custkey, c_name, o_orderkey from {_C} c join {_O} o on c.c_custkey = o.c_custkey")
def join_inner(t):  # noqa: ANN001, ANN201
    return joins.inner_join(*_sides(t), "c_custkey")


@query(f"select c.c_custkey, c_name, o_orderkey from {_C} c left join {_O} o on c.c_custkey = o.c_custkey")
def join_left(t):  # noqa: ANN001, ANN201
    return joins.left_join(*_sides(t), "c_custkey")


@query(f"select coalesce(c.c_custkey, o.c_custkey) as c_custkey, c_name, o_orderkey from {_C} c right join {_O} o on c.c_custkey = o.c_custkey")
def join_right(t):  # noqa: ANN001, ANN201
    return joins.right_join(*_sides(t), "c_custkey")


@query(f"select coalesce(c.c_custkey, o.c_custkey) as c_custkey, c_name, o_orderkey from {_C} c full join {_O} o on c.c_custkey = o.c_custkey")
def join_full_coalesced_key(t):  # noqa: ANN001, ANN201
    return joins.full_outer_join(*_sides(t), "c_custkey")


@query("select l.l_partkey, l.l_suppkey, l.l_orderkey, s.n as times from lineitem l join (select l_partkey, l_suppkey, count(*) as n from lineitem group by all) s on l.l_partkey = s.l_partkey and l.l_suppkey = s.l_suppkey")
def join_composite_key(t):  # noqa: ANN001, ANN201
    times = agg.group_by(t("lineitem"), ["l_partkey", "l_suppkey"], [agg.row_count("times")])
    return joins.inner_join(t("lineitem").select("l_partkey", "l_suppkey", "l_orderkey"), times, ["l_partkey", "l_suppkey"])


@query("select o_orderkey, o_custkey, c_nationkey from orders join customer on o_custkey = c_custkey")
def join_keys_differ(t):  # noqa: ANN001, ANN201
    return joins.inner_join(t("orders").select("o_orderkey", "o_custkey"), t("customer").select("c_custkey", "c_nationkey"), [("o_custkey", "c_custkey")])


@query("select n_nationkey as key, n.n_name as name_left, r.r_name as name_right from nation n join region r on n.n_nationkey = r.r_regionkey")
def join_suffix_conflict(t):  # noqa: ANN001, ANN201
    left, right = t("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), t("region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    return joins.inner_join(left, right, "key")


@query("select n_nationkey as key, n.n_name as l_name, r.r_name as r_name from nation n join region r on n.n_nationkey = r.r_regionkey")
def join_prefix_conflict(t):  # noqa: ANN001, ANN201
    left, right = t("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), t("region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    return joins.inner_join(left, right, "key", conflict="prefix", left_label="l", right_label="r")


@query("select coalesce(c.k, n.k) as k, c_custkey, n_name from (select nullif(c_nationkey, 3) as k, c_custkey from customer) c full join (select nullif(n_nationkey, 3) as k, n_name from nation) n on c.k = n.k")
def join_null_keys(t):  # noqa: ANN001, ANN201
    left = t("customer").select(F.nullif("c_nationkey", F.lit(3)).alias("k"), "c_custkey")
    return joins.full_outer_join(left, t("nation").select(F.nullif("n_nationkey", F.lit(3)).alias("k"), "n_name"), "k")


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")
def join_semi(t):  # noqa: ANN001, ANN201
    return joins.join(t("customer").select("c_custkey", "c_name"), t("orders").where("o_totalprice > 300000"), [("c_custkey", "o_custkey")], "left_semi")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def join_anti(t):  # noqa: ANN001, ANN201
    return joins.join(t("customer").select("c_custkey", "c_name"), t("orders").where("o_totalprice > 300000"), [("c_custkey", "o_custkey")], "left_anti")


# --- aggregates -----------------------------------------------------------------------------------


@query("select distinct l_returnflag, l_linestatus from lineitem")
def groupby_keys_only(t):  # noqa: ANN001, ANN201
    return Frame(t("lineitem")).group_by("l_returnflag", "l_linestatus")


@query(
    """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_net,
    round(avg(l_quantity), 4) as avg_qty, min(l_discount) as min_discount, max(l_tax) as max_tax, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all"""
)
def groupby_aggregates(t):  # noqa: ANN001, ANN201
    line = Frame(t("lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")).with_column("net", col("l_extendedprice") * (1 - col("l_discount")))
    made = line.group_by(
        "l_returnflag", "l_linestatus",
        agg=[agg.sum_("l_quantity", "sum_qty"), agg.sum_("l_extendedprice", "sum_base"), agg.sum_("net", "sum_net"), agg.mean("l_quantity", "avg_qty"), agg.min_("l_discount", "min_discount"), agg.max_("l_tax", "max_tax"), agg.row_count("n")],
    )
    return _rounded(_rounded(made.df, "sum_qty", "sum_base", "sum_net", digits=2), "avg_qty")


@query("select o_orderkey % 10 as bucket, round(sum(o_totalprice * 2), 2) as twice from orders group by all")
def groupby_expression_key(t):  # noqa: ANN001, ANN201
    made = Frame(t("orders")).group_by((col("o_orderkey") % 10).alias("bucket"), agg=[agg.sum_(col("o_totalprice") * 2, "twice")])
    return _rounded(made.df, "twice", digits=2)


@query("select nullif(c_nationkey, 3) as nation, count(*) as n, count(case when c_acctbal > 0 then c_acctbal end) as known from customer group by all")
def groupby_null_key(t):  # noqa: ANN001, ANN201
    df = t("customer").select(F.nullif("c_nationkey", F.lit(3)).alias("nation"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))
    return Frame(df).group_by("nation", agg=[agg.row_count("n"), agg.count("balance", "known")])


@query("select event_type, count(a) as known, count(*) as n from (select event_type, case when event_id % 7 = 0 then null else value end as a from events) group by all")
def count_vs_rowcount(t):  # noqa: ANN001, ANN201
    df = t("events").select("event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("a"))
    return agg.group_by(df, "event_type", [agg.count("a", "known"), agg.row_count("n")])


@query(
    """select event_type, round(coalesce(sum(a), 0), 4) as total, sum(u)::bigint as users, round(avg(a), 4) as mean, min(a) as low, max(a) as high
    from (select event_type, case when event_type = 'click' then null else value end as a, user_id as u from events) group by all"""
)
def sum_all_null_zero(t):  # noqa: ANN001, ANN201
    df = t("events").select("event_type", F.when(F.col("event_type") != "click", F.col("value")).alias("a"), F.col("user_id").alias("u"))
    made = agg.group_by(df, ["event_type"], [agg.sum_("a", "total"), agg.sum_("u", "users"), agg.mean("a", "mean"), agg.min_("a", "low"), agg.max_("a", "high")])
    return _rounded(made, "total", "mean")


@query("select o_orderstatus, round(sum(o_totalprice), 2) as o_totalprice, count(o_orderkey) as o_orderkey from orders group by all")
def groupby_dict(t):  # noqa: ANN001, ANN201
    return _rounded(agg.group_by_dict(t("orders"), "o_orderstatus", {"o_totalprice": "sum", "o_orderkey": "count"}), "o_totalprice", digits=2)


@query("select l_returnflag, median(l_quantity) as mid from lineitem group by all")
def udaf_median(t):  # noqa: ANN001, ANN201
    return agg.group_by(t("lineitem"), "l_returnflag", [agg.median("l_quantity", "mid")])


@query("select p_brand, round(max(p_retailprice) - min(p_retailprice), 4) as spread from part group by all")
def udaf_python(t):  # noqa: ANN001, ANN201
    return _rounded(agg.custom_aggregate(t("part"), "p_brand", "p_retailprice", lambda v: float(v.max() - v.min()), "double", "spread"), "spread")


@query("select distinct event_type, user_id from events")
def distinct_all(t):  # noqa: ANN001, ANN201
    return Frame(t("events").select("event_type", "user_id")).distinct()


@query("select event_id, event_type, user_id, value from events qualify row_number() over (partition by event_type, user_id order by event_id) = 1")
def distinct_on_first(t):  # noqa: ANN001, ANN201
    return Frame(t("events").select("event_id", "event_type", "user_id", "value"), "event_id").distinct("event_type", "user_id")


# --- windows --------------------------------------------------------------------------------------

_EVENTS = "(select event_id, event_type, cast(value as integer) as v, case when event_id % 4 = 0 then null else cast(value as integer) end as x from events)"


def _events(t):  # noqa: ANN001, ANN202
    v = F.bround("value").cast("int")
    return Frame(t("events").select("event_id", "event_type", v.alias("v"), F.when(F.col("event_id") % 4 != 0, v).alias("x")), "event_id")


def _rolling(made: str, least: int, of: str = "x", size: int = 5) -> str:
    w = f"over (order by event_id rows between {size - 1} preceding and current row)"
    return f"select *, case when count({of}) {w} >= {least} then {made.format(x=of, w=w)} end as r from {_EVENTS}"


@query(_rolling("sum({x}) {w}", 5, "v").replace("then sum", "then (sum").replace("current row) end", "current row))::integer end"))
def rolling_sum(t):  # noqa: ANN001, ANN201
    return _events(t).rolling("sum", "v", "r", 5)


@query(_rolling("round(avg({x}) {w}, 4)", 2))
def rolling_mean_min_periods(t):  # noqa: ANN001, ANN201
    return _rounded(_events(t).rolling("mean", "x", "r", 5, min_periods=2).df, "r")


@query(_rolling("min({x}) {w}", 5, "v"))
def rolling_min(t):  # noqa: ANN001, ANN201
    return _events(t).rolling("min", "v", "r", 5)


@query(_rolling("max({x}) {w}", 3))
def rolling_max(t):  # noqa: ANN001, ANN201
    return _events(t).rolling("max", "x", "r", 5, min_periods=3)


@query(f"select *, (sum(coalesce(x, 7)) over (order by event_id rows between 2 preceding and current row))::integer as r from {_EVENTS}")
def rolling_null_handler(t):  # noqa: ANN001, ANN201
    return _events(t).rolling("sum", "x", "r", 3, null_value=7)


@query(f"select *, case when count(x) over w >= 3 then (sum(x) over w)::integer end as r from {_EVENTS} window w as (partition by event_type order by event_id rows between 3 preceding and current row)")
def rolling_partitioned(t):  # noqa: ANN001, ANN201
    return _events(t).rolling("sum", "x", "r", 4, min_periods=3, partition="event_type")


_SO_FAR = "over (order by event_id rows unbounded preceding)"


@query(f"select *, case when x is not null then (sum(x) {_SO_FAR})::integer end as r from {_EVENTS}")
def cumulative_sum(t):  # noqa: ANN001, ANN201
    return _events(t).cumulative("sum", "x", "r")


@query(f"select *, case when x is not null then (sum(x) {_SO_FAR})::integer end as r from {_EVENTS}")
def cumulative_sum_global(t):  # noqa: ANN001, ANN201
    return windows.cumulative_sum_global(_events(t).df, "x", "r", "event_id")


@query(f"select *, case when x is not null then min(x) {_SO_FAR} end as r from {_EVENTS}")
def cumulative_min(t):  # noqa: ANN001, ANN201
    return _events(t).cumulative("min", "x", "r")


@query(f"select *, case when x is not null then max(x) {_SO_FAR} end as r from {_EVENTS}")
def cumulative_max(t):  # noqa: ANN001, ANN201
    return _events(t).cumulative("max", "x", "r")


@query("select p_partkey, sign_, product(sign_) over (order by p_partkey rows unbounded preceding)::bigint as r from (select p_partkey, case when p_size % 3 = 0 then -1 else 1 end::bigint as sign_ from part)")
def cumulative_product(t):  # noqa: ANN001, ANN201
    df = t("part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, -1).otherwise(1).cast("long").alias("sign_"))
    return Frame(df, "p_partkey").cumulative("product", "sign_", "r")


@query("select p_partkey, f, product(f) over (partition by p_brand order by p_partkey rows unbounded preceding) as r from (select p_partkey, p_brand, case when p_size % 2 = 0 then 2.0 else 0.5 end::double as f from part)")
def cumulative_product_partitioned(t):  # noqa: ANN001, ANN201
    df = t("part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 2 == 0, 2.0).otherwise(0.5).alias("f"))
    return Frame(df, "p_partkey").cumulative("product", "f", "r", partition="p_brand").exclude("p_brand")


@query(f"select *, case when x is not null then count(x) {_SO_FAR} end as r from {_EVENTS}")
def cumulative_count(t):  # noqa: ANN001, ANN201
    return _events(t).cumulative("count", "x", "r")


@query(f"select *, lag(x, 2) over (order by event_id) as r from {_EVENTS}")
def shift_lag(t):  # noqa: ANN001, ANN201
    return _events(t).shift("x", "r", 2)


@query(f"select *, lag(x, 3, -1) over (order by event_id) as r from {_EVENTS}")
def shift_fill(t):  # noqa: ANN001, ANN201
    return _events(t).shift("x", "r", 3, -1)


@query(f"select *, lead(x, 1) over (order by event_id) as r from {_EVENTS}")
def lead(t):  # noqa: ANN001, ANN201
    return _events(t).lead("x", "r", 1)


@query("select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as r from orders")
def row_number(t):  # noqa: ANN001, ANN201
    return Frame(t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey").row_number("r", "o_totalprice", "o_custkey").exclude("o_totalprice")


def _ranked(function: str) -> str:
    return f"select p_partkey, p_brand, p_size, {function}() over (partition by p_brand order by p_size) as r from part"


@query(_ranked("rank"))
def rank(t):  # noqa: ANN001, ANN201
    return Frame(t("part").select("p_partkey", "p_brand", "p_size")).rank("r", "p_size", "p_brand")


@query(_ranked("dense_rank"))
def dense_rank(t):  # noqa: ANN001, ANN201
    return Frame(t("part").select("p_partkey", "p_brand", "p_size")).rank("r", "p_size", "p_brand", "dense_rank")


@query("select p_partkey, p_brand, p_size, round(percent_rank() over (partition by p_brand order by p_size), 6) as r from part")
def percent_rank(t):  # noqa: ANN001, ANN201
    return _rounded(Frame(t("part").select("p_partkey", "p_brand", "p_size")).rank("r", "p_size", "p_brand", "percent_rank").df, "r", digits=6)


@query("select p_partkey, p_brand, s, case when s is not null then rank() over (partition by p_brand, s is null order by s) end as r from (select p_partkey, p_brand, nullif(p_size % 10, 4) as s from part)")
def rank_null_key(t):  # noqa: ANN001, ANN201
    df = t("part").select("p_partkey", "p_brand", F.nullif(F.col("p_size") % 10, F.lit(4)).alias("s"))
    return Frame(df).rank("r", "s", "p_brand")


# --- order and position ---------------------------------------------------------------------------


@query("select o_orderkey, o_orderpriority, p, row_number() over (order by o_orderpriority desc, p asc nulls first, o_orderkey) as place from (select o_orderkey, o_orderpriority, case when o_orderkey % 3 = 0 then null else round(o_totalprice) end as p from orders)")
def sort_multi_null_order(t):  # noqa: ANN001, ANN201
    p = F.when(F.col("o_orderkey") % 3 != 0, F.round("o_totalprice"))
    made = Frame(t("orders").select("o_orderkey", "o_orderpriority", p.alias("p")), "o_orderkey").sort(rows.SortKey("o_orderpriority", False)).then_by(rows.SortKey("p", nulls_first=True))
    return rows.numbered_as_sorted(made.df, "place").withColumn("place", F.col("place") + 1)


@query("select p_partkey, p_size, (row_number() over (order by p_size % 7, p_partkey) - 1)::bigint as place from part")
def sort_expression(t):  # noqa: ANN001, ANN201
    made = Frame(t("part").select("p_partkey", "p_size"), "p_partkey").sort(col("p_size") % 7)
    return rows.numbered_as_sorted(made.df, "place")


@query("select o_orderkey, o_totalprice from orders order by o_orderkey limit 25")
def take(t):  # noqa: ANN001, ANN201
    return Frame(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey").take(25)


@query("select c_custkey, c_name from customer order by c_custkey offset 100")
def skip(t):  # noqa: ANN001, ANN201
    return Frame(t("customer").select("c_custkey", "c_name"), "c_custkey").skip(100)


@query("select o_orderkey, o_totalprice from orders order by o_orderkey limit 30 offset 70")
def slice_rows(t):  # noqa: ANN001, ANN201
    return Frame(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey").slice(70, 30)


@query("select s_suppkey, s_name from (select *, row_number() over (order by s_suppkey) - 1 as i from supplier) join (values (7), (2), (2), (0)) w(i) using (i)")
def select_rows(t):  # noqa: ANN001, ANN201
    return Frame(t("supplier").select("s_suppkey", "s_name"), "s_suppkey").select_rows(7, 2, 2, 0)


@query("select o_orderkey, o_totalprice, row_number() over (order by o_totalprice, o_orderkey) - 1 as row_id from orders")
def numbered_rows(t):  # noqa: ANN001, ANN201
    return rows.numbered(t("orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])




@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def top_k(t):  # noqa: ANN001, ANN201
    return rows.top_k(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20, "o_orderkey")


@query("select s_suppkey, (row_number() over (order by s_acctbal desc, s_suppkey) - 1)::bigint as place from supplier")
def arg_sort(t):  # noqa: ANN001, ANN201
    return rows.arg_sort(t("supplier"), "s_acctbal", "s_suppkey", descending=True)


# --- concatenation and series ---------------------------------------------------------------------


@query("select c_custkey as id, c_name as name, c_acctbal as balance from customer union all select s_suppkey, s_name, null from supplier")
def concat_vertical_fill(t):  # noqa: ANN001, ANN201
    a = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return rows.concat_rows([a, t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))])


@query("select c_custkey as id, c_acctbal as balance from customer union all select s_suppkey, s_acctbal from supplier")
def concat_vertical_strict(t):  # noqa: ANN001, ANN201
    a, b = (t(n).select(F.col(k).alias("id"), F.col(v).alias("balance")) for n, k, v in (("customer", "c_custkey", "c_acctbal"), ("supplier", "s_suppkey", "s_acctbal")))
    return Frame(a).concat(Frame(b))


@query("select c_custkey, c_name, p, q from (select c_custkey, c_name, row_number() over (order by c_custkey) as i from customer) join (select c_custkey as p, c_acctbal as q, row_number() over (order by c_acctbal, c_custkey) as i from customer) using (i)")
def concat_horizontal(t):  # noqa: ANN001, ANN201
    other = t("customer").select(F.col("c_custkey").alias("p"), F.col("c_acctbal").alias("q"))
    return rows.concat_columns([t("customer").select("c_custkey", "c_name"), other], ["c_custkey", ["q", "p"]])


_SERIES = "(select l_suppkey % 50 as label, round(sum(l_quantity), 2) as value from lineitem where l_returnflag = '{}' and l_suppkey % 50 > {} group by all)"


def _of(t, flag: str, above: int):  # noqa: ANN001, ANN202
    made = agg.group_by(t("lineitem").where(f"l_returnflag = '{flag}' and l_suppkey % 50 > {above}"), (col("l_suppkey") % 50).alias("label"), [agg.sum_("l_quantity", "value")])
    return series.of(_rounded(made, "value", digits=2), "label", "value", "label")


@query(f"select label, round(a.value + b.value, 2) as value, label as position from {_SERIES.format('R', 10)} a join {_SERIES.format('N', 20)} b using (label)")
def series_align_add(t):  # noqa: ANN001, ANN201
    return _rounded(series.add(_of(t, "R", 10), _of(t, "N", 20)), "value", digits=2)


@query(f"select label, value, label as position from {_SERIES.format('A', 0)} order by value desc, label limit 5")
def series_topk(t):  # noqa: ANN001, ANN201
    return series.top_k(_of(t, "A", 0), 5)


# --- vectors and text -----------------------------------------------------------------------------

_Q = [round(((i * 37) % 64 - 31.5) / 64, 6) for i in range(64)]
_QUERY = f"{_Q}::double[]"


@query(f"select vec_id, round(list_dot_product(embedding::double[], {_QUERY}), 4) as score from embeddings")
def row_dot(t):  # noqa: ANN001, ANN201
    return _rounded(vectors.row_dot(t("embeddings").select("vec_id", "embedding"), "embedding", _Q), "score").drop("embedding")


@query(f"select vec_id, round(list_cosine_similarity(embedding::double[], {_QUERY}), 4) as score from embeddings order by list_cosine_similarity(embedding::double[], {_QUERY}) desc, vec_id limit 10")
def row_cosine_topk(t):  # noqa: ANN001, ANN201
    return _rounded(vectors.search(t("embeddings").select("vec_id", "embedding"), "embedding", _Q, 10, "vec_id"), "score").drop("embedding")


@query("select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 4) as norm from embeddings")
def row_norms(t):  # noqa: ANN001, ANN201
    return _rounded(vectors.row_norms(t("embeddings").select("vec_id", "embedding"), "embedding"), "norm").drop("embedding")


@query("select c_custkey, round(c_acctbal * 0.5 + c_nationkey * 2, 4) as score from customer")
def row_dot_wide(t):  # noqa: ANN001, ANN201
    return _rounded(vectors.row_dot(t("customer").select("c_custkey", "c_acctbal", "c_nationkey"), ["c_acctbal", "c_nationkey"], [0.5, 2.0]), "score").select("c_custkey", "score")


@query("select a.p_brand as row, b.p_type as col, count(*)::double as value from part a join part b using (p_size) group by all")
def matmul(t):  # noqa: ANN001, ANN201
    cell = lambda k: agg.group_by(t("part"), [k, "p_size"], [agg.row_count("value")])
    left = cell("p_brand").select(F.col("p_brand").alias("row"), F.col("p_size").alias("col"), F.col("value").cast("double"))
    return vectors.matmul(left, vectors.transpose(cell("p_type").select(F.col("p_type").alias("row"), F.col("p_size").alias("col"), F.col("value").cast("double"))))


@query("select p_partkey, round(1 / (1 + exp(-z)), 6) as sigmoid, greatest(z, 0) as relu, round(0.5 * z * (1 + tanh(sqrt(2 / pi()) * (z + 0.044715 * z * z * z))), 6) as gelu from (select p_partkey, (p_size - 25) / 10.0::double as z from part)")
def activation_functions(t):  # noqa: ANN001, ANN201
    z = F.col("z")
    df = t("part").select("p_partkey", ((F.col("p_size") - 25) / F.lit(10.0)).alias("z"))
    return df.select("p_partkey", F.round(activations.sigmoid(z), 6).alias("sigmoid"), activations.relu(z).alias("relu"), F.round(activations.gelu(z), 6).alias("gelu"))


@query("select doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda w: w <> ''))::integer as n from documents")
def tokenize_counts(t):  # noqa: ANN001, ANN201
    return t("documents").select("doc_id", text.word_count(F.col("text")).alias("n"))


_WORDS = "(select w as token, count(*) as n from (select unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}]+')) as w from documents) where w <> '' group by w)"


@query(f"select token, n, (row_number() over (order by n desc, token) + 3)::integer as id from (select * from {_WORDS} order by n desc, token limit 996) union all select * from (values ('<PAD>', 0::bigint, 0), ('<UNK>', 0::bigint, 1), ('<BOS>', 0::bigint, 2), ('<EOS>', 0::bigint, 3))")
def vocab_topn(t):  # noqa: ANN001, ANN201
    return text.vocabulary(t("documents"), "text", 1000)


_VOCAB = f"(select token, (row_number() over (order by n desc, token) + 3)::integer as id from (select * from {_WORDS} order by n desc, token limit 996))"
_PLACED = "(select doc_id, unnest(w) as token, generate_subscripts(w, 1) as nth from (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda w: w <> '') as w from documents))"


@query(f"select d.doc_id, concat_ws(' ', '2', x.ids, '3') as ids from documents d left join (select doc_id, string_agg(coalesce(id, 1)::varchar, ' ' order by nth) as ids from {_PLACED} left join {_VOCAB} using (token) group by doc_id) x using (doc_id)")
def encode_tokens(t):  # noqa: ANN001, ANN201
    ids = text.encode(t("documents"), text.vocabulary(t("documents"), "text", 1000), "text", "doc_id")
    return ids.select("doc_id", F.array_join("ids", " ").alias("ids"))


@query(f"select d.doc_id, coalesce(words, '') as words from documents d left join (select doc_id, string_agg(case when v.id is null then '<UNK>' else token end, ' ' order by nth) as words from {_PLACED} left join {_VOCAB} v using (token) group by doc_id) x using (doc_id)")
def decode_tokens(t):  # noqa: ANN001, ANN201
    vocab = text.vocabulary(t("documents"), "text", 1000)
    return text.decode(text.encode(t("documents"), vocab, "text", "doc_id"), vocab, "ids", "words").select("doc_id", "words")


@query(SQL["vocab_topn"])
def vocab_saved(t):  # noqa: ANN001, ANN201
    spark, path = t.spark, scratch_path(t.spark, "vocabulary")
    text.save_vocabulary(text.vocabulary(t("documents"), "text", 1000), path)
    return text.load_vocabulary(spark, path).select("token", "n", "id")


# --- splits, streams and models -------------------------------------------------------------------


@query("select event_type, time_bucket(interval 1 day, ts) as day, count(*) as n, round(sum(value), 3) as total from events group by all")
def event_time_window(t):  # noqa: ANN001, ANN201
    from quillon.streaming.streams import windowed

    made = windowed(t("events"), "ts", "1 day", [F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total")], ["event_type"])
    return made.select("event_type", F.col("window_start").alias("day"), "n", "total")


@query("select *, case when row_number() over (order by substr(md5('1:' || doc_id), 1, 15), doc_id) <= floor((select count(*) from labels) * 0.8::double) then 'train' else 'test' end as part from labels")
def train_test_split(t):  # noqa: ANN001, ANN201
    train, test = rows.train_test_split(t("labels"), "doc_id", 0.8, 1)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query()
def ml_logistic(t):  # noqa: ANN001, ANN201
    from quillon import ml

    df = t("documents").join(t("labels"), "doc_id").select("doc_id", (F.length(F.regexp_replace("text", "[^!|#$%&*]", "")) / F.length("text")).alias("odd"), F.log1p("n_chars").alias("size"), F.col("quality").cast("double").alias("label"))
    ready = ml.feature_matrix(df, ["odd", "size"])
    return ml.pipeline("binary").fit(ready).transform(ready).select("doc_id", "label", "prediction")



from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon import ml
from quillon.errors import ColumnNotFound, JoinError, OrderError, QuillonError, SchemaError, TypeMismatch, UnsupportedExpression
from quillon.frame import Frame
from quillon.functions import activations, text, vectors
from quillon.functions.expressions import col, lit, not_
from quillon.operators import aggregates as agg
from quillon.operators import columns, joins, rows, series, windows
from quillon.types import promote


def values(frame, name):
    return [r[name] for r in frame.collect()]


@pytest.fixture(scope="module")
def people(spark):
    data = [("Alice", "NYC", 25, 80000.0, True), ("Bob", "LA", 40, 120000.0, True), ("Carol", "NYC", 35, 95000.0, False), ("Dan", "LA", 20, 50000.0, False), ("Eve", "NYC", 50, 110000.0, True)]
    return Frame.create(spark, data, "Name string, City string, Age int, Salary double, IsActive boolean")


def numbers(spark, xs, kind="int"):
    return Frame.create(spark, [(x,) for x in xs], f"v {kind}")


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [(T.ByteType(), T.ByteType(), T.IntegerType()), (T.FloatType(), T.LongType(), T.FloatType()), (T.FloatType(), T.DoubleType(), T.DoubleType()), (T.DecimalType(10, 2), T.DoubleType(), T.DoubleType()), (T.IntegerType(), T.DecimalType(10, 2), T.DecimalType(38, 2)), (T.ShortType(), T.LongType(), T.LongType())],
)
def test_promotion(a, b, want):
    assert promote(a, b) == promote(b, a) == want


def test_no_common_type():
    with pytest.raises(TypeMismatch):
        promote(T.StringType(), T.IntegerType())


def test_expressions(spark, people):
    got = people.select((col("Age") / 2).alias("half"), (lit(7) % col("Age")).alias("rest"), (col("Salary") / 0.0).alias("inf"), not_(col("IsActive")).alias("idle"))
    first = got.df.first()
    assert (first.half, first.rest, first.inf, first.idle) == (12, 7, math.inf, False)
    assert got.schema["half"].dataType == T.IntegerType()
    assert (col("Price") * col("Qty")).name == "(Price * Qty)"
    with pytest.raises(ColumnNotFound):
        people.filter(col("Nobody") > 1)
    with pytest.raises(TypeMismatch):
        people.filter(col("Age") + 1)
    with pytest.raises(TypeMismatch):
        people.select(col("Name") + 1)
    with pytest.raises(UnsupportedExpression):
        lit(None)
    with pytest.raises(UnsupportedExpression):
        bool(col("Age") > 1 and col("Age") < 3)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.none() | st.integers(-3, 3), st.none() | st.integers(-3, 3)), min_size=1, max_size=8))
def test_null_strict_logic(spark, pairs):
    f = Frame.create(spark, pairs, "a int, b int")
    got = values(f.select(((col("a") > 0) | (col("b") > 0)).alias("e"), (not_((col("a") > 0) & (col("b") > 0))).alias("n"), "row_id"), "e")
    assert got == [None if a is None or b is None else a > 0 or b > 0 for a, b in pairs]
    kept = {r.row_id for r in f.filter(not_((col("a") > 0) & (col("b") > 0))).collect()}
    assert kept == {i for i, (a, b) in enumerate(pairs) if a is not None and b is not None and not (a > 0 and b > 0)}


def test_columns(people):
    assert people.select_and_rename({"Name": "who"}).columns == ["who"]
    assert people.exclude("row_id", "IsActive").columns == ["Name", "City", "Age", "Salary"]
    for bad in (lambda: people.with_column("age", col("Age")), lambda: people.rename(Age="City"), lambda: people.exclude(*people.columns), lambda: people.select()):
        with pytest.raises(SchemaError):
            bad()
    assert values(people.transform("Age", lambda v: v + 1, "int"), "Age") == [26, 41, 36, 21, 51]
    assert values(people.zip("Age", "Salary", lambda a, b: a + b, "t"), "t")[0] == 80025.0


def test_groups(people):
    got = {r.City: r for r in people.group_by("City", agg=[agg.row_count("n"), agg.mean("Age", "mean"), agg.sum_("Age", "sum"), agg.max_("Age", "max")]).collect()}
    assert (got["NYC"].n, got["NYC"].mean, got["NYC"].sum, got["NYC"].max, got["LA"].n) == (3, 110 / 3, 110, 50, 2)
    assert values(people.sort("Age").skip(1).take(2), "Name") == ["Alice", "Carol"] or values(people.sort("Age").slice(1, 2), "Name") == ["Alice", "Carol"]


def test_group_keys_with_nulls(spark):
    assert len(Frame.create(spark, [("Alice",), (None,), ("Alice",), ("Bob",), (None,)], "Name string").group_by("Name").collect()) == 3


def test_sum_of_nulls(spark):
    f = Frame.create(spark, [("a", None), ("a", None), ("b", 2)], "k string, v int")
    got = {r.k: (r.s, r.m, r.n) for r in f.group_by("k", agg=[agg.sum_("v", "s"), agg.mean("v", "m"), agg.count("v", "n")]).collect()}
    assert got == {"a": (0, None, 0), "b": (2, 2.0, 1)}


def test_reductions(spark):
    f = numbers(spark, [1, None, 4]).df
    assert (agg.column_sum(f, "v"), agg.column_extreme(f, "v", True), agg.column_mean(f, "v"), agg.series_average(f, "v")) == (5, 4, 2.5, 2)
    with pytest.raises(QuillonError):
        agg.column_sum(f.limit(0), "v")


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(1, "Alice", 25), (2, "Bob", 30), (3, "Charlie", 35), (4, "David", 40)], "Id int, Name string, Age int")
    return left, spark.createDataFrame([(2, "HR"), (3, "IT"), (4, "Finance"), (5, "Marketing")], "Id int, Department string")


def test_joins(spark, sides):
    assert sorted(r.Id for r in joins.inner_join(*sides, "Id").collect()) == [2, 3, 4]
    right = joins.right_join(*sides, "Id")
    assert right.columns == ["Id", "Name", "Age", "Department"] and {r.Id: r.Name for r in right.collect()}[5] is None
    assert joins.full_outer_join(*sides, "Id").count() == 5
    with pytest.raises(TypeMismatch):
        joins.inner_join(sides[0], sides[1].withColumn("Id", sides[1].Id.cast("string")), "Id")
    both = (sides[0].select("Id", "Name"), sides[0].select("Id", "Name"))
    assert joins.inner_join(*both, "Id").columns == ["Id", "Name_left", "Name_right"]
    assert joins.inner_join(*both, "Id", conflict="prefix").columns == ["Id", "left_Name", "right_Name"]
    with pytest.raises(JoinError):
        joins.inner_join(*both, "Id", conflict="error")
    a, b = (spark.createDataFrame([(x,) for x in xs], "Id int") for xs in ([1, 2, None, 4], [2, None, 4, 5]))
    assert sorted(r.Id for r in joins.inner_join(a, b, "Id").collect()) == [2, 4]


@pytest.mark.parametrize(
    ("xs", "make", "want"),
    [
        ([1, None, 2, None, 3], lambda f: f.cumulative("sum", "v", "r"), [1, None, 3, None, 6]),
        ([1, None, 2], lambda f: f.cumulative("sum", "v", "r", null_value=5), [1, 6, 8]),
        ([3, None, 1, None, 2], lambda f: f.cumulative("max", "v", "r"), [3, None, 3, None, 3]),
        ([3, None, 1, None, 2], lambda f: f.cumulative("min", "v", "r"), [3, None, 1, None, 1]),
        ([1, None, 2, None, 3, 4], lambda f: f.cumulative("count", "v", "r"), [1, None, 2, None, 3, 4]),
        ([1, 2, 3, 4, 5], lambda f: f.rolling("sum", "v", "r", 3), [None, None, 6, 9, 12]),
        ([1, 2, 3, 4, 5], lambda f: f.rolling("sum", "v", "r", 3, min_periods=2), [None, 3, 6, 9, 12]),
        ([1, None, 3], lambda f: f.rolling("sum", "v", "r", 3, min_periods=2), [None, None, 4]),
        ([1, 2, 3], lambda f: f.shift("v", "r", 1), [None, 1, 2]),
        ([1, 2, 3], lambda f: f.shift("v", "r", 1, 0), [0, 1, 2]),
        ([1, 2, 3], lambda f: f.lead("v", "r", 1), [2, 3, None]),
        ([10, 20, 20, 30], lambda f: f.rank("r", "v"), [1, 2, 2, 4]),
        ([10, 20, 20, 30], lambda f: f.rank("r", "v", function="dense_rank"), [1, 2, 2, 3]),
        ([1, None, 3], lambda f: f.row_number("r", "v"), [1, None, 2]),
        ([1, None, 2], lambda f: f.rank("r", "v", function="percent_rank"), [0.0, None, 1.0]),
        ([None, None], lambda f: f.rank("r", "v"), [None, None]),
    ],
)
def test_windows(spark, xs, make, want):
    assert values(make(numbers(spark, xs)), "r") == want


def test_window_needs_an_order_and_a_free_name(spark):
    f = numbers(spark, [1, 2])
    with pytest.raises(OrderError):
        Frame(f.df).shift("v", "r", 1)
    with pytest.raises(SchemaError):
        f.shift("v", "V", 1)


def test_global_cumulative_sum(spark):
    f = spark.createDataFrame([(i, float(i % 5) if i % 3 else None) for i in range(500)], "k long, v double")
    a = {r.k: r.r for r in windows.cumulative(f, "sum", "v", "r", "k").collect()}
    assert {r.k: r.r for r in windows.cumulative_sum_global(f, "v", "r", "k").collect()} == a
    assert windows.cumulative_sum_global(f.limit(0), "v", "r", "k").count() == 0


def test_positions(spark):
    f = Frame.create(spark, [(10, "a"), (None, "b"), (30, "c")], "Numbers int, Letters string")
    assert values(f.reorder([1, 2, 0]), "Letters") == values(f.select_rows(1, 2, 0), "Letters") or sorted(values(f.select_rows(1, 2, 0), "Letters")) == ["a", "b", "c"]
    assert [r.Letters for r in rows.select_rows(f.df, [2, 0, 2], "row_id").collect()] == ["c", "a", "c"]
    with pytest.raises(QuillonError):
        rows.select_rows(f.df, [3], "row_id")
    with pytest.raises(QuillonError):
        rows.slice_(f.df, 2, 2, "row_id", strict=True)
    assert [r.n for r in rows.numbered(f.df, "row_id", "n").orderBy("row_id").collect()] == [0, 1, 2]


def test_concat(spark):
    a, b = Frame.create(spark, [("Alice", 25)], "Name string, Age int", False), Frame.create(spark, [("Charlie", 5.0)], "name string, Salary double", False)
    assert sorted(map(str, a.concat(b, fill=True).collect())) == sorted(["Row(Name='Alice', Age=25, Salary=None)", "Row(Name='Charlie', Age=None, Salary=5.0)"])
    with pytest.raises(SchemaError):
        a.concat(b)
    with pytest.raises(TypeMismatch):
        a.concat(Frame.create(spark, [("x", "y")], "Name string, Age string", False))


def test_series(spark):
    a = series.create(spark, [10, 20, 30], "int", ["a", "b", "c"], "string")
    b = series.create(spark, [100, 200, 300, 999], "int", ["b", "c", "d", "b"], "string")
    assert [(r.label, r.left, r.right) for r in series.align(a, b).orderBy("position").collect()] == [("b", 20, 100), ("c", 30, 200)]
    assert series.to_list(series.add(a, b)) == [120, 230] and series.to_list(series.multiply(a, 2)) == [20, 40, 60]
    assert series.get(b, "b") == 100 and not series.contains(a, "z")
    with pytest.raises(KeyError):
        series.get(a, "z")


def test_vectors(spark):
    f = Frame.from_rows(spark, [("A", [0.9, 0.2, 0.5, 0.4]), ("B", [0.1, 0.9, 0.2, 0.7]), ("C", [0.7, 0.1, 0.8, 0.2]), ("Z", [0, 0, 0, 0])])
    names = ["Col_0", "Col_1", "Col_2", "Col_3"]
    assert [r.Label for r in vectors.search(f.df, names, [0.8, 0.1, 0.6, 0.3], 3, "Label").collect()] == ["A", "C", "B"]
    assert math.isnan(values(f.row_cosine([1, 0, 0, 0], names), "score")[3])
    assert values(f.row_dot([1, None, 0, 0], names), "score") == [None] * 4
    assert f.to_tensor(*names).shape == (4, 4)
    with pytest.raises(SchemaError):
        Frame.from_rows(spark, [("A", [1]), ("B", [1, 2])])


def test_normalize(spark):
    z = np.array(values(Frame(rows.normalize(numbers(spark, [1, 2, None, 4, 5]).df, ["v"]), "row_id"), "v"), float)
    assert np.isnan(z[2]) and np.nanmean(z) == pytest.approx(0) and np.nanstd(z) == pytest.approx(1)
    assert values(Frame(rows.normalize(numbers(spark, [3, None, 3]).df, ["v"]), "row_id"), "v") == [3.0, None, 3.0]


def test_fill_and_nulls(spark):
    f = numbers(spark, [None, 1, None, 2])
    assert values(f.fill_forward("v", strict=False), "v") == [None, 1, 1, 2] and values(f.fill_backward("v"), "v") == [1, 1, 2, 2]
    with pytest.raises(Exception, match="nothing to fill"):
        f.fill_forward("v").collect()
    assert columns.null_counts(f.df).first().v == 2 and len(f.drop_nulls("v").collect()) == 2


def test_split_is_exact_and_steady(spark):
    f = spark.createDataFrame([(i,) for i in range(1001)], "k long")
    a, b = rows.train_test_split(f, "k", 0.8, 3)
    x, y = {r.k for r in a.collect()}, {r.k for r in b.collect()}
    assert len(x) == 800 and len(y) == 201 and not x & y
    assert {r.k for r in rows.train_test_split(f.repartition(7), "k", 0.8, 3)[0].collect()} == x


def test_text(spark):
    docs = spark.createDataFrame([(1, "The cat, the CAT 9!"), (2, None), (3, "dog")], "k long, t string")
    vocab = text.vocabulary(docs, "t", 6)
    assert [(r.token, r.id) for r in vocab.orderBy("id").collect()][4:] == [("cat", 4), ("the", 5)]
    ids = {r.k: r.ids for r in text.encode(docs, vocab, "t", "k", 7).collect()}
    assert ids == {1: [2, 5, 4, 5, 4, 1, 3], 2: [2, 3, 0, 0, 0, 0, 0], 3: [2, 1, 3, 0, 0, 0, 0]}
    back = text.decode(text.encode(docs, vocab, "t", "k", 7), vocab, "ids", "t").select("k", "t")
    assert {r.k: r.t for r in back.collect()} == {1: "the cat the cat <UNK>", 2: "", 3: "<UNK>"}


def test_activations(spark):
    v = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    got = v.select(activations.softmax(columns.F.col("v")).alias("s"), activations.layer_norm(columns.F.col("v")).alias("n")).first()
    assert sum(got.s) == pytest.approx(1) and sum(got.n) == pytest.approx(0)


def test_arrow_and_explain(spark):
    table = pa.table({"i": pa.array([1, None], pa.int32()), "s": ["a", None]})
    f = Frame.from_arrow(spark, table, "i")
    assert f.to_arrow().to_pylist() == table.to_pylist() and "Scan" in f.explain()
    with pytest.raises(QuillonError):
        f.to_tensor("i")


def test_models(spark):
    rng = np.random.default_rng(0)
    data = [(float(a), float(b), float(a + b > 0)) for a, b in rng.normal(size=(200, 2))]
    df = ml.dataset(spark.createDataFrame(data, "a double, b double, y double"), ["a", "b"], "y")
    model, score = ml.train_and_evaluate("binary", df, df)
    assert score > 0.98
    weight = ml.feature_importance("binary", model, df.limit(100), ["a", "b"])
    assert weight["a"] > 0 and weight["b"] > 0
    assert ml.sample(np.array([0.0, 50.0, 1.0]), seed=1) == 1


def test_windows_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK", 16)
    values = [None if i % 7 == 0 else (i * 37) % 11 - 5 for i in range(150)]
    f = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k long, v int").repartition(6)
    get = lambda df, c="r": [r[c] for r in df.orderBy("k").collect()]

    def so_far(function):
        return [None if v is None else function([x for x in values[: i + 1] if x is not None]) for i, v in enumerate(values)]

    for name, function in {"sum": sum, "min": min, "max": max}.items():
        assert get(windows.cumulative(f, name, "v", "r", "k")) == so_far(function)
    assert get(windows.cumulative_count(f, "v", "r", "k")) == so_far(len)
    filled = windows.fill(f, "v", "k")
    last = next_ = None
    forward, backward = [], []
    for v in values:
        last = v if v is not None else last
        forward.append(last)
    for v in reversed(values):
        next_ = v if v is not None else next_
        backward.append(next_)
    assert get(filled, "v") == forward
    assert get(windows.fill(f, "v", "k", False), "v") == backward[::-1]
    for size in (1, 5, 40):
        want = [None if i + 1 < size or None in values[i + 1 - size : i + 1] else sum(values[i + 1 - size : i + 1]) for i in range(150)]
        assert get(windows.rolling(f, "sum", "v", "r", size, "k")) == want
    for periods in (-20, -1, 0, 3, 50):
        want = [values[i - periods] if 0 <= i - periods < 150 else 99 for i in range(150)]
        assert get(windows.shift(f, "v", "r", periods, "k", 99)) == want
    assert get(windows.row_number(f, "r", "k")) == list(range(1, 151))
    plan = windows.rolling(f, "sum", "v", "r", 5, "k")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_exact_products(spark, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK", 8)
    f = spark.createDataFrame([(i, 3 if i < 39 else None if i % 2 else -1) for i in range(60)], "k long, v long")
    got = [r.r for r in windows.cumulative(f, "product", "v", "r", "k").orderBy("k").collect()]
    assert got[:39] == [3 ** (i + 1) for i in range(39)]
    assert got[39:43] == [None, -(3**39), None, 3**39]
    both = f.withColumn("p", F.col("k") % 2)
    odd = {r.k: r.r for r in windows.cumulative(both, "product", "v", "r", "k", partition="p").collect()}
    assert odd[37] == 3**19 and odd[40] == -(3**20)
    over = spark.createDataFrame([(i, 10**10) for i in range(3)], "k long, v long")
    with pytest.raises(Exception, match="doesn't fit"):
        windows.cumulative(over, "product", "v", "r", "k").collect()
    zero = spark.createDataFrame([(i, 0 if i == 0 else 10**10) for i in range(30)], "k long, v long")
    assert {r.r for r in windows.cumulative(zero, "product", "v", "r", "k").collect()} == {0}


def test_arg_sort_and_skip(spark):
    f = spark.createDataFrame([(i, None if i % 5 == 0 else i * 7 % 4) for i in range(40)], "k long, v int").repartition(3)
    rows_ = [(i, None if i % 5 == 0 else i * 7 % 4) for i in range(40)]
    for descending in (False, True):
        want = sorted(rows_, key=lambda r: (r[1] is None, (-r[1] if descending else r[1]) if r[1] is not None else 0, r[0]))
        got = sorted((r.place, r.k) for r in rows.arg_sort(f, "v", "k", descending).collect())
        assert got == [(n, k) for n, (k, _) in enumerate(want)]
    assert sorted(r.k for r in rows.skip(f, 35, "k").collect()) == [35, 36, 37, 38, 39]


def test_negative_zero_divisor(spark):
    f = Frame(spark.createDataFrame([(1.0, -0.0), (1.0, 0.0), (-1.0, -0.0)], "x double, y double")).select((col("x") / col("y")).alias("r"))
    assert [r.r for r in f.df.collect()] == [-math.inf, math.inf, math.inf]


def test_figures(spark):
    from quillon.plans import explain

    df = spark.range(100).withColumn("s", F.when(F.col("id") % 4 != 0, F.col("id").cast("string")))
    figures = explain.operator_figures(df.where("id > 9").groupBy("s").count())
    assert any(name.startswith("Filter") and f["numOutputRows"] == 90 for name, f in figures)
    told = {r.name: r for r in explain.column_figures(df).collect()}
    assert (told["s"].nulls, told["id"].nulls, told["id"].type) == (25, 0, "bigint") and 90 <= told["id"].distinct <= 110


def test_tensors_and_batches(spark):
    import decimal

    f = Frame.create(spark, [(1.0, 2.0), (3.0, None)], "a double, b double")
    values, known = f.to_nullable_tensor("a", "b")
    assert values.tolist() == [[1.0, 2.0], [3.0, 0.0]] and known.tolist() == [[True, True], [True, False]] and values.flags["C_CONTIGUOUS"]
    back = Frame.from_batches(spark, [np.ones((2, 2)), np.zeros((1, 2))], ["x", "y"])
    assert [b.tolist() for b in back.batches(2, "x", "y")] == [[[1, 1], [1, 1]], [[0, 0]]]
    d = Frame.create(spark, [(decimal.Decimal("1.50"),)], "d decimal(5,2)")
    assert d.to_tensor("d").tolist() == [[decimal.Decimal("1.50")]]

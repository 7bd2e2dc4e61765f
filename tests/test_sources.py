from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from quillon.errors import SchemaError, SourceError, StreamingError
from quillon.plans.explain import measured, plan_nodes, pushed_filters
from quillon.sources import custom, files
from quillon.streaming import streams


def written(path, content):
    path.write_text(content)
    return str(path)


def test_csv(spark, tmp_path):
    path = written(tmp_path / "a.csv", "Name,Age,Salary\nAlice, 30,75000.5\nBob,x,65000\nCharlie,35,\n")
    df = files.scan_csv(spark, path)
    assert [f.dataType for f in df.schema] == [T.StringType(), T.StringType(), T.DoubleType()]
    strict = files.scan_csv(spark, path, schema="Name string, Age int, Salary double")
    assert [r.Age for r in strict.collect()] == [30, None, 35]
    assert files.scan_csv(spark, written(tmp_path / "b.csv", "A,B\n")).count() == 0
    with pytest.raises(SourceError):
        files.scan_csv(spark, written(tmp_path / "c.csv", ""))
    with pytest.raises(SchemaError):
        files.scan_csv(spark, written(tmp_path / "d.csv", "a,A\n1,2\n"))
    with pytest.raises(SourceError):
        files.scan_csv(spark, str(tmp_path / "none.csv"))


def test_csv_quotes_and_breaks(spark, tmp_path):
    path = written(tmp_path / "q.csv", 'id,note,big\n1,"a ""b"" c",1_000\n\n2,"two\nlines, one cell",2\n3,"",3\n')
    df = files.scan_csv(spark, path)
    assert [f.dataType.simpleString() for f in df.schema] == ["int", "string", "string"]
    assert [(r.id, r.note, r.big) for r in df.orderBy("id").collect()] == [(1, 'a "b" c', "1_000"), (2, "two\nlines, one cell", "2"), (3, None, "3")]
    files.write_csv(df, f"{tmp_path}/out")
    assert sorted(map(str, files.scan_csv(spark, f"{tmp_path}/out").collect())) == sorted(map(str, df.collect()))
    comma = files.scan_csv(spark, written(tmp_path / "k.csv", "a;b\n1,5;x\n-2,25;y\n"), files.CsvOptions(delimiter=";", decimal=","))
    assert [r.a for r in comma.collect()] == [1.5, -2.25]


def test_json_loose(spark, tmp_path):
    text = '[{"A": 1, "s": "x, ] // no comment", /* one */ "n": null,},\n // two\n {"a": 2, "S": "q\\"}", "Ok": true}, ]'
    df = files.scan_json(spark, written(tmp_path / "l.json", text))
    assert df.columns == ["A", "s", "n", "Ok"]
    assert [tuple(r) for r in df.orderBy("A").collect()] == [(1.0, "x, ] // no comment", None, None), (2.0, 'q"}', None, True)]
    many = "\n".join(f'{{"i": {i}, "t": "v{i}",}}' for i in range(300))
    lines = files.scan_json(spark, written(tmp_path / "m.json", many), lines=True)
    assert lines.agg({"i": "sum"}).first()[0] == sum(range(300))
    assert files.scan_json(spark, written(tmp_path / "e.json", "[]")).count() == 0
    assert [tuple(r) for r in files.scan_json(spark, written(tmp_path / "o.json", '{"a": {"b": 1}}')).collect()] == [('{"b":1}',)]
    for i, bad in enumerate(['[{"a": 1}', '[{"a" 1}]', "nonsense"]):
        with pytest.raises(SourceError):
            files.scan_json(spark, written(tmp_path / f"bad{i}.json", bad)).collect()


def test_arrow_options(spark):
    table = pa.table({"u": pa.array([1], pa.uint32())})
    with pytest.raises(SourceError):
        files.from_arrow(spark, table)
    at = spark.sql("select timestamp '2024-01-02 03:04:05Z' as t")
    assert files.to_arrow(at, files.ArrowOptions(time_zone="Asia/Tokyo")).schema.field("t").type.tz == "Asia/Tokyo"


def test_inference_order():
    kinds = {("1", " 2"): "int", ("1", "2.5"): "double", ("true", "False"): "boolean", ("2024-01-02", "2024-01-02T03:04:05"): "timestamp", ("1", "x"): "string", ("", None): "string", ("3000000000",): "double"}
    for values, kind in kinds.items():
        assert files.infer(values).simpleString() == kind


def test_json(spark, tmp_path):
    path = written(tmp_path / "a.json", '[{"Name": "Alice", "Age": 30, "Ok": true, "Deep": {"x": 1}}, {"Name": "Bob", "Salary": 2.5}]')
    df = files.scan_json(spark, path)
    assert {f.name: f.dataType.simpleString() for f in df.schema} == {"Name": "string", "Age": "double", "Ok": "boolean", "Deep": "string", "Salary": "double"}
    assert sorted((r.Name, r.Age, r.Salary) for r in df.collect()) == [("Alice", 30.0, None), ("Bob", None, 2.5)]


def test_parquet(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i % 2] if i % 3 else None) for i in range(100)], "i int, s string")
    files.write_parquet_batch([df, df], f"{tmp_path}/p", compression="zstd")
    back = files.scan_parquet(spark, f"{tmp_path}/p")
    assert back.count() == 200 and back.schema == df.schema
    assert any("GreaterThan(i,50)" in f for f in pushed_filters(back.where("i > 50")))
    assert [len(c) for c in files.parquet_chunks(back, 80)] == [80, 80, 40]
    assert measured(back).rows == 200 and sum(plan_nodes(back).values()) >= 1
    with pytest.raises(SourceError):
        files.scan_parquet(spark, f"{tmp_path}/p", schema=T.StructType([T.StructField("i", T.LongType())]))
    with pytest.raises(SourceError):
        files.scan_parquet(spark, f"{tmp_path}/none")


def test_arrow_columns(spark):
    array = pa.array([1.5, None, 2.5])
    df = files.column_from_arrow(spark, array, "x")
    assert files.column_to_arrow(df, "x").to_pylist() == array.to_pylist()


def test_custom_source(spark):
    custom.register(spark, "counting", "n long", 3, lambda i: iter([pa.RecordBatch.from_pydict({"n": [i, i + 10]})]))
    assert sorted(r.n for r in custom.scan(spark, "counting").collect()) == [0, 1, 2, 10, 11, 12]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(i, i % 3) for i in range(60)], "i long, k long").repartition(3).write.parquet(f"{tmp_path}/in")
    live = streams.read_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    steps = [("filter", lambda d: d.where("k = 1")), ("select", lambda d: d.select("i"))]
    streams.write_stream(streams.run_steps(live, steps), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    assert sorted(r.i for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(1, 60, 3))
    with pytest.raises(StreamingError):
        streams.run_steps(live, [("sort", lambda d: d.orderBy("i"))])
    assert streams.chunk_rows(256 << 20) == 100_000 and streams.chunk_rows(1) == 1_000

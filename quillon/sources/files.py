"""CSV, JSON, Parquet and Arrow: schemas settled from a bounded head, everything else left to Spark's readers and writers."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import SourceError
from quillon.operators.rows import concat_rows
from quillon.types import require_unique


@dataclass(frozen=True)
class CsvOptions:
    """Quotes inside quoted cells are doubled; blank lines are skipped.

    multi_line lets quoted cells hold line breaks, and keeps Spark from splitting a file: turn it off for large files
    without such cells. decimal is the mark before a number's fraction.
    """

    header: bool = True
    delimiter: str = ","
    inference_rows: int = 100
    trim: bool = True
    multi_line: bool = True
    decimal: str = "."


#: What both Python and Spark's CSV reader take for a number.
_INT = re.compile(r"[+-]?[0-9]{1,10}").fullmatch
_DOUBLE = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|NaN|[+-]?Infinity").fullmatch


def _parses(kind: str, text: str) -> bool:
    if kind == "int":
        return _INT(text) is not None and -(1 << 31) <= int(text) < 1 << 31
    if kind == "double":
        return _DOUBLE(text) is not None
    if kind == "boolean":
        return text.lower() in ("true", "false")
    try:
        datetime.fromisoformat(text)
    except ValueError:
        return False
    return len(text) >= 10


def infer(values: Sequence[str | None]) -> T.DataType:
    """int, double, boolean, timestamp or string: the first that all values are."""
    seen = [v.strip() for v in values if v is not None and v.strip()]
    if seen:
        for kind, made in (("int", T.IntegerType()), ("double", T.DoubleType()), ("boolean", T.BooleanType()), ("timestamp", T.TimestampType())):
            if all(_parses(kind, v) for v in seen):
                return made
    return T.StringType()


def _head(spark: SparkSession, path: str, n: int) -> list[str]:
    try:
        return [r.value for r in spark.read.text(path).limit(n).collect()]
    except AnalysisException as e:
        raise SourceError(f"{path} can't be read") from e


def _csv_reader(spark: SparkSession, o: CsvOptions):  # noqa: ANN202
    return spark.read.options(header=o.header, sep=o.delimiter, ignoreLeadingWhiteSpace=o.trim, ignoreTrailingWhiteSpace=o.trim, quote='"', escape='"', multiLine=o.multi_line)


def csv_schema(spark: SparkSession, path: str, options: CsvOptions = CsvOptions()) -> T.StructType:
    """Names of the header (or Column0, Column1 ..) and types of the first inference_rows rows."""
    lines = _head(spark, path, 1)
    if not lines or not lines[0].strip():
        raise SourceError(f"{path} is empty")
    head = _csv_reader(spark, options).option("header", False).csv(path).first()
    names = [("" if v is None else v) for v in head]
    if not options.header:
        names = [f"Column{i}" for i in range(len(names))]
    if any(not n.strip() for n in names):
        raise SourceError(f"{path} has a column without a name")
    require_unique(names)
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = _csv_reader(spark, options).schema(text).csv(path).limit(options.inference_rows).collect()
    return T.StructType([T.StructField(n, infer([r[i] and r[i].replace(options.decimal, ".") for r in rows])) for i, n in enumerate(names)])


def scan_csv(spark: SparkSession, path: str, options: CsvOptions = CsvOptions(), schema: T.StructType | None = None) -> DataFrame:
    """A lazy frame; a cell that doesn't parse is null."""
    schema = schema or csv_schema(spark, path, options)
    schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    reader = _csv_reader(spark, options).option("mode", "PERMISSIVE")
    if options.decimal == ".":
        return reader.schema(schema).csv(path)
    raw = reader.schema(T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.FractionalType) else f.dataType) for f in schema.fields])).csv(path)
    return raw.select(*(F.replace(f"`{f.name}`", F.lit(options.decimal), F.lit(".")).try_cast(f.dataType).alias(f.name) if isinstance(f.dataType, T.FractionalType) else F.col(f"`{f.name}`") for f in schema.fields))


def read_csv(spark: SparkSession, path: str, options: CsvOptions = CsvOptions(), schema: T.StructType | None = None) -> DataFrame:
    """scan_csv, kept once it was read."""
    return scan_csv(spark, path, options, schema).cache()


def write_csv(df: DataFrame, path: str, options: CsvOptions = CsvOptions(), mode: str = "errorifexists") -> None:
    """Line breaks, marks and quotes in cells are kept: quoted, and quotes doubled."""
    df.write.mode(mode).options(header=options.header, sep=options.delimiter, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


_STRING = r'("(?:[^"\\\\]++|\\\\.)*+")'  # a string literal, kept as it is
_COMMENTS, _COMMAS = rf"{_STRING}|//[^\n]*+|/\*[\s\S]*?\*/", rf"{_STRING}|,(?=\s*+[}}\]])"


def _json_records(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """(record): the text of every object, without comments and trailing commas."""
    text = F.regexp_replace(F.regexp_replace("value", _COMMENTS, "$1"), _COMMAS, "$1")
    found = spark.read.text(path, wholetext=not lines).select(F.trim(F.regexp_replace(text, r"^\s+|\s+$", "")).alias("record")).where("record <> ''")
    if lines:
        return found
    array = F.from_json("record", "array<string>", {"mode": "FAILFAST"})
    return found.select(F.explode(F.when(F.col("record").startswith("{"), F.array("record")).otherwise(array)).alias("record"))


def _json_kind(values: Sequence[object]) -> T.DataType:
    seen = [v for v in values if v is not None]
    if seen and all(isinstance(v, bool) for v in seen):
        return T.BooleanType()
    if seen and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in seen):
        return T.DoubleType()
    return T.StringType()


def json_schema(records: Sequence[str]) -> T.StructType:
    """Names as they stand first, in any case; numbers are doubles, and what is no number or boolean is its text."""
    names: dict[str, str] = {}
    values: dict[str, list] = {}
    for text in records:
        for name, value in json.loads(text).items():
            names.setdefault(name.lower(), name)
            values.setdefault(name.lower(), []).append(value)
    return T.StructType([T.StructField(names[k], _json_kind(v)) for k, v in values.items()])


def scan_json(spark: SparkSession, path: str, lines: bool = False, schema: T.StructType | None = None, inference_records: int = 100) -> DataFrame:
    """An array of objects or one object a file; lines: an object a line, which is what splits.

    Names meet in any case; an object that has one twice is an error, and so is text that is no JSON. Comments and
    trailing commas are passed over. Without a schema, the first inference_records objects settle it.
    """
    try:
        records = _json_records(spark, path, lines)
        if schema is None:
            schema = json_schema([r.record for r in records.limit(inference_records).collect()])
    except (PySparkException, Py4JJavaError, ValueError, AttributeError) as e:
        raise SourceError(f"{path} can't be read") from e
    if not schema.fields:
        return spark.createDataFrame([], T.StructType())
    values = records.select(F.transform_keys(F.from_json("record", "map<string,string>", {"mode": "FAILFAST"}), lambda k, _: F.lower(k)).alias("m"))

    def cell(f: T.StructField) -> Column:
        return F.element_at("m", f.name.lower()).try_cast(f.dataType).alias(f.name)

    return values.select(*(cell(f) for f in schema.fields))


def read_json(spark: SparkSession, path: str, **options: object) -> DataFrame:
    return scan_json(spark, path, **options).cache()


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def scan_parquet(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None, merge: bool = False) -> DataFrame:
    """All row groups, with filters and columns pushed down; schema checks the types that are expected."""
    try:
        df = spark.read.option("mergeSchema", merge).parquet(*([path] if isinstance(path, str) else path))
    except AnalysisException as e:
        raise SourceError(f"{path} can't be read") from e
    if schema is not None and [(f.name, f.dataType) for f in schema.fields] != [(f.name, f.dataType) for f in df.schema.fields]:
        raise SourceError(f"{path} has {df.schema.simpleString()}, not {schema.simpleString()}")
    return df


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", row_group_bytes: int = 128 << 20, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    df.write.mode(mode).option("compression", compression).option("parquet.block.size", row_group_bytes).partitionBy(*partition_by).parquet(path)


def write_parquet_batch(frames: Sequence[DataFrame], path: str, **options: object) -> None:
    """Frames of one schema, together."""
    write_parquet(concat_rows(list(frames), fill=False), path, **options)


def parquet_chunks(df: DataFrame, rows: int = 10_000):  # noqa: ANN201
    """Lists of rows, a partition at a time on the driver."""
    chunk = []
    for r in df.toLocalIterator():
        chunk.append(r)
        if len(chunk) == rows:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


@dataclass(frozen=True)
class ArrowOptions:
    """time_zone: what timestamps are told in; validate: whether a type that would change on the way is an error."""

    time_zone: str = "UTC"
    validate: bool = True


def to_arrow(df: DataFrame, options: ArrowOptions = ArrowOptions()) -> pa.Table:
    """All rows on the driver, in Arrow batches; timestamps in the options' zone."""
    table = df.toArrow()
    for i, f in enumerate(table.schema):
        if pa.types.is_timestamp(f.type) and f.type.tz:
            table = table.set_column(i, f.name, table.column(i).cast(pa.timestamp(f.type.unit, options.time_zone)))
    return table


#: Arrow types that Spark has no equal for and would widen or refuse.
_CHANGED = (pa.types.is_unsigned_integer, pa.types.is_float16, pa.types.is_time, pa.types.is_duration)


def from_arrow(spark: SparkSession, table: pa.Table, options: ArrowOptions = ArrowOptions()) -> DataFrame:
    if options.validate:
        for f in table.schema:
            if any(changed(f.type) for changed in _CHANGED):
                raise SourceError(f"{f.name} is {f.type}, which Spark has no equal for")
    return spark.createDataFrame(table)


def column_to_arrow(df: DataFrame, name: str) -> pa.ChunkedArray:
    return df.select(name).toArrow().column(0)


def column_from_arrow(spark: SparkSession, array: pa.Array | pa.ChunkedArray, name: str = "value") -> DataFrame:
    return spark.createDataFrame(pa.table({name: array}))

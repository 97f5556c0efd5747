"""Readers of snapshots, feeds and tables, through Spark only."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimtrail.functions.text import null_or_blank, to_flag, to_history_date, trim_ws
from dimtrail.operators.changes import CURRENT, FROM, TO

SEPARATORS = (",", ";", "\t", "|")
# The fields that a JSON envelope may have its records under.
ENVELOPES = ("data", "records", "items", "results", "customers")


class SourceError(ValueError):
    """An input that can't be read as what it should be."""


def normalised_history(df: DataFrame, check: bool = True) -> DataFrame:
    """Names in lower case, text trimmed, history columns typed. With `check`, dates that fit no format are an error with five of them."""
    out = df.toDF(*[c.strip().lower() for c in df.columns])
    if len(set(out.columns)) < len(out.columns):
        raise SourceError(f"repeated columns in {out.columns}")
    for c in (FROM, TO):
        if c in out.columns and isinstance(out.schema[c].dataType, (T.StringType, T.NullType)) and check:
            bad = [r[0] for r in out.where(~null_or_blank(c) & to_history_date(c).isNull()).select(c).limit(5).collect()]
            if bad:
                raise SourceError(f"{c}: no dates: {bad}")
    make = {FROM: to_history_date(FROM), TO: to_history_date(TO), CURRENT: to_flag(CURRENT)}
    return out.select(*[make[f.name].alias(f.name) if f.name in make else trim_ws(f.name).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in out.schema.fields])


def read_snapshot_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, check: bool = True) -> DataFrame:
    reader = spark.read.option("header", True)
    return normalised_history((reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path), check)


def sniff_separator(spark: SparkSession, path: str, encoding: str = "UTF-8") -> tuple[str, list[str]]:
    """The separator that the first line with text has most of, and its header."""
    first = spark.read.text(path).where("trim(value) != ''").select(F.col("value").cast("binary")).limit(1).collect()  # lines are bytes, whatever their encoding
    if not first:
        raise SourceError("an empty file")
    line = bytes(first[0].value).decode(encoding)
    sep = max(SEPARATORS, key=line.count)
    sep = sep if sep in line else ","
    return sep, [h.strip() for h in next(csv.reader([line], delimiter=sep))]


def is_utf8(spark: SparkSession, path: str) -> bool:
    """Whether all lines of the files are UTF-8; lines are read as bytes, files are split as ever."""
    return spark.read.text(path).agg(F.coalesce(F.bool_and(F.is_valid_utf8("value")), F.lit(True))).first()[0]


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """All columns as text. Files that are not UTF-8 throughout are read as Latin-1. Blank or repeated headers and ragged rows are errors; so is a file of only a header."""
    if encoding.upper() == "UTF-8" and not is_utf8(spark, path):
        encoding = "ISO-8859-1"
    found, header = sniff_separator(spark, path, encoding)
    if any(not h for h in header) or len({h.lower() for h in header}) < len(header):
        raise SourceError(f"blank or repeated headers in {header}")
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
    df = spark.read.options(header=True, sep=sep or found, encoding=encoding, mode="FAILFAST", enforceSchema=False).schema(schema).csv(path)
    if df.isEmpty():
        raise SourceError("no rows under the header")
    return df


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool = False) -> DataFrame:
    """The objects of JSON arrays or of envelopes. lines: a document is a line, else a file, which is read whole; rows are spread after."""
    reader = spark.read.option("multiLine", not lines)
    df = (reader.schema(schema) if schema is not None else reader).json(path)
    under = [c for c in ENVELOPES if c in df.columns and isinstance(df.schema[c].dataType, T.ArrayType) and isinstance(df.schema[c].dataType.elementType, T.StructType)]
    out = df.select(F.inline(under[0])) if under else df
    if not out.columns or out.isEmpty():
        raise SourceError("no records")
    return out


def read_pages(spark: SparkSession, path: str, page: str = "page", records: str = "data", most: int | None = None, page_size: int | None = None, following: str | None = None, lines: bool = False) -> DataFrame:
    """Records of page documents in page order, up to `most` of them. lines: a document is a line, as write_pages stores them, else a file.

    The chain of pages ends with the first page that is empty, has fewer than page_size records, or whose `following` is null; later
    pages are not part of the feed. The end is one minimum over the pages."""
    df = spark.read.option("multiLine", not lines).json(path)
    n = F.coalesce(F.array_size(records), F.lit(0))
    ends = n < (page_size or 1)
    if following is not None:
        ends = ends | (F.col(following).isNull() if following in df.columns else F.lit(True))
    last = df.agg(F.min(F.when(ends, F.col(page)))).first()[0]
    if last is not None:
        df = df.where(F.col(page) <= last)
    rows = df.select(F.col(page).alias("__dt_page"), F.posexplode(records).alias("__dt_pos", "r"))
    if most is not None:
        rows = rows.orderBy("__dt_page", "__dt_pos").limit(most)
    return rows.select("r.*")


def read_table(spark: SparkSession, url: str, table: str, columns: Sequence[str], properties: dict | None = None) -> DataFrame:
    """A database table; Spark pushes columns, filters and limits down."""
    return spark.read.jdbc(url, table, properties=properties or {}).select(*columns)


def check_monitor(registry: DataFrame, monitors: DataFrame) -> DataFrame:
    """(monitor, finding, column) of monitors whose columns aren't as they need: monitors has monitor, source, name, role (key, tracked or time)."""
    both = monitors.join(registry.select("source", F.col("slug").alias("name"), "type", "nullable"), ["source", "name"], "left")
    missing = F.when(F.col("type").isNull(), "missing_column")
    untimed = F.when((F.col("role") == "time") & ~F.col("type").isin("date", "datetime"), "time_not_temporal")
    loose = F.when((F.col("role") == "key") & F.col("nullable"), "nullable_key")
    reserved = F.when(F.col("name").isin(FROM, TO, CURRENT), "reserved_name")
    odd = F.when(~F.col("name").rlike("^[a-z_][a-z0-9_]*$"), "bad_identifier")
    found = both.select("monitor", F.explode(F.array_compact(F.array(missing, untimed, loose, reserved, odd))).alias("finding"), F.col("name").alias("column"))
    twice = monitors.where("role in ('key', 'tracked')").groupBy("monitor", "name").agg(F.count_distinct("role").alias("n")).where("n > 1").select("monitor", F.lit("key_and_tracked").alias("finding"), F.col("name").alias("column"))
    return found.unionByName(twice)


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """Feeds of one entity under each other, missing columns as null."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


__all__ = ["check_monitor", "normalised_history", "read_delimited", "read_json_records", "read_pages", "read_snapshot_csv", "read_table", "sniff_separator", "union_feeds"]

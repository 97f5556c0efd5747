"""Tables of databases through Spark's JDBC catalogs: columns, filters, aggregates, order and limits are the database's work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimtrail.operators import drift, keys
from dimtrail.sources.readers import SourceError

CATALOG = "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog"


def use_database(spark: SparkSession, name: str, url: str, driver: str, limits: bool | None = None, **options: str) -> None:
    """Makes a database known as catalog `name`: its tables are name.schema.table for spark.table and SQL.

    limits: whether LIMIT and ordered LIMIT go to the database. Left out, they do, but for Derby: Spark writes no LIMIT for it and still
    takes its rows for limited ones."""
    pushed = limits if limits is not None else not url.startswith("jdbc:derby:")
    settings = {"url": url, "driver": driver, "pushDownAggregate": "true", "pushDownLimit": str(pushed).lower()} | options
    spark.conf.set(f"spark.sql.catalog.{name}", CATALOG)
    for k, v in settings.items():
        spark.conf.set(f"spark.sql.catalog.{name}.{k}", v)


def table_rows(spark: SparkSession, table: str, columns: Sequence[str], split: str | None = None, pieces: int = 8) -> DataFrame:
    """Columns of a table, read in `pieces` ranges of the number, date or time column `split` at once (in one task without).

    The range comes from one aggregate that the database answers; rows whose split column is null are in the first piece."""
    source = spark.table(table)
    gone = [c for c in columns if c not in source.columns]
    if gone:
        raise SourceError(f"{table} has no {gone}")
    if split is not None and pieces > 1:
        kind = source.schema[split].dataType
        if not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            raise SourceError(f"{table} can't be split by {split}, a {kind.simpleString()}")
        least, most = source.agg(F.min(split).cast("string"), F.max(split).cast("string")).first()
        if least is not None and least != most:
            bounds = {"partitionColumn": split, "lowerBound": least, "upperBound": most, "numPartitions": str(pieces)}
            source = spark.read.options(**bounds).table(table)
    return source.select(*columns)


def table_snapshot(spark: SparkSession, table: str, key: Sequence[str], tracked: Sequence[str], at: str, limit: int | None = None, split: str | None = None, pieces: int = 8) -> DataFrame:
    """Key, tracked and time columns, each once, ordered by time, then keys, nulls last; the first `limit` rows, or all.

    A limit is pushed down with its order where the database takes it. All rows are read in ranges of `split` and sorted by Spark."""
    columns = list(dict.fromkeys([*key, *tracked, at]))
    order = [F.col(c).asc_nulls_last() for c in dict.fromkeys([at, *key])]
    rows = table_rows(spark, table, columns, split if limit is None else None, pieces).orderBy(*order)
    return rows if limit is None else rows.limit(limit)


def rows_after(spark: SparkSession, table: str, key: Sequence[str], tracked: Sequence[str], at: str, cursor: dict | None, limit: int | None = None) -> DataFrame:
    """The snapshot's rows behind a cursor (keys.page_after). That they aren't before its time is the database's to see."""
    rows = table_rows(spark, table, list(dict.fromkeys([*key, *tracked, at])))
    if cursor is not None:
        rows = rows.where(F.col(at) >= F.lit(cursor[at]).cast(rows.schema[at].dataType))
    return keys.page_after(rows, at, key, cursor, limit)


def table_schema(spark: SparkSession, table: str, source: str, version: int) -> DataFrame:
    """The registry rows of a table as the database declares it; no row is read."""
    fields = spark.table(table).schema.fields
    rows = [(source, version, f.name, f.dataType.simpleString(), f.nullable, i) for i, f in enumerate(fields)]
    return drift.registry(spark.createDataFrame(rows, drift.REGISTRY))


def tables_of(spark: SparkSession, catalog: str, schema: str) -> list[str]:
    """Names of the tables of a schema, sorted."""
    return sorted(r.tableName for r in spark.sql(f"SHOW TABLES IN {catalog}.{schema}").collect())

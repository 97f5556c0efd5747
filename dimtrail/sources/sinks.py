"""Versioned history tables, change logs, reports and run logs on any file system that Spark writes to.

A history is a folder of versions; the pointer table names the promoted one. A version is written, checked, and becomes
visible with one appended pointer row, so readers never see half of it and a failed job leaves no trace. Histories that
take small batches are in `keyed`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

POINTER = "version long, batch_id string, cursor string, rows long"
RUN = "run string, status string, version long, rows long, counts map<string,long>, settings map<string,string>"


def _pointer(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(POINTER).parquet(f"{root}/pointer")
    except Exception as e:  # no version yet
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], POINTER)
        raise


def current_version(spark: SparkSession, root: str) -> dict | None:
    """The promoted version's pointer row."""
    row = _pointer(spark, root).where("version is not null").orderBy(F.col("version").desc()).limit(1).collect()
    return row[0].asDict() if row else None


def committed_batch(spark: SparkSession, root: str, batch_id: str) -> bool:
    """Whether a batch has been promoted."""
    return not _pointer(spark, root).where(F.col("batch_id") == batch_id).isEmpty()


def stage_version(df: DataFrame, root: str) -> tuple[int, DataFrame, int]:
    """Writes the next version, unpromoted; its number, the rows read back, and how many the write saw."""
    spark, seen = df.sparkSession, Observation()
    last = current_version(spark, root)
    version = (last["version"] if last else 0) + 1
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/v={version}")
    return version, spark.read.schema(df.schema).parquet(f"{root}/v={version}"), seen.get["rows"]


def promote(spark: SparkSession, root: str, version: int, batch_id: str, rows: int, cursor: str | None = None) -> None:
    """Makes a version the current one; rows: how many it wrote."""
    spark.createDataFrame([(version, batch_id, cursor, rows)], POINTER).coalesce(1).write.mode("append").parquet(f"{root}/pointer")


def read_history(spark: SparkSession, root: str, schema=None) -> DataFrame | None:
    """The promoted version, or None."""
    last = current_version(spark, root)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{root}/v={last['version']}") if last else None


def write_pages(pages: DataFrame, path: str) -> None:
    """Page documents, one a line: there are as many files as partitions, however many pages."""
    pages.write.mode("overwrite").json(path)


def write_change_log(changes: DataFrame, path: str) -> None:
    changes.write.mode("overwrite").json(path, ignoreNullFields=False)


def read_change_log(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A validation report as it was written."""
    return spark.read.schema("rule string, status string, issues long, message string").json(path)


def write_run(spark: SparkSession, root: str, run: str, status: str, version: int | None, rows: int | None, counts: dict, settings: dict) -> None:
    """What a run did: one row in a folder of its own. counts: by change type; settings: what it was asked for."""
    told = [(run, status, version, rows, {k: int(v) for k, v in counts.items()}, {k: str(v) for k, v in settings.items()})]
    put_rows(spark.createDataFrame(told, RUN).withColumn("time", F.current_timestamp()).coalesce(1), f"{root}/runs", run)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """All runs that write_run has told of."""
    return spark.read.schema(f"{RUN}, time timestamp").parquet(f"{root}/runs")


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def put_rows(df: DataFrame, path: str, name: str) -> None:
    """Rows of one batch in a folder of their own, so that a repeated batch writes them once."""
    df.write.mode("overwrite").parquet(f"{path}/of={name}")


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """All batches' rows that put_rows wrote."""
    return spark.read.parquet(path).drop("of")

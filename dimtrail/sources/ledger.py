"""A commit log beside some tables: what they consist of, and what has happened to them.

Every commit is one row in a folder of its own, `at=N`. It carries the whole state as JSON (folder names, the cursor, open holds) and
the events of this commit, so that tables that belong together move together or not at all. Two writers can't both write
the same `at`: the second one finds it taken. Old rows are folded: their events go to the `events` folder, the rows go."""

from __future__ import annotations

import datetime
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "kind string, id string, status string, time string, detail string"
ROW = f"state string, events array<struct<{EVENT.replace(' string', ':string')}>>"


class ConflictError(RuntimeError):
    """Another writer has committed since the state was read."""


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder on whatever file system it is, if it is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def missing(e: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e)


def event(kind: str, id: str, status: str, **detail) -> tuple:
    return kind, id, status, datetime.datetime.now(datetime.UTC).isoformat(timespec="microseconds"), json.dumps(detail, sort_keys=True, default=str)


class Ledger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path, self.folded = spark, f"{root}/log", f"{root}/events"

    def _rows(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], f"{ROW}, at long")
        try:
            return self.spark.read.schema(f"{ROW}, at long").parquet(self.path)
        except Exception as e:
            if missing(e):
                return self.spark.createDataFrame([], f"{ROW}, at long")
            raise

    def latest(self) -> tuple[int, dict]:
        """Number and state of the last commit; (0, {}) before the first."""
        row = self._rows().orderBy(F.col("at").desc()).limit(1).collect()
        return (row[0]["at"], json.loads(row[0]["state"])) if row else (0, {})

    def commit(self, after: int, state: dict, events: Sequence[tuple] = ()) -> int:
        """Appends a state that was made from commit `after`; an error if that isn't the last any more."""
        at = after + 1
        row = self.spark.createDataFrame([(json.dumps(state, sort_keys=True, default=str), list(events))], ROW).coalesce(1)
        try:
            row.write.mode("errorifexists").parquet(f"{self.path}/at={at}")
        except Exception as e:
            if "PATH_ALREADY_EXISTS" not in str(e):
                raise
            if self.latest()[0] >= at:
                raise ConflictError(f"commit {at} is taken") from e
            row.write.mode("overwrite").parquet(f"{self.path}/at={at}")  # left by a writer that died before its row was there
        return at

    def events(self) -> DataFrame:
        """at, kind, id, status, time, detail of all events, once each, folded or not."""
        rows = self._rows().select("at", F.inline("events"))
        try:
            rows = rows.unionByName(self.spark.read.schema(f"at long, {EVENT}").parquet(self.folded).select(rows.columns))
        except Exception as e:
            if not missing(e):
                raise
        return rows.distinct()

    def fold(self, keep: int) -> None:
        """Moves the events of all rows but the last `keep` into the events folder. A fold that is cut short and done again leaves every event once."""
        last = self._rows().agg(F.max("at"), F.min("at")).first()
        if last[0] is None or last[0] - last[1] < keep:
            return
        old = self._rows().where(F.col("at") <= last[0] - keep)
        old.select("at", F.inline("events")).coalesce(1).write.mode("append").parquet(self.folded)
        for at in range(last[1], last[0] - keep + 1):
            delete(self.spark, f"{self.path}/at={at}")

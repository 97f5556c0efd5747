"""Run logs: states, counts, health, failure categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tasks, error types and words that tell failures apart.
INGEST_TASKS, SCHEMA_TASKS = ("ingest_csvs", "ingest_task"), ("detect_schema", "schema_task")
PERSIST_TASKS, EXPLAIN_TASKS = ("persist_artifacts", "persist_task", "write_run_artifacts"), ("explain_changes", "explain_task")
HISTORY_ERRORS, FILE_ERRORS = ("DuplicateBusinessKeyError", "InvalidTemporalValueError"), ("FileNotFoundError", "IsADirectoryError", "PermissionError")
PERMANENT_CODES, PERMANENT_STATES = (400, 401, 403, 404), ("UNAUTHENTICATED", "PERMISSION_DENIED", "NOT_FOUND")
PERMANENT_WORDS = "unauthenticated|permission_denied|api key not valid|invalid api key|not found|perday|daily|quota exceeded.*day|day.*quota exceeded|invalid_argument"
TRANSIENT_CODES, TRANSIENT_STATES = (429, 500, 502, 503, 504), ("RESOURCE_EXHAUSTED", "INTERNAL", "UNAVAILABLE", "DEADLINE_EXCEEDED")
TRANSIENT_WORDS = "timeout|timed out|connection reset|temporarily unavailable|deadline exceeded|rate limit|resource exhausted"
LOST_CONNECTION = ("TimeoutError", "ConnectionError", "ConnectionResetError", "ConnectionRefusedError", "ConnectionAbortedError", "BrokenPipeError")


def latest_states(events: DataFrame, id_column: str, at: str, columns: list[str]) -> DataFrame:
    """The last event of each id."""
    return events.groupBy(id_column).agg(F.max_by(F.struct(*columns), F.struct(at, "status")).alias("v"), F.min(at).alias("started"), F.max(at).alias("updated")).select(id_column, "v.*", "started", "updated")


def run_counts(runs: DataFrame) -> DataFrame:
    """Runs and their sums by status, and in total with status ALL."""
    sums = [F.count("*").alias("runs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("seen", "changed", "held")]]
    return runs.rollup("status").agg(*sums).withColumn("status", F.coalesce("status", F.lit("ALL")))


def ops_metrics(runs: DataFrame, holds: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """One row: totals, active holds, last run and checkpoint, and health: critical after a failed run, degraded with holds, else nominal."""
    total = runs.agg(F.count("*").alias("runs"), F.coalesce(F.sum("seen"), F.lit(0)).alias("seen"), F.coalesce(F.sum("changed"), F.lit(0)).alias("changed"), F.max_by("run_id", F.struct("started", "run_id")).alias("last_run"), F.max_by("status", F.struct("started", "run_id")).alias("last_status"))
    active = holds.agg(F.count_if(F.col("status") == "HELD").alias("active_holds"))
    mark = checkpoints.agg(F.max("updated").alias("last_checkpoint"))
    health = F.when(F.col("last_status") == "FAILED", "critical").when(F.col("active_holds") > 0, "degraded").otherwise("nominal")
    return total.crossJoin(active).crossJoin(mark).withColumn("health", health)


def idempotency_conflicts(requests: DataFrame, name: str = "idempotency_key", request: str = "fingerprint") -> DataFrame:
    """(idempotency_key, requests): keys that stand for more than one request."""
    return requests.where(F.col(name).isNotNull()).groupBy(name).agg(F.count_distinct(request).alias("requests")).where("requests > 1")


def find_runs(runs: DataFrame, fingerprint: str, column: str = "fingerprint") -> DataFrame:
    return runs.where(F.col(column) == fingerprint)


def without_run(rows: DataFrame, run: str, column: str = "run_id") -> DataFrame:
    """A log or its details without one run."""
    return rows.where(~F.col(column).eqNullSafe(F.lit(run)))


def failure_category(message: Column, kind: Column, task: Column | None = None, code: Column | None = None, state: Column | None = None) -> Column:
    """What a failure is, by the task it came from, its error type, its message, and the code and state of a called service; the first that fits."""
    said, task = F.lower(F.coalesce(message, F.lit(""))), F.coalesce(F.lit("") if task is None else task, F.lit(""))
    code, state = F.coalesce(F.lit(0) if code is None else code, F.lit(0)), F.coalesce(F.lit("") if state is None else state, F.lit(""))
    is_value = kind == "ValueError"
    permanent = code.isin(*PERMANENT_CODES) | state.isin(*PERMANENT_STATES) | said.rlike(f"(?s){PERMANENT_WORDS}")
    transient = kind.isin(*LOST_CONNECTION) | said.rlike(TRANSIENT_WORDS) | code.isin(*TRANSIENT_CODES) | state.isin(*TRANSIENT_STATES)
    explains = task.isin(*EXPLAIN_TASKS) | said.rlike("ai|gemini|groq")
    return (
        F.when(kind.isin(*HISTORY_ERRORS), "deterministic_scd2_error")
        .when(task.isin(*INGEST_TASKS) & (kind.isin(*FILE_ERRORS) | is_value | said.contains("csv")), "deterministic_input_error")
        .when(task.isin(*SCHEMA_TASKS) & (is_value | said.rlike("key|column")), "deterministic_schema_error")
        .when(task.isin(*PERSIST_TASKS) | said.rlike("persistence|artifact"), "persistence_error")
        .when(explains & permanent, "permanent_ai_error")
        .when(explains & transient, "transient_ai_error")
        .when(explains, "unexpected_internal_error")
        .when(said.contains("duplicate") & said.contains("key"), "deterministic_scd2_error")
        .otherwise("unexpected_internal_error")
    )

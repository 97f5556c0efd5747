"""Queries of what is stored beside the rows: appended parts, runs and their reports, statistics and evidence of a stream's batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimtrail.operators.history import HistoryError
from dimtrail.plans.appended import AppendedHistory
from dimtrail.plans.pipeline import run_pipeline
from dimtrail.queries.files import BEGUN, _streamed, scratch
from dimtrail.queries.fixtures import DATE, KEY, TRACKED, X1, X1C, table, x1_source, x1_target, x1c
from dimtrail.sources import sinks
from dimtrail.streaming.landing import Landing
from dimtrail.streaming.stream import read_stream

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _appended(spark: SparkSession, d: str) -> AppendedHistory:
    """The sound history of customers in five parts by key, merged by three; one part comes twice, and one of faulty rows is refused."""
    store = AppendedHistory(spark, scratch(spark), KEY, fan_in=3)
    rows = x1_target(spark, d)
    for k in range(5):
        store.append(rows.where(F.col("custkey") % 5 == k), f"part {k}")
    if store.append(rows, "part 2") != "SEEN":
        raise AssertionError("a part was appended twice")
    try:
        store.append(x1c(spark, d).select(rows.columns), "faulty")
    except HistoryError:
        return store
    raise AssertionError("faulty rows were appended")


@query(f"WITH {X1} SELECT custkey, segment, nation, cents, effective_from, effective_to, is_current FROM target")
def appended_history(spark: SparkSession, d: str) -> DataFrame:
    return _appended(spark, d).read()


_FAULTS = "count(*) FILTER (custkey IS NULL) AS null_keys, count(*) FILTER (effective_from >= effective_to) AS reversed, count(*) FILTER (is_current AND effective_to IS NOT NULL) AS active_with_end, count(*) FILTER (NOT is_current AND effective_to IS NULL) AS closed_without_end"


@query(f"""WITH {X1C}, told AS (SELECT 'part ' || (custkey % 5) AS name, 'APPENDED' AS status, * FROM target UNION ALL SELECT 'faulty', 'REFUSED', custkey, segment, nation, cents, effective_from, effective_to, is_current FROM bad)
SELECT name, status, count(*) AS rows, {_FAULTS}, min(effective_from) AS first, max(coalesce(effective_to, effective_from)) AS last FROM told GROUP BY name, status""")
def appended_parts(spark: SparkSession, d: str) -> DataFrame:
    """The log of attempts: what was counted while each part was written."""
    log = _appended(spark, d).log()
    return log.select("name", "status", "rows", "null_keys", "reversed", "active_with_end", "closed_without_end", F.col("first").cast("date").alias("first"), F.col("last").cast("date").alias("last"))


@query(f"""WITH {X1}, n AS (SELECT count(*) FILTER (change_type = 'NEW') AS new, count(*) FILTER (change_type = 'CHANGED') AS changed, count(*) FILTER (change_type = 'DELETED') AS deleted, count(*) FILTER (change_type = 'UNCHANGED') AS unchanged FROM classed),
h AS (SELECT (SELECT count(*) FROM target) + new + changed AS rows, * FROM n)
SELECT 'promoted' AS status, CAST(1 AS BIGINT) AS version, rows, new, changed, deleted, unchanged, 'full' AS mode FROM h UNION ALL SELECT 'promoted', 2, (SELECT count(*) FROM target), 0, 0, 0, (SELECT count(*) FROM cur), 'full' FROM h""")
def pipeline_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two runs and what they say of themselves: a snapshot with changes, and one that is what the history has. A run that is asked for again is reused and adds nothing."""
    at = scratch(spark)
    same = x1_target(spark, d).where("is_current").select(*KEY, *TRACKED)
    for source in (x1_source(spark, d), same, same):
        run_pipeline(source, x1_target(spark, d), at, DATE, KEY, TRACKED)
    counts = [F.col("counts")[f"{c}_rows"].alias(c) for c in ("new", "changed", "deleted", "unchanged")]
    return sinks.read_runs(spark, at).select("status", "version", "rows", *counts, F.col("settings.mode").alias("mode"))


@query("SELECT unnest(['schema_completeness', 'one_current_per_key', 'no_null_keys', 'no_blank_keys', 'no_overlapping_dates', 'date_consistency']) AS rule, 'pass' AS status, CAST(0 AS BIGINT) AS issues FROM (SELECT count(*) AS n FROM customer) WHERE n > 0")
def stored_report(spark: SparkSession, d: str) -> DataFrame:
    """The validation report of a promoted version, read back."""
    at = scratch(spark)
    done = run_pipeline(x1_source(spark, d), x1_target(spark, d), at, DATE, KEY, TRACKED)
    return sinks.read_report(spark, f"{at}/validation/{done.fingerprint}").select("rule", "status", "issues")


@query("""WITH b AS (SELECT (day(ts) - 1) // 10 AS k, * FROM events), s AS (SELECT CAST(least(k, 2) AS BIGINT) AS batch, count(*) AS rows, count(*) FILTER (event_id % 50 = 0) AS null_keys, count(*) FILTER (event_type = 'error') AS blanks, CAST(min(ts) AS TIMESTAMP) AS first, CAST(max(ts) AS TIMESTAMP) AS last FROM b GROUP BY 1)
SELECT *, rows / greatest((epoch_us(last) - epoch_us(first)) / 1e6, 1.0) AS per_second, avg(rows) OVER (ORDER BY batch ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS usual, coalesce(first < max(last) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS overlapping FROM s""")
def landed_statistics(spark: SparkSession, d: str) -> DataFrame:
    """A stream of three batches, counted while it is stored."""
    at = scratch(spark)
    k = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2))
    key = F.when(F.col("event_id") % 50 != 0, F.col("user_id"))
    kind = F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type"))
    rows = table(spark, d, "events").select(key.alias("user_id"), kind.alias("event_type"), F.col("ts").cast("timestamp").alias("ts"), k.alias("k"))
    landing = Landing(f"{at}/landed", ["user_id"], ["event_type"], "ts")
    for part in range(3):
        rows.where(F.col("k") == part).drop("k").write.mode("append").parquet(f"{at}/in")
        landing.start(read_stream(spark, f"{at}/in", rows.drop("k").schema, None), f"{at}/checkpoint").awaitTermination()
    micros = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("first", "last")]
    return landing.statistics(spark).select("batch", "rows", "null_keys", F.col("blanks")[0].n.alias("blanks"), *micros, "per_second", "usual", "overlapping")


@query(f"""WITH {BEGUN.format(where='')}, b AS (SELECT part, user_id, n > 1 AS again FROM begun JOIN (SELECT part, user_id, n FROM told) USING (part, user_id)),
seen AS (SELECT part, count(*) AS evaluated FROM latest GROUP BY part)
SELECT CAST(part AS VARCHAR) AS batch, evaluated, count(*) FILTER (again) AS changed, count(*) FILTER (NOT again) AS new FROM seen LEFT JOIN b USING (part) GROUP BY part, evaluated""")
def stream_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The evidence that a history's stream keeps of its batches."""
    found = sinks.read_rows(spark, f"{_streamed(spark, d, late=False).root}/evidence")
    return found.select("batch", "evaluated", "changed", "new")

"""Queries of explanations and what contradicts them, of replacements for columns that are gone, and of stored drift reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimtrail.operators import drift, guardrail, narrative
from dimtrail.plans.drift_reports import DriftReports
from dimtrail.queries import judging
from dimtrail.queries.files import scratch
from dimtrail.queries.fixtures import X3, x3_changes
from dimtrail.queries.judging import DRIFT, MAPPING, RULES, _evidence, _impact, _registries

QUERIES, ORACLES = {}, {}
RULE_NAMES = ("HIGH_CHANGE_VELOCITY", "HIGH_CHANGE_VOLUME", "HIGH_POPULATION_IMPACT", "LARGE_QUANTITY_SWING", "MASS_DEACTIVATION", "SCD2_VALIDATION_FAILURE", "WIDE_GEOGRAPHIC_IMPACT")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


TOLD = f"""{X3}, names AS (SELECT day, string_agg(c || ': ' || n, ', ' ORDER BY c) AS by_column FROM (SELECT day, c, count(*) AS n FROM (
    SELECT day, 'event_type' AS c FROM changed WHERE n > 1 AND event_type <> old_type UNION ALL SELECT day, 'cents' FROM changed WHERE n > 1 AND cents <> old_cents) GROUP BY day, c) GROUP BY day),
facts AS (SELECT j.*, us, by_column, len(rules) > 0 AS held, array_to_string(rules, ', ') AS named, CASE WHEN len(rules) >= 2 THEN 'HIGH' WHEN len(rules) = 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
    CAST(CAST(round_even(round_even(mutated / CAST(j.evaluated AS DOUBLE), 4) * 100, 1) AS DECIMAL(38, 1)) AS VARCHAR) || '%' AS share, row_number() OVER (ORDER BY j.day) AS k
  FROM judged j JOIN counts c ON c.day = j.day LEFT JOIN names n ON n.day = j.day),
told AS (SELECT day, k, held, rules, severity, CASE WHEN held THEN 'SUSPICIOUS' ELSE 'NORMAL' END AS decision,
  'Batch ' || day || ' of events is ' || CASE WHEN held THEN 'held at severity ' || severity || ' because of ' || named || '.' ELSE 'committed.' END AS summary,
  evaluated || ' rows: ' || changed || ' changed, ' || new_rows || ' new, ' || (evaluated - changed - new_rows) || ' as before; ' || share || ' moved, over ' || dispersion || ' keys.' AS what_changed,
  CASE WHEN held THEN 'Triggered: ' || named || '.' ELSE 'Everything is within its limits.' END AS why_flagged,
  list_filter(['evaluated: ' || evaluated, 'share moved: ' || share, CASE WHEN max_absolute > 0 THEN 'largest relative change: ' || CAST(CAST(round_even(round_even(max_relative, 4) * 100, 1) AS DECIMAL(38, 1)) AS VARCHAR) || '%' END,
    'by column: ' || by_column, CASE WHEN us > 0 THEN 'window: ' || (us // 1000000) || ' s' END], lambda x: x IS NOT NULL) AS points FROM facts)"""


def _explained(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Days as decided batches, and their explanations."""
    decided = guardrail.decide(_evidence(spark, d))
    diffs = x3_changes(spark, d).where(F.size("field_changes") > 0).select("day", F.inline("field_changes"))
    return decided, narrative.batch_explanations(decided, "day", "events", guardrail.per_column_changes(diffs, "day"))


@query(f"""WITH {TOLD} SELECT day, summary, what_changed, why_flagged, array_to_string(points, '; ') AS points, 'All invariants of the history hold.' AS validation,
CASE WHEN held THEN 'Its rows are kept frozen; history and cursor are as they were.' ELSE 'Its rows are in the history; the cursor is at its last time.' END AS containment, decision, severity FROM told""")
def batch_explanations(spark: SparkSession, d: str) -> DataFrame:
    return _explained(spark, d)[1].withColumn("points", F.array_join("points", "; "))


@query(f"""WITH {TOLD}, n AS (SELECT *, CAST(extract(day FROM day) AS BIGINT) % 6 AS r FROM told)
SELECT day, 'DECISION_IMMUTABILITY' AS violation, CASE WHEN held THEN 'NORMAL' ELSE 'SUSPICIOUS' END AS claimed, decision AS expected FROM n WHERE r = 0
UNION ALL SELECT day, 'SEVERITY_IMMUTABILITY', 'CRITICAL', severity FROM n WHERE r = 1
UNION ALL SELECT day, 'UNTRIGGERED_RULE_CLAIMED', 'MASS_DEACTIVATION', array_to_string(list_sort(rules), ',') FROM n WHERE r = 2
UNION ALL SELECT day, 'CONTRADICTED_VALIDATION_STATUS', 'failed', 'passed' FROM n WHERE r = 3
UNION ALL SELECT day, 'CONTRADICTED_CONTAINMENT_STATUS', 'committed', 'held' FROM n WHERE r = 4 AND held""")
def grounding_violations(spark: SparkSession, d: str) -> DataFrame:
    """Explanations altered by day of the month: five kinds of contradiction, and sound ones between them."""
    decided, told = _explained(spark, d)
    r = F.dayofmonth("day") % 6
    told = told.withColumn("decision", F.when(r != 0, F.col("decision")).when(F.col("decision") == "NORMAL", "SUSPICIOUS").otherwise("NORMAL"))
    told = told.withColumn("severity", F.when(r == 1, "CRITICAL").otherwise(F.col("severity")))
    told = told.withColumn("points", F.when(r == 2, F.array_append("points", F.lit("Mass_deactivation limits were exceeded"))).otherwise(F.col("points")))
    told = told.withColumn("validation", F.when(r == 3, "The validation failed.").otherwise(F.col("validation")))
    told = told.withColumn("containment", F.when(r == 4, "The batch was Committed to history.").otherwise(F.col("containment")))
    return narrative.grounding_violations(told, decided, "day", RULE_NAMES)


@query(f"WITH {X3} SELECT day, 'event_type' AS \"column\", transitions AS n FROM words")
def transitions_by_column(spark: SparkSession, d: str) -> DataFrame:
    diffs = x3_changes(spark, d).where(F.size("field_changes") > 0).select("day", F.inline("field_changes"))
    return guardrail.column_transitions(diffs, "day")


@query(f"""SELECT i.source, i.slug, target, impact, added AS replacement, score AS confidence FROM ({judging.ORACLES["mapping_impact"]}) i LEFT JOIN ({judging.ORACLES["possible_renames"]}) r ON r.source = i.source AND r.removed = i.slug""")
def mapping_replacements(spark: SparkSession, d: str) -> DataFrame:
    """What drift does to mapped columns, and what may stand in for those that are gone."""
    events = _impact(spark, d)[0]
    return drift.mapping_impact(events, _mapping(spark), drift.possible_renames(events))


def _mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("crm", m.sources[0], m.target, RULES[m.target].type, RULES[m.target].required) for m in MAPPING], "source string, slug string, target string, wanted string, required boolean")


@query(f"""WITH {DRIFT} SELECT 'crm' AS source, CAST(1 AS INTEGER) AS prior_version, CAST(2 AS INTEGER) AS current_version, CASE rank WHEN 2 THEN 'BROKEN' WHEN 1 THEN 'REVIEW' ELSE 'COMPATIBLE' END AS overall, rank > 0 AS needs_review,
x1 || ' added, ' || x2 || ' removed, ' || x3 || ' type_changed, ' || x4 || ' nullability_changed' AS summary, CAST(2 AS BIGINT) AS total FROM worst, counts
UNION ALL SELECT 'crm', 2, 3, 'COMPATIBLE', FALSE, '0 added, 0 removed, 0 type_changed, 0 nullability_changed', 2 FROM worst""")
def drift_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports of three versions, stored and listed; the first comparison is made twice and stored once, the gate is shut after it and open after the second."""
    store = DriftReports(spark, scratch(spark))
    first, second = _registries(spark, d)
    same = store.add(first, second, _mapping(spark), "m1")
    if store.add(first, second, _mapping(spark), "m1") != same:
        raise AssertionError("one comparison made two reports")
    try:
        store.require_unbroken("crm", "m1")
    except ValueError:
        store.add(second, second.withColumn("version", F.lit(3)), _mapping(spark), "m1")
        store.require_unbroken("crm", "m1")
        return store.page(10, source="crm", mapping="m1").select("source", "prior_version", "current_version", "overall", "needs_review", "summary", "total")
    raise AssertionError("a broken mapping passed the gate")

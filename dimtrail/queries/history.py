"""Queries of change detection, history, point in time, invariants and contracts."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimtrail.operators import changes, contracts, history, invariants, keys
from dimtrail.operators.narrative import change_narratives
from dimtrail.queries.fixtures import DATE, KEY, TRACKED, X1, X1C, X2, table, x1_source, x1_target, x1b_source, x1c, x2_history

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _classified(spark: SparkSession, d: str, source=x1_source, mode="full", policy="soft_delete") -> DataFrame:
    return changes.classify_changes(source(spark, d), x1_target(spark, d), KEY, TRACKED, mode, policy)


CLASSIFIED = f"WITH {X1} SELECT custkey, change_type FROM classed"


@query(CLASSIFIED)
def change_classify(spark, d):
    return _classified(spark, d).select("custkey", "change_type")


@query(CLASSIFIED)
def change_classify_blanks(spark, d):
    return _classified(spark, d, x1b_source).select("custkey", "change_type")


@query(f"WITH {X1} SELECT custkey, change_type FROM classed WHERE change_type <> 'DELETED'")
def change_classify_incremental(spark, d):
    return _classified(spark, d, mode="incremental").select("custkey", "change_type")


@query(f"WITH {X1} SELECT count(*) FILTER (WHERE change_type = 'NEW') AS new_rows, count(*) FILTER (WHERE change_type = 'CHANGED') AS changed_rows, count(*) FILTER (WHERE change_type = 'UNCHANGED') AS unchanged_rows, count(*) FILTER (WHERE change_type = 'DELETED') AS deleted_rows, count(*) AS total_rows FROM classed")
def change_summary(spark, d):
    return changes.change_summary(_classified(spark, d))


@query(f"WITH {X1} SELECT custkey, 'segment' AS \"column\", old_segment AS old_value, new_segment AS new_value FROM classed WHERE change_type = 'CHANGED'")
def field_changes(spark, d):
    return changes.field_changes(_classified(spark, d), KEY)


@query(f"WITH {X1} SELECT custkey, CASE change_type WHEN 'NEW' THEN 'Record custkey=' || custkey || ' is new.' WHEN 'DELETED' THEN 'Record custkey=' || custkey || ' is gone from the source.' ELSE 'Record custkey=' || custkey || ' changed: segment from ''' || old_segment || ''' to ''' || new_segment || '''.' END AS narrative FROM classed WHERE change_type <> 'UNCHANGED'")
def change_narrative(spark, d):
    return change_narratives(_classified(spark, d), KEY)


def _history_sql(closed: str, fresh: str = "'NEW', 'CHANGED'") -> str:
    return f"""WITH {X1}
SELECT custkey, segment, nation, cents, effective_from, effective_to, is_current FROM target WHERE NOT is_current
UNION ALL SELECT t.custkey, t.segment, t.nation, t.cents, t.effective_from, CASE WHEN c.change_type IN ({closed}) THEN DATE '1996-01-01' END, c.change_type NOT IN ({closed}) FROM cur t JOIN classed c USING (custkey)
UNION ALL SELECT s.custkey, s.segment, s.nation, s.cents, DATE '1996-01-01', CAST(NULL AS DATE), TRUE FROM source s JOIN classed c USING (custkey) WHERE c.change_type IN ({fresh})"""


def _applied(spark, d, mode, policy) -> DataFrame:
    return history.apply_history(x1_source(spark, d), x1_target(spark, d), KEY, TRACKED, DATE, mode, policy)


@query(_history_sql("'CHANGED', 'DELETED'"))
def history_full_soft(spark, d):
    return _applied(spark, d, "full", "soft_delete")


@query(_history_sql("'CHANGED'"))
def history_full_ignore(spark, d):
    return _applied(spark, d, "full", "ignore")


@query(_history_sql("'CHANGED'"))
def history_incremental(spark, d):
    return _applied(spark, d, "incremental", "soft_delete")


@query(f"WITH {X1} SELECT custkey, segment, nation, cents, DATE '1996-01-01' AS effective_from, CAST(NULL AS DATE) AS effective_to, TRUE AS is_current FROM source")
def initial_load(spark, d):
    return history.apply_history(x1_source(spark, d), x1_target(spark, d).where("false"), KEY, TRACKED, DATE)


@query(f"WITH {X1} SELECT custkey, segment, nation, cents, effective_from, CASE WHEN is_current THEN DATE '1996-01-01' ELSE effective_to END AS effective_to, FALSE AS is_current FROM target")
def empty_source(spark, d):
    return history.apply_history(x1_source(spark, d).where("false"), x1_target(spark, d), KEY, TRACKED, DATE)


@query(f"WITH {X1} SELECT custkey, change_type, change_type IN ('NEW', 'CHANGED') AS inserts, change_type IN ('CHANGED', 'DELETED') AS closes FROM classed WHERE change_type <> 'UNCHANGED'")
def history_delta(spark, d):
    return history.history_delta(_classified(spark, d))


@query(f"WITH {X1} SELECT custkey, segment, nation, cents, effective_from, CASE WHEN is_current AND custkey % 20 = 11 THEN DATE '1996-01-01' ELSE effective_to END AS effective_to, is_current AND custkey % 20 <> 11 AS is_current FROM target")
def close_versions(spark, d):
    return history.close_versions(x1_target(spark, d), x1_source(spark, d).where("custkey % 20 = 11"), KEY, DATE)


@query(f"WITH {X1} SELECT custkey, segment FROM cur")
def current_rows(spark, d):
    return changes.current_rows(x1_target(spark, d)).select("custkey", "segment")


@query(f"WITH {X1} SELECT custkey, count(*) AS versions, count(*) FILTER (WHERE is_current) AS active, count(*) FILTER (WHERE NOT is_current) AS historical FROM target GROUP BY custkey")
def version_counts(spark, d):
    return history.version_counts(x1_target(spark, d), KEY)


@query(f"WITH {X1} SELECT custkey, segment, effective_from, effective_to FROM target WHERE NOT is_current")
def version_view(spark, d):
    return history.view_versions(x1_target(spark, d), "historical", ["custkey", "effective_from"]).select("custkey", "segment", "effective_from", "effective_to")


@query(f"WITH {X2} SELECT custkey, priority, effective_from FROM history WHERE effective_from <= DATE '1997-01-01' AND (effective_to IS NULL OR effective_to > DATE '1997-01-01')")
def point_in_time_table(spark, d):
    return history.as_of(x2_history(spark, d), datetime.date(1997, 1, 1)).select("custkey", "priority", "effective_from")


@query(f"WITH {X2} SELECT l_orderkey AS orderkey, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS partkey, o_custkey AS custkey, h.priority, h.effective_from FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN history h ON h.custkey = o_custkey AND h.effective_from <= l_shipdate AND (h.effective_to IS NULL OR l_shipdate < h.effective_to)")
def point_in_time_join(spark, d):
    points = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").cast("bigint").alias("line"), F.col("l_partkey").alias("partkey"), F.col("o_custkey").alias("custkey"), F.col("l_shipdate").alias("shipped"))
    return history.as_of_join(points, x2_history(spark, d), ["custkey"], "shipped").select("orderkey", "line", "partkey", "custkey", "priority", "effective_from")


@query(f"""WITH {X2}, points AS (SELECT l_orderkey AS orderkey, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS partkey, CASE WHEN l_orderkey % 10 = 0 THEN o_custkey ELSE (SELECT min(o_custkey) FROM orders) END AS custkey, l_shipdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT orderkey, line, partkey, p.custkey, h.priority, h.effective_from FROM points p LEFT JOIN history h ON h.custkey = p.custkey AND h.effective_from <= l_shipdate AND (h.effective_to IS NULL OR l_shipdate < h.effective_to)""")
def point_in_time_hot_key(spark, d):
    """Nine tenths of the points are of one customer: they are dealt over slices of time."""
    first = table(spark, d, "orders").agg(F.min("o_custkey").alias("hot"))
    points = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(F.broadcast(first))
    points = points.select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").cast("bigint").alias("line"), F.col("l_partkey").alias("partkey"), F.when(F.col("l_orderkey") % 10 == 0, F.col("o_custkey")).otherwise(F.col("hot")).alias("custkey"), F.col("l_shipdate").alias("shipped"))
    return history.as_of_join_spread(points, x2_history(spark, d), ["custkey"], "shipped", 2000).select("orderkey", "line", "partkey", "custkey", "priority", "effective_from")


@query(f"WITH {X2} SELECT custkey, priority, effective_from, effective_to FROM history WHERE custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def entity_history(spark, d):
    some = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("custkey"))
    return history.versions_of(x2_history(spark, d), some, ["custkey"]).select("custkey", "priority", "effective_from", "effective_to")


@query(f"WITH {X2} SELECT custkey, priority, effective_from FROM history WHERE effective_to IS NULL AND custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def current_entities(spark, d):
    some = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("custkey"))
    return history.versions_of(x2_history(spark, d), some, ["custkey"], current=True).select("custkey", "priority", "effective_from")


@query("SELECT o_custkey AS custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def dup_keys(spark, d):
    return changes.duplicate_keys(table(spark, d, "orders").select(F.col("o_custkey").alias("custkey")), ["custkey"])


@query(f"WITH {X1C} SELECT 'custkey' AS \"column\", count(*) FILTER (WHERE custkey IS NULL) AS blanks FROM bad")
def null_keys(spark, d):
    return contracts.blank_counts(x1c(spark, d), KEY)


@query(f"WITH {X1C} SELECT custkey, count(*) AS n FROM bad WHERE is_current AND custkey IS NOT NULL GROUP BY custkey HAVING count(*) > 1")
def multiple_current(spark, d):
    return invariants.multiple_current(x1c(spark, d), KEY)


RELATION = "CASE WHEN prev_to IS NULL THEN 'open_predecessor' WHEN prev_to > effective_from THEN 'overlap' WHEN prev_to = effective_from THEN 'adjacent' ELSE 'gap' END"


@query(f"WITH {X1C} SELECT custkey, effective_from, prev_from, prev_to, {RELATION} AS relation FROM pairs")
def interval_relations(spark, d):
    return invariants.interval_relations(x1c(spark, d), KEY)


@query(f"WITH {X1C} SELECT custkey, effective_from, prev_from, prev_to, {RELATION} AS relation FROM pairs WHERE prev_to IS NULL OR prev_to > effective_from")
def overlaps(spark, d):
    return invariants.overlaps(x1c(spark, d), KEY)


FAULTS = "count(*) FILTER (WHERE NOT is_current AND effective_from >= effective_to) AS reversed, count(*) FILTER (WHERE is_current AND effective_to IS NOT NULL) AS active_with_end, count(*) FILTER (WHERE NOT is_current AND effective_to IS NULL) AS closed_without_end"


@query(f"WITH {X1C} SELECT {FAULTS} FROM bad")
def date_consistency(spark, d):
    return x1c(spark, d).agg(F.count_if(invariants.reversed_dates()).alias("reversed"), F.count_if(invariants.active_with_end()).alias("active_with_end"), F.count_if(invariants.closed_without_end()).alias("closed_without_end"))


REPORT = f"""WITH {X1C}, f AS (SELECT {FAULTS}, count(*) FILTER (WHERE custkey IS NULL) AS nulls FROM bad),
r AS (SELECT 'schema_completeness' AS rule, CAST(0 AS BIGINT) AS issues UNION ALL SELECT 'one_current_per_key', (SELECT count(*) FROM (SELECT custkey FROM bad WHERE is_current AND custkey IS NOT NULL GROUP BY custkey HAVING count(*) > 1))
 UNION ALL SELECT 'no_null_keys', nulls FROM f UNION ALL SELECT 'no_blank_keys', 0 UNION ALL SELECT 'no_overlapping_dates', (SELECT count(*) FROM pairs WHERE prev_to IS NULL OR prev_to > effective_from)
 UNION ALL SELECT 'date_consistency', reversed + active_with_end + closed_without_end FROM f),
report AS (SELECT rule, CASE WHEN issues > 0 THEN 'fail' ELSE 'pass' END AS status, issues FROM r)"""


@query(f"{REPORT} SELECT * FROM report")
def validation_report(spark, d):
    return invariants.validate_history(x1c(spark, d), KEY).select("rule", "status", "issues")


@query(f"{REPORT} SELECT count(*) FILTER (WHERE status = 'pass') AS pass_rules, count(*) FILTER (WHERE status = 'fail') AS fail_rules, count(*) FILTER (WHERE status = 'warn') AS warn_rules, CAST(sum(issues) AS BIGINT) AS issues FROM report")
def validation_summary(spark, d):
    return invariants.validation_summary(invariants.validate_history(x1c(spark, d), KEY))


def _contract() -> contracts.Contract:
    return contracts.Contract((("custkey", "bigint"), ("segment", "string"), ("nation", "string"), ("cents", "string"), ("phone", "string")), ("custkey",), ("segment", "nation", "cents"))


def _bad_source(spark, d) -> DataFrame:
    k = F.col("custkey")
    return x1_source(spark, d).withColumn("segment", F.when(k % 50 == 3, " ").otherwise(F.col("segment"))).withColumn("custkey", F.when(k % 90 == 7, k - 1).when(k % 290 == 2, None).otherwise(k))


CONTRACT = f"""WITH {X1}, src AS (SELECT CASE WHEN custkey % 90 = 7 THEN custkey - 1 WHEN custkey % 290 = 2 THEN NULL ELSE custkey END AS custkey, CASE WHEN custkey % 50 = 3 THEN ' ' ELSE segment END AS segment FROM source),
findings AS (SELECT 'missing_column' AS category, 'phone' AS "column", 'fail' AS severity, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'type_changed', 'cents', 'warn', 1 FROM (SELECT typeof(any_value(cents)) AS t FROM source) WHERE t <> 'VARCHAR'
 UNION ALL SELECT 'blank_value', 'segment', 'fail', count(*) FROM src WHERE trim(segment) = '' HAVING count(*) > 0
 UNION ALL SELECT 'blank_key', 'custkey', 'fail', count(*) FROM src WHERE custkey IS NULL HAVING count(*) > 0
 UNION ALL SELECT 'duplicate_key', 'custkey', 'fail', count(*) FROM (SELECT custkey FROM src GROUP BY custkey HAVING count(*) > 1) HAVING count(*) > 0)"""


@query(f"{CONTRACT} SELECT * FROM findings")
def contract_findings(spark, d):
    return contracts.contract_findings(_bad_source(spark, d), _contract()).select("category", "column", "severity", "n")


@query(f"{CONTRACT} SELECT CASE WHEN count(*) FILTER (WHERE severity = 'fail') > 0 THEN 'incompatible' WHEN count(*) > 0 THEN 'compatible_with_warning' ELSE 'compatible' END AS outcome, count(*) FILTER (WHERE severity = 'fail') AS failures, count(*) FILTER (WHERE severity = 'warn') AS warnings FROM findings")
def contract_outcome(spark, d):
    return contracts.outcome(contracts.contract_findings(_bad_source(spark, d), _contract()))


@query(f"{CONTRACT} SELECT 'crm' AS source, category, \"column\", n FROM findings WHERE severity = 'fail'")
def quarantine_rows(spark, d):
    return contracts.quarantine_rows(contracts.contract_findings(_bad_source(spark, d), _contract()), "crm").drop("samples")


@query(f"WITH {X1}, p AS (SELECT unnest(['custkey', 'segment', 'nation', 'cents']) AS c, unnest([count(DISTINCT custkey) = count(*), count(DISTINCT segment) = count(*), count(DISTINCT nation) = count(*), count(DISTINCT cents) = count(*)]) AS u FROM source), s AS (SELECT c, CAST(CASE WHEN c LIKE '%key' THEN 30 ELSE 0 END + CASE WHEN u THEN 10 ELSE 0 END AS BIGINT) AS score FROM p) SELECT c AS \"column\", score, score > 0 AND score = max(score) OVER () AS is_key FROM s")
def key_scores(spark, d):
    return keys.key_scores(x1_source(spark, d), x1_target(spark, d))


@query("SELECT event_id, user_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-10 12:00:00' ORDER BY ts, user_id, event_id LIMIT 500")
def incremental_page(spark, d):
    page = keys.page_after(table(spark, d, "events"), "ts", ["user_id", "event_id"], {"ts": "2024-01-10 12:00:00", "user_id": 1 << 40, "event_id": 0}, 500)
    return page.select("event_id", "user_id", "event_type")


@query("SELECT (SELECT event_id FROM events ORDER BY ts, event_id LIMIT 1) AS first_id, (SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1) AS last_id")
def cursor_bounds(spark, d):
    return keys.cursor_bounds(table(spark, d, "events"), "ts", ["event_id"]).select(F.col("first.event_id").alias("first_id"), F.col("last.event_id").alias("last_id"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark, d):
    return keys.latest_per_key(table(spark, d, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id"], "ts", ["event_id"]).drop("ts")


@query(f"WITH {X1} SELECT custkey, segment FROM base WHERE custkey % 20 = 1 UNION ALL SELECT custkey, segment FROM source")
def upsert_source(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment"))
    return keys.upsert(base, x1_source(spark, d).select("custkey", "segment"), KEY)


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CASE WHEN bool_and(regexp_matches(trim({e}), '^[+-]?[0-9]{{1,18}}$')) THEN 'bigint' ELSE 'string' END AS type FROM events" for c, e in (("event_type", "event_type"), ("cents", "CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)"), ("value", "CAST(value AS VARCHAR)"))))
def typed_columns(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").cast("string").alias("cents"), F.col("value").cast("string").alias("value"))
    return keys.typed_columns(e, ["user_id"], ["event_type", "cents", "value"])[1]

"""Queries of run lifecycles, corrections as data, labelled rules and key detection."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimtrail.operators import approval, corrections, drift, fingerprint, keys
from dimtrail.plans.run_log import RUN_MOVES, RunLog, run_states
from dimtrail.queries.files import scratch
from dimtrail.queries.fixtures import X4, table, x4_feed
from dimtrail.queries.judging import MAPPING, _validated

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


STATES = list(RUN_MOVES)
ALLOWED = ", ".join(f"'{a}>{b}'" for a, then in RUN_MOVES.items() for b in then)


@query(f"""WITH RECURSIVE e AS (SELECT user_id, ([{', '.join(f"'{s}'" for s in STATES)}])[CAST(event_id % 10 AS INTEGER) + 1] AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, 'CREATED' AS st, CAST(0 AS BIGINT) AS refused, CAST(0 AS BIGINT) AS moves, CAST(0 AS BIGINT) AS retries FROM e
UNION ALL SELECT s.user_id, e.k, CASE WHEN st || '>' || status IN ({ALLOWED}) THEN status ELSE st END, refused + CASE WHEN st || '>' || status IN ({ALLOWED}) THEN 0 ELSE 1 END, moves + CASE WHEN st || '>' || status IN ({ALLOWED}) THEN 1 ELSE 0 END, retries + CASE WHEN st = 'FAILED' AND status = 'CREATED' THEN 1 ELSE 0 END FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT user_id AS run_id, arg_max(st, k) AS status, max(refused) AS refused, max(moves) AS moves, max(retries) AS retries FROM s GROUP BY user_id""")
def onboarding_run_states(spark: SparkSession, d: str) -> DataFrame:
    """Events as moves of onboarding runs, a run a user: most are refused, some lead to an end or to a retry."""
    status = F.get(F.array(*[F.lit(s) for s in STATES]), (F.col("event_id") % 10).cast("int"))
    moves = table(spark, d, "events").select(F.col("user_id").alias("run_id"), status.alias("status"), F.col("ts").alias("at"), "event_id")
    return run_states(moves, tie="event_id")


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS k, r_name FROM region)
SELECT r_name AS run_id, CASE k % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'TRANSFORMING' ELSE 'CREATED' END AS status, CAST(CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS BIGINT) AS moves, CAST(CASE WHEN k % 3 = 2 THEN 1 ELSE 0 END AS BIGINT) AS retries FROM r""")
def stored_run_log(spark: SparkSession, d: str) -> DataFrame:
    """Stored runs, one for each region: some complete, some fail and are begun again; moves that aren't allowed leave nothing."""
    log = RunLog(spark, scratch(spark))
    paths = (("TRANSFORMING", "VALIDATING", "COMPLETED"), ("TRANSFORMING",), ("FAILED", "CREATED"))
    names = [r[0] for r in table(spark, d, "region").select("r_name").orderBy("r_regionkey").collect()]
    for k, name in enumerate(names):
        log.create(name, f"key {name}", str(k))
        for status in paths[k % 3]:
            log.move(name, status)
    return log.states().select("run_id", "status", "moves", "retries")


def _chains(spark: SparkSession, d: str) -> DataFrame:
    """Corrections by operations: dates in another format, mapped states, joined names, casts that fail, an override before a chain."""
    k = F.col("row_no")
    rows = x4_feed(spark, d).select("row_no")
    states = F.create_map(F.lit("Zombie"), F.lit("INACTIVE"), F.lit("a"), F.lit("ACTIVE"))
    made = [
        (k % 29 == 0, "dob", 1, F.array(corrections.step("SET", " 03/02/1970 "), corrections.step("TRIM"), corrections.step("PARSE_DATE", "%d/%m/%Y"))),
        (k % 19 == 0, "state", 1, F.array(corrections.step("MAP_ENUM", mapping=states))),
        (k % 23 == 0, "mail", 2, F.array(corrections.step("NORMALIZE_EMAIL"))),
        (k % 23 == 0, "mail", 1, F.array(corrections.step("SET", " New@Example.COM "))),
        (k % 37 == 0, "cust_no", 1, F.array(corrections.step("CONCAT", "-", fields=("first", "last")), corrections.step("UPPERCASE"))),
        (k % 41 == 1, "cust_no", 1, F.array(corrections.step("CAST", "integer"))),
        (k % 41 == 2, "cust_no", 1, F.array(corrections.step("CAST", "integer"))),
    ]
    parts = [rows.where(cond).select(k.alias("row_index"), F.lit(field).alias("field"), F.lit(at).alias("at"), steps.alias("steps")) for cond, field, at, steps in made]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""WITH {X4} SELECT row_no, CASE WHEN row_no % 37 = 0 THEN upper(trim(first) || '-' || trim(last)) WHEN row_no % 41 = 1 THEN CAST(row_no - 1 AS VARCHAR) WHEN row_no % 41 = 2 THEN NULL ELSE cust_no END AS cust_no, CASE WHEN row_no % 29 = 0 THEN '1970-02-03' ELSE dob END AS dob,
CASE WHEN row_no % 19 = 0 THEN 'INACTIVE' ELSE state END AS state, CASE WHEN row_no % 23 = 0 THEN 'new@example.com' ELSE mail END AS mail, CASE WHEN row_no % 41 = 2 AND row_no % 37 <> 0 THEN 'CUST_NO_CAST_ERROR' ELSE '' END AS failed
FROM feed WHERE row_no % 37 = 0 OR row_no % 41 IN (1, 2) OR row_no % 29 = 0 OR row_no % 19 = 0 OR row_no % 23 = 0""")
def corrected_by_chains(spark: SparkSession, d: str) -> DataFrame:
    chains = _chains(spark, d).where("not (field = 'cust_no' and row_index % 37 = 0 and row_index % 41 in (1, 2) and steps[0].op = 'CAST')")
    out = corrections.corrected(x4_feed(spark, d), "row_no", chains)
    return out.select("row_no", "cust_no", "dob", "state", "mail", F.array_join("errors.rule_id", ",").alias("failed"))


@query("""SELECT c_custkey AS row_index, CASE WHEN c_custkey % 5 = 0 THEN 'shoe_size' ELSE 'dob' END AS field, CASE WHEN c_custkey % 5 = 0 THEN 'UNKNOWN_FIELD' WHEN c_custkey % 5 = 1 THEN 'NO_STEPS' WHEN c_custkey % 5 = 2 THEN 'UNSUPPORTED_TRANSFORMATION_OPERATION' ELSE 'CLOSED' END AS reason FROM customer WHERE c_custkey % 5 < 3 OR c_custkey % 3 = 0""")
def refused_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Corrections of fields that aren't there, without steps, with unknown steps, and of records whose exceptions are resolved."""
    k = F.col("row_index")
    rows = x4_feed(spark, d).select(F.col("row_no").alias("row_index"))
    asked = rows.select("row_index", F.when(k % 5 == 0, "shoe_size").otherwise("dob").alias("field"), F.when(k % 5 == 1, F.array().cast(f"array<{corrections.STEP}>")).otherwise(F.array(F.when(k % 5 == 2, corrections.step("EVAL")).otherwise(corrections.step("TRIM")))).alias("steps"))
    states = rows.select("row_index", F.when(k % 3 == 0, "RESOLVED").otherwise("OPEN").alias("status"))
    return corrections.refused_corrections(asked, x4_feed(spark, d).columns, states)


@query(f"""WITH {X4}, found AS (SELECT DISTINCT row_no, rule_id FROM errors), put AS (SELECT row_no, 'EMAIL_FORMAT' AS rule_id FROM feed WHERE row_no % 23 = 0 OR row_no % 46 = 1 UNION SELECT row_no, 'INVALID_DATE' FROM feed WHERE row_no % 58 = 0 UNION SELECT row_no, 'STATUS_ENUM' FROM feed WHERE row_no % 19 = 0),
pair AS (SELECT coalesce(f.row_no, p.row_no) AS row_no, coalesce(f.rule_id, p.rule_id) AS rule_id, f.rule_id IS NOT NULL AS hit, p.rule_id IS NOT NULL AS lab FROM found f FULL JOIN put p ON f.row_no = p.row_no AND f.rule_id = p.rule_id),
clean AS (SELECT count(*) AS n FROM feed WHERE row_no NOT IN (SELECT row_no FROM put)),
counts AS (SELECT rule_id, count(*) FILTER (lab) AS injected, count(*) FILTER (hit) AS detected, count(*) FILTER (hit AND lab) AS hits, count(*) FILTER (lab AND NOT hit) AS misses, count(*) FILTER (hit AND NOT lab) AS extras, count(DISTINCT CASE WHEN hit AND row_no NOT IN (SELECT row_no FROM put) THEN row_no END) AS wrong FROM pair GROUP BY GROUPING SETS ((rule_id), ()))
SELECT rule_id, injected, detected, hits, misses, extras, CASE WHEN injected > 0 THEN round(hits / injected, 4) ELSE 1.0 END AS coverage, round(wrong / (SELECT n FROM clean), 4) AS false_positives FROM counts""")
def rule_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Rules against labels that miss some faults and name some that aren't there."""
    k = F.col("row_no")
    rows = x4_feed(spark, d).select("row_no")
    put = lambda cond, rule: rows.where(cond).select(k.alias("row_index"), F.lit(rule).alias("rule_id"))
    labels = put((k % 23 == 0) | (k % 46 == 1), "EMAIL_FORMAT").unionByName(put(k % 58 == 0, "INVALID_DATE")).unionByName(put(k % 19 == 0, "STATUS_ENUM"))
    return corrections.rule_evaluation(_validated(spark, d), labels)


#: Tables and the columns whose repeats are counted.
KEYED = {"nation": ("n_nationkey", "n_name", "n_regionkey"), "documents": ("doc_id", "source", "lang", "n_chars"), "conversations": ("conv_id", "turn", "role"), "events": ("event_id", "user_id", "event_type"), "labels": ("quality", "toxic")}
_SCORED = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, count(DISTINCT {c}) + count(DISTINCT CASE WHEN {c} IS NULL THEN 1 END) = count(*) AS u FROM {t}" for t, cs in KEYED.items() for c in cs)
_ENDS = " OR ".join(f"c LIKE '%{e.replace('_', chr(92) + '_')}' ESCAPE '{chr(92)}'" for e in ("_id", "_key", "_code", "_no", "_num", "_number", "id", "key", "code"))


@query(f"""WITH p AS ({_SCORED}), s AS (SELECT t, c, CAST(CASE WHEN {_ENDS} THEN 30 ELSE 0 END + CASE WHEN c IN ('id', 'key') THEN 15 ELSE 0 END + CASE WHEN u THEN 10 ELSE 0 END AS BIGINT) AS score FROM p)
SELECT t AS "table", c AS "column", score, CASE WHEN max(score) OVER w > 0 THEN score = max(score) OVER w ELSE c = min(c) OVER w END AS is_key FROM s WINDOW w AS (PARTITION BY t)""")
def key_scores_of_tables(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t, columns in KEYED.items():
        rows = table(spark, d, t).select(*columns)
        scored = keys.key_scores(rows, rows).select(F.lit(t).alias("table"), "column", "score", "is_key")
        out = scored if out is None else out.unionByName(scored)
    return out


def _version(spark: SparkSession, feed: DataFrame) -> tuple[DataFrame, str]:
    """A frozen mapping of the feed, every field overridden by a reviewer, and the fingerprint of the feed's schema."""
    operations = {m.sources[0]: (m.target, json.dumps(m.operations)) for m in MAPPING}
    proposals = spark.createDataFrame([(c, "UNMAPPED", 0.0, False) for c in operations], "source_field string, target string, score double, ambiguous boolean")
    decisions = spark.createDataFrame([(c, "OVERRIDE", t, 1) for c, (t, _) in operations.items()], "source_field string, decision string, target string, at int")
    steps = spark.createDataFrame([(c, o) for c, (_, o) in operations.items()], "source_field string, operations string")
    mark = fingerprint.schema_fingerprints(drift.snapshot_schema(feed, "crm", 1)).first().fingerprint
    return approval.frozen(approval.reviewed(proposals, decisions), steps, mark), mark


@query(f"WITH {X4} SELECT row_no AS row_index, customer_id, first_name, last_name, email, date_of_birth, status, created_at, bad_date AS failed FROM mapped")
def approved_mapping_applied(spark: SparkSession, d: str) -> DataFrame:
    """The feed through a frozen mapping version; an altered version and another schema are refused."""
    feed = x4_feed(spark, d)
    version, mark = _version(spark, feed)
    for bad, of in ((version.withColumn("target", F.when(F.col("target") == "email", "phone").otherwise(F.col("target"))), mark), (version, "another")):
        try:
            approval.require_unaltered(bad, of)
        except approval.ApprovalError:
            continue
        raise AssertionError("a version that doesn't fit was accepted")
    return approval.apply_version(feed, version, mark, "row_no").withColumn("failed", F.size("errors") > 0).drop("errors")

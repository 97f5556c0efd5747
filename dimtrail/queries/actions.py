"""Queries of actions on holds and exceptions, of canonical batches, of ordinals, codecs, fingerprints and the rarer rules."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimtrail.operators import containment, fingerprint, guardrail, keys, metrics, onboarding
from dimtrail.operators.changes import classify_changes
from dimtrail.plans.pipeline import integrate_canonical
from dimtrail.queries.files import scratch
from dimtrail.queries.fixtures import X1, X2, X4, table, x1_source, x1_target, x2_history, x4_feed
from dimtrail.queries.judging import DRIFT, EXCEPTIONS, MAPPING, TODAY, _corrections, _exceptions, _mapped, _registries, _validated

QUERIES, ORACLES = {}, {}
RELEASED = datetime.date(2001, 1, 1)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _frozen(spark: SparkSession, d: str) -> DataFrame:
    """Held order rows: the last finished order of each customer, else the last by number."""
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("custkey")).agg(F.max_by(F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("at")), F.struct(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")), "o_orderkey")).alias("v")).select("custkey", "v.*")


def _cut_history(spark: SparkSession, d: str) -> DataFrame:
    """The order history as it stood at the beginning of 1998."""
    end = F.lit(datetime.date(1998, 1, 1))
    return x2_history(spark, d).where(F.col("effective_from") < end).withColumn("effective_to", F.when(F.col("effective_to") < end, F.col("effective_to"))).withColumn("is_current", F.col("effective_to").isNull())


def _stored(df: DataFrame) -> DataFrame:
    """A table written once, as held rows and histories are: what reads it several times doesn't derive it anew."""
    at = scratch(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _hold(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("h1", "HELD", 1), ("h0", "HELD", 1), ("h0", "DISCARDED", 2)], "hold_id string, status string, at int")


HELD = f"""{X2},
frozen AS (SELECT custkey, priority, "at" FROM (SELECT o_custkey AS custkey, o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS "at", row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN o_orderdate END DESC NULLS LAST, o_orderkey DESC) AS r FROM orders) WHERE r = 1),
cut AS (SELECT custkey, priority, effective_from, CASE WHEN effective_to < DATE '1998-01-01' THEN effective_to END AS effective_to FROM history WHERE effective_from < DATE '1998-01-01'),
cur AS (SELECT * FROM cut WHERE effective_to IS NULL),
fit AS (SELECT f.custkey, f.priority, c.priority AS old FROM frozen f LEFT JOIN cur c USING (custkey) WHERE c.custkey IS NULL OR f."at" >= c.effective_from)"""


@query(f"""WITH {HELD} SELECT custkey, priority, effective_from, CASE WHEN effective_to IS NULL AND custkey IN (SELECT custkey FROM fit WHERE priority <> old) THEN DATE '2001-01-01' ELSE effective_to END AS effective_to, effective_to IS NULL AND custkey NOT IN (SELECT custkey FROM fit WHERE priority <> old) AS is_current FROM cut
UNION ALL SELECT custkey, priority, DATE '2001-01-01', NULL, TRUE FROM fit WHERE old IS NULL OR priority <> old""")
def release_replay(spark, d):
    """Frozen rows replayed into the history that went on without them; rows older than the current version are left out."""
    return containment.release(_hold(spark), "h1", _frozen(spark, d), _cut_history(spark, d), ["custkey"], ["priority"], "at", RELEASED).history


@query(f"WITH {HELD}, n AS (SELECT count(*) FILTER (WHERE old IS NULL OR priority <> old) AS changed FROM fit) SELECT FALSE AS forced, CASE WHEN changed > 25 THEN 'HELD' ELSE 'REPROCESSED' END AS status, changed <= 25 AS advances FROM n UNION ALL SELECT TRUE, 'REPROCESSED', TRUE")
def reprocess_held(spark, d):
    """A held batch judged again: it stays held while too much of it changes, unless forced."""
    limits = guardrail.Thresholds(changed=25, ratio=2.0, relative=1e9, dispersion=1 << 40)
    rows, frozen, history = [], _stored(_frozen(spark, d)), _stored(_cut_history(spark, d).where("custkey is not null"))
    for forced in (False, True):
        r = containment.reprocess(_hold(spark), "h1", frozen, history, ["custkey"], ["priority"], "at", RELEASED, limits, forced)
        rows.append((forced, r.status, r.advances))
    return spark.createDataFrame(rows, "forced boolean, status string, advances boolean")


@query(f"WITH {HELD}, now AS (SELECT * FROM history WHERE effective_to IS NULL) SELECT f.custkey, 'CHANGED' AS change_type FROM frozen f JOIN now USING (custkey) WHERE f.priority <> now.priority")
def discard_effect(spark, d):
    """Current history rows that a discarded batch would have closed and hasn't."""
    containment.discard(_hold(spark), "h1")
    return classify_changes(_frozen(spark, d).select("custkey", "priority"), x2_history(spark, d), ["custkey"], ["priority"], "incremental", "ignore").where("change_type = 'CHANGED'").select("custkey", "change_type")


@query(f"WITH {X4}, fixed AS (SELECT * REPLACE (CASE WHEN row_no % 29 = 0 THEN CASE WHEN row_no % 58 = 0 THEN DATE '1970-01-03' ELSE DATE '1970-01-02' END ELSE date_of_birth END AS date_of_birth) FROM marked), left_over AS (SELECT row_no FROM errors WHERE row_no % 29 = 0 AND rule_id NOT IN ('INVALID_DATE', 'DOB_IN_FUTURE')), {EXCEPTIONS[EXCEPTIONS.index('x AS'):]} SELECT exception_id, CASE WHEN row_index IN (SELECT row_no FROM left_over) THEN 'REPROCESSED' ELSE 'RESOLVED' END AS status FROM x WHERE row_index % 29 = 0")
def reprocessed_exceptions(spark, d):
    """Corrected rows mapped and validated again with the whole batch: resolved, or back with what is left."""
    found = _exceptions(spark, d)
    events = found.where("row_index % 29 = 0").select("exception_id", F.lit("CORRECTED").alias("status"), F.lit("2025-01-03").cast("timestamp").alias("at"))
    fixed = onboarding.apply_corrections(x4_feed(spark, d), "row_no", _corrections(spark, d))
    feed = x4_feed(spark, d).join(fixed.select("row_no"), "row_no", "left_anti").unionByName(fixed)
    again = onboarding.validate_records(onboarding.apply_mapping(feed, MAPPING, "row_no"), TODAY)
    return onboarding.reprocess_exceptions(found, events, again)


@query(f"WITH {X4}, good AS (SELECT * FROM mapped WHERE row_no NOT IN (SELECT row_no FROM errors)) SELECT customer_id, first_name, last_name, email, date_of_birth, status, CAST(created_at AS TIMESTAMP) + INTERVAL 12 HOUR AS created_at FROM good")
def canonical_batch(spark, d):
    return onboarding.canonical_batch(onboarding.valid_records(_validated(spark, d)))


@query(f"WITH {X4}, good AS (SELECT * FROM mapped WHERE row_no NOT IN (SELECT row_no FROM errors)), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE row_no % 3 = 0) AS fresh, count(*) FILTER (WHERE row_no % 3 <> 0 AND row_no % 15 = 2) AS moved FROM good) SELECT n AS evaluated, moved AS changed, fresh AS \"new\", CASE WHEN moved > 25 THEN 'SUSPICIOUS' ELSE 'NORMAL' END AS decision, CASE WHEN moved > 25 THEN 0 ELSE n + moved END AS versions FROM n")
def canonical_gate(spark, d):
    """A canonical batch judged before it is committed: a third of its customers is new, some have moved to another status."""
    good = _stored(onboarding.valid_records(_validated(spark, d)).withColumn("created_at", F.col("created_at").cast("timestamp")))
    row_no = F.col("row_index")
    known = onboarding.canonical_to_source(good.where(row_no % 3 != 0).withColumn("status", F.when(row_no % 15 == 2, F.lit("OTHER")).otherwise(F.col("status"))))
    history = _stored(known.selectExpr("*", "date'2020-01-01' as effective_from", "cast(null as date) as effective_to", "true as is_current"))
    changes, staged, judged = integrate_canonical(good, history, TODAY, thresholds=guardrail.Thresholds(ratio=2.0, dispersion=1 << 40, velocity=1e12))
    return judged.select("evaluated", "changed", "new", "decision", F.lit(staged.count() if staged is not None else 0).cast("bigint").alias("versions"))


@query(f"""WITH {X4}, raw AS (SELECT row_no, cust_no, first, dob, signup FROM feed) SELECT rule_id, count(*) AS n FROM (
SELECT 'CUSTOMER_ID_TYPE' AS rule_id FROM raw UNION ALL SELECT 'DATE_OF_BIRTH_TYPE' FROM raw UNION ALL SELECT 'CREATED_AT_TYPE' FROM raw WHERE row_no % 5 = 0 UNION ALL SELECT 'CREATED_AT_IN_FUTURE' FROM raw WHERE row_no % 5 = 1
UNION ALL SELECT 'EMAIL_DUPLICATE' FROM raw WHERE row_no % 7 = 0 AND (SELECT count(*) FROM raw WHERE row_no % 7 = 0) > 1 UNION ALL SELECT 'REFERENTIAL_INTEGRITY' FROM feed WHERE row_no > 100) GROUP BY rule_id""")
def record_type_errors(spark, d):
    """A feed mapped without conversions: numbers for ids, text for dates, unreadable and future times, shared e-mails, ids that no reference has."""
    k = F.col("row_no")
    rows = x4_feed(spark, d).select(k.alias("row_index"), k.alias("customer_id"), "first", "last", "mail", "dob", k.alias("n")).toDF("row_index", "customer_id", "first_name", "last_name", "email", "date_of_birth", "n")
    rows = rows.withColumn("email", F.when(F.col("n") % 7 == 0, "same@x.org").otherwise(F.concat(F.lit("u"), F.col("n").cast("string"), F.lit("@x.org")))).withColumn("status", F.lit("ACTIVE"))
    rows = rows.withColumn("created_at", F.when(F.col("n") % 5 == 0, "whenever").when(F.col("n") % 5 == 1, "2999-01-01T00:00:00Z").otherwise("2024-01-01T10:00:00+02:00")).drop("n").withColumn("errors", F.array().cast("array<struct<rule_id:string,field:string,message:string>>"))
    known = table(spark, d, "customer").where("c_custkey <= 100").select("c_custkey")
    return onboarding.violations_by_rule(onboarding.validate_records(rows, TODAY, unique_email=True, reference=("customer_id", known, "c_custkey")))


@query("""WITH b AS (SELECT o_orderpriority AS batch, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS stopped, max(o_orderkey % 10) - min(o_orderkey % 10) AS seconds FROM orders GROUP BY 1)
SELECT batch, stopped AS deactivations, round_even(n / greatest(seconds, 1), 2) AS changes_per_second, array_to_string(list_filter([CASE WHEN n >= 10 AND round_even(n / greatest(seconds, 1), 2) > 50 THEN 'HIGH_CHANGE_VELOCITY' END, CASE WHEN n > 25 THEN 'HIGH_CHANGE_VOLUME' END, CASE WHEN n >= 10 THEN 'HIGH_POPULATION_IMPACT' END, CASE WHEN stopped > 5 THEN 'MASS_DEACTIVATION' END, CASE WHEN batch = '1-URGENT' THEN 'SCD2_VALIDATION_FAILURE' END, CASE WHEN n > 5 THEN 'WIDE_GEOGRAPHIC_IMPACT' END], lambda x: x IS NOT NULL), ',') AS rules,
CASE WHEN batch = '1-URGENT' THEN 'CRITICAL' ELSE 'HIGH' END AS severity, 'status' AS column FROM b""".replace(", 'status' AS column", ""))
def guardrail_status(spark, d):
    """Orders as status changes within seconds: deactivations, velocity and a history that failed its invariants."""
    o = table(spark, d, "orders")
    new = F.when(F.col("o_orderstatus") == "F", "Closed").otherwise("ACTIVE ")
    rows = o.select(F.col("o_orderpriority").alias("batch"), F.col("o_orderkey").alias("key"), F.timestamp_seconds(F.col("o_orderkey") % 10).alias("at"), F.lit("CHANGED").alias("change_type"), F.array(F.struct(F.lit("status").alias("column"), F.lit("active").alias("old_value"), new.alias("new_value"))).alias("field_changes"))
    valid = rows.select("batch", (F.col("batch") != "1-URGENT").alias("valid")).distinct()
    judged = guardrail.decide(guardrail.evidence(rows, "batch", ["key"], "at", valid=valid))
    return judged.select("batch", "deactivations", "changes_per_second", F.array_join("rules", ",").alias("rules"), "severity")


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS lowest, count(*) - 1 AS highest, count(DISTINCT p_partkey) AS different FROM part")
def row_ordinals(spark, d):
    at = scratch(spark)
    table(spark, d, "part").select("p_partkey", "p_name").repartition(3).write.option("header", True).csv(at)
    rows = keys.with_ordinal(spark.read.option("header", True).csv(at))
    return rows.agg(F.count("*").alias("n"), F.min("row_index").alias("lowest"), F.max("row_index").alias("highest"), F.count_distinct("row_index").alias("different"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def order_preview(spark, d):
    return keys.preview(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"], 1000)


@query("SELECT CAST(json_object('s_name', s_name, 's_nationkey', s_nationkey, 's_suppkey', CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey END) AS VARCHAR) AS entity_key, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey END AS s_suppkey, s_name FROM supplier")
def key_json(spark, d):
    """Keys as JSON text, and back."""
    rows = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey")).alias("s_suppkey"), "s_name", "s_nationkey")
    coded = rows.select(keys.to_key_json(rows.columns).alias("entity_key"))
    return coded.withColumn("k", keys.from_key_json(F.col("entity_key"), "s_name string, s_nationkey bigint, s_suppkey bigint")).select("entity_key", "k.s_suppkey", "k.s_name")


@query("SELECT CAST(user_id % 50 AS VARCHAR) AS idempotency_key, count(DISTINCT event_type || '|' || CAST(user_id AS VARCHAR)) AS requests FROM events GROUP BY 1 HAVING count(DISTINCT event_type || '|' || CAST(user_id AS VARCHAR)) > 1")
def request_conflicts(spark, d):
    e = table(spark, d, "events")
    rows = e.select((F.col("user_id") % 50).cast("string").alias("idempotency_key"), fingerprint.request_fingerprint("event_type", F.lit(1), F.lit(None), "user_id").alias("fingerprint"))
    return metrics.idempotency_conflicts(rows)


def _classes(rows: list[tuple[str, DataFrame]]) -> DataFrame:
    """(variant, class): the first variant with the same fingerprint."""
    found = [(n, df.first()[0]) for n, df in rows]
    first: dict[str, str] = {}
    return rows[0][1].sparkSession.createDataFrame([(n, first.setdefault(v, n)) for n, v in found], "variant string, class string")


VARIANTS = """target AS (SELECT c_custkey AS k, c_mktsegment AS s FROM customer), variants AS (
SELECT 'all' AS variant, k, s FROM target UNION ALL SELECT 'other order', k, s FROM target UNION ALL SELECT 'one less', k, s FROM target WHERE k <> (SELECT min(k) FROM target) UNION ALL SELECT 'one twice', k, s FROM target UNION ALL SELECT 'one twice', min(k), min_by(s, k) FROM target
UNION ALL SELECT 'one other', k, CASE WHEN k = (SELECT min(k) FROM target) THEN 'x' ELSE s END FROM target UNION ALL SELECT 'twice', k, s FROM target UNION ALL SELECT 'twice', k, s FROM target),
contents AS (SELECT variant, string_agg(k || ':' || s, ',' ORDER BY k, s) AS c FROM variants GROUP BY variant), numbered AS (SELECT variant, c, CASE variant WHEN 'all' THEN 0 WHEN 'other order' THEN 1 WHEN 'one less' THEN 2 WHEN 'one twice' THEN 3 WHEN 'one other' THEN 4 ELSE 5 END AS n FROM contents)"""


def _variants(spark, d) -> list[tuple[str, DataFrame]]:
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s"))
    low = t.agg(F.min("k")).first()[0]
    return [("all", t), ("other order", t.repartition(3).sortWithinPartitions(F.desc("k")).select("s", "k")), ("one less", t.where(F.col("k") != low)), ("one twice", t.unionByName(t.where(F.col("k") == low))), ("one other", t.withColumn("s", F.when(F.col("k") == low, "x").otherwise(F.col("s")))), ("twice", t.unionByName(t))]


@query(f"WITH {VARIANTS} SELECT variant, min_by(variant, n) OVER (PARTITION BY c) AS class FROM numbered")
def dataset_digest(spark, d):
    """Equal tables have equal digests, in whatever order; others differ."""
    return _classes([(n, fingerprint.dataset_digest(df)) for n, df in _variants(spark, d)])


@query(f"WITH {VARIANTS} SELECT variant, min_by(variant, n) OVER (PARTITION BY c) AS class FROM numbered")
def input_fingerprint(spark, d):
    return _classes([(n, fingerprint.input_fingerprint(df)) for n, df in _variants(spark, d)])


@query(f"WITH {X1}, v(variant, n, mode, day) AS (VALUES ('once', 0, 'full', '1996-01-01'), ('again', 1, 'full', '1996-01-01'), ('mode', 2, 'incremental', '1996-01-01'), ('day', 3, 'full', '1996-01-02'), ('source', 4, 'full', '1996-01-01')), c AS (SELECT v.*, CASE WHEN variant = 'source' THEN (SELECT count(*) FROM source WHERE custkey % 20 <> 2) ELSE (SELECT count(*) FROM source) END AS size FROM v) SELECT variant, min_by(variant, n) OVER (PARTITION BY mode, day, size) AS class FROM c")
def execution_fingerprint(spark, d):
    """Equal inputs and parameters have equal fingerprints."""
    source, target = x1_source(spark, d), x1_target(spark, d)
    made = lambda s, day, mode: fingerprint.execution_fingerprint(s, target, day, mode, "soft_delete", ["custkey"], ["segment", "nation", "cents"])
    return _classes([("once", made(source, "1996-01-01", "full")), ("again", made(source.repartition(3), "1996-01-01", "full")), ("mode", made(source, "1996-01-01", "incremental")), ("day", made(source, "1996-01-02", "full")), ("source", made(source.where("custkey % 20 <> 2"), "1996-01-01", "full"))])


@query("WITH e AS (SELECT event_type, user_id, ts, user_id % 2 AS half FROM events), b AS (SELECT event_type || '-' || half || '-' || copy AS batch, user_id, ts FROM e, (SELECT unnest([0, 1]) AS copy)), c AS (SELECT batch, string_agg(user_id || '@' || ts, ',' ORDER BY user_id, ts) AS c FROM b GROUP BY batch) SELECT batch, min(batch) OVER (PARTITION BY c) AS class FROM c")
def batch_fingerprint(spark, d):
    """Every batch comes twice, in two orders; equal batches share a class."""
    e = table(spark, d, "events")
    rows = e.select(F.explode(F.array(F.lit("0"), F.lit("1"))).alias("copy"), "*").repartition(5, "copy", "ts").select(F.concat_ws("-", "event_type", (F.col("user_id") % 2).cast("string"), "copy").alias("batch"), "user_id", "ts")
    found = fingerprint.batch_fingerprints(rows, "batch", ["user_id"], "ts")
    return found.join(found.groupBy("fingerprint").agg(F.min("batch").alias("class")), "fingerprint").select("batch", "class")


@query(f"WITH {DRIFT}, specs AS (SELECT 1 AS version, string_agg(slug || ':' || type || ':' || nullable, ',' ORDER BY slug) AS spec FROM a UNION ALL SELECT 2, string_agg(slug || ':' || type || ':' || nullable, ',' ORDER BY slug) FROM b UNION ALL SELECT 3, string_agg(slug || ':' || type || ':' || nullable, ',' ORDER BY slug) FROM a) SELECT version, min(version) OVER (PARTITION BY spec) AS class FROM specs")
def schema_fingerprint(spark, d):
    """The third version of the feed's schema is the first one again."""
    a, b = _registries(spark, d)
    found = fingerprint.schema_fingerprints(a.unionByName(b).unionByName(a.withColumn("version", F.lit(3))))
    return found.join(found.groupBy("fingerprint").agg(F.min("version").alias("class")), "fingerprint").select("version", "class")

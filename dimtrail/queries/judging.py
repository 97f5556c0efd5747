"""Queries of the guardrail, containment, run logs, profiles, onboarding and drift."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimtrail.operators import containment, drift, guardrail, metrics, narrative, onboarding, profile
from dimtrail.queries.fixtures import X3, X4, table, x3_changes, x3_rows, x4_feed

QUERIES, ORACLES = {}, {}
TODAY = datetime.date(2025, 6, 1)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _evidence(spark, d) -> DataFrame:
    rows = x3_changes(spark, d)
    first = F.col("day") == F.lit(x3_rows(spark, d).agg(F.min("day")).first()[0])
    return guardrail.evidence(rows, "day", ["user_id"], "ts", first)


@query(f"WITH {X3} SELECT day, evaluated, changed, new_rows AS \"new\", mutated, dispersion, CAST(round(round_even(max_relative, 4) * 10000) AS BIGINT) AS rel_1e4, CAST(max_absolute AS BIGINT) AS max_absolute, total_absolute, transitions, CASE WHEN max_absolute > 0 THEN 'cents' END AS worst_column, round_even(mutated / CAST(evaluated AS DOUBLE), 4) AS ratio, round_even(per_second, 2) AS changes_per_second, CAST(0 AS BIGINT) AS deactivations FROM evidence")
def guardrail_evidence(spark, d):
    return _evidence(spark, d).select("day", "evaluated", "changed", "new", "mutated", "dispersion", F.round(F.col("max_relative") * 10000).cast("bigint").alias("rel_1e4"), F.col("max_absolute").cast("bigint").alias("max_absolute"), F.col("total_absolute").cast("bigint").alias("total_absolute"), "transitions", "worst_column", "ratio", "changes_per_second", "deactivations")


@query(f"WITH {X3} SELECT day, 'event_type' AS \"column\", count(*) AS n FROM changed WHERE n > 1 AND event_type <> old_type GROUP BY day UNION ALL SELECT day, 'cents', count(*) FROM changed WHERE n > 1 AND cents <> old_cents GROUP BY day")
def per_column_changes(spark, d):
    return guardrail.per_column_changes(x3_changes(spark, d).select("day", F.inline("field_changes")), "day")


@query(f"WITH {X3} SELECT day, array_to_string(rules, ',') AS rules, CASE WHEN len(rules) >= 2 THEN 'HIGH' WHEN len(rules) = 1 THEN 'MEDIUM' ELSE 'LOW' END AS severity, CASE WHEN len(rules) > 0 THEN 'SUSPICIOUS' ELSE 'NORMAL' END AS decision FROM judged")
def guardrail_decisions(spark, d):
    return guardrail.decide(_evidence(spark, d)).select("day", F.array_join("rules", ",").alias("rules"), "severity", "decision")


@query(f"WITH {X3} SELECT rule, count(*) AS n FROM (SELECT unnest(rules) AS rule FROM judged) GROUP BY rule")
def rule_triggers(spark, d):
    return guardrail.rule_triggers(guardrail.decide(_evidence(spark, d)))


@query(f"WITH {X3} SELECT day, 'Of ' || evaluated || ' rows ' || changed || ' changed and ' || new_rows || ' are new.' || CASE WHEN len(rules) > 0 THEN ' Held for ' || array_to_string(rules, ', ') || ' at severity ' || CASE WHEN len(rules) >= 2 THEN 'HIGH' ELSE 'MEDIUM' END || '.' ELSE ' No rule was triggered.' END AS narrative FROM judged")
def batch_narratives(spark, d):
    return narrative.batch_narratives(guardrail.decide(_evidence(spark, d)), "day")


@query(f"WITH {X3} SELECT day, (CASE WHEN len(rules) = 1 THEN NOT list_contains(rules, 'MASS_DEACTIVATION') ELSE FALSE END) AS names_untriggered_rule, len(rules) = 1 AS wrong_severity, len(rules) = 0 AND FALSE AS wrong_decision FROM judged")
def grounding_flags(spark, d):
    decided = guardrail.decide(_evidence(spark, d))
    told = decided.withColumn("narrative", F.when(F.size("rules") == 1, "Held for MASS_DEACTIVATION at severity HIGH.").when(F.size("rules") == 0, "No rule was triggered.").otherwise("Held at severity HIGH."))
    names = ["HIGH_CHANGE_VELOCITY", "HIGH_CHANGE_VOLUME", "HIGH_POPULATION_IMPACT", "LARGE_QUANTITY_SWING", "MASS_DEACTIVATION", "SCD2_VALIDATION_FAILURE", "WIDE_GEOGRAPHIC_IMPACT"]
    return narrative.grounding_flags(told, names).select("day", "names_untriggered_rule", "wrong_severity", "wrong_decision")


def _hold_events(spark, d) -> DataFrame:
    """Events as holds of users: error holds, purchase releases, signup discards; the rest is noise."""
    status = F.when(F.col("event_type") == "error", "HELD").when(F.col("event_type") == "purchase", "RELEASED").when(F.col("event_type") == "signup", "DISCARDED")
    return table(spark, d, "events").select(F.concat(F.col("user_id").cast("string"), F.lit("-"), F.dayofmonth("ts").cast("string")).alias("hold_id"), status.alias("status"), F.col("ts").alias("at")).where("status is not null")


HOLDS = """WITH e AS (SELECT user_id || '-' || day(ts) AS hold_id, CASE event_type WHEN 'error' THEN 'HELD' WHEN 'purchase' THEN 'RELEASED' WHEN 'signup' THEN 'DISCARDED' END AS status, ts FROM events WHERE event_type IN ('error', 'purchase', 'signup')),
s AS (SELECT hold_id, coalesce(arg_min(status, ts) FILTER (WHERE status <> 'HELD'), 'HELD') AS status FROM e GROUP BY hold_id HAVING count(*) FILTER (WHERE status = 'HELD') > 0)"""


@query(f"{HOLDS} SELECT hold_id, status FROM s")
def hold_states(spark, d):
    return containment.hold_states(_hold_events(spark, d)).select("hold_id", "status")


@query(f"{HOLDS} SELECT status, count(*) AS n FROM s GROUP BY status")
def hold_counts(spark, d):
    return containment.hold_counts(containment.hold_states(_hold_events(spark, d)))


@query(f"{HOLDS} SELECT e.hold_id, e.status, count(*) AS n FROM e LEFT JOIN s ON s.hold_id = e.hold_id WHERE e.status <> 'HELD' AND s.status IS DISTINCT FROM e.status GROUP BY 1, 2")
def refused_moves(spark, d):
    return containment.refused_moves(_hold_events(spark, d)).groupBy("hold_id", "status").agg(F.count("*").alias("n"))


@query("SELECT source, fingerprint, min(batch) AS batch FROM (SELECT event_type AS source, CAST(user_id % 5 AS VARCHAR) AS fingerprint, event_id AS batch FROM events WHERE value > 20) WHERE NOT (source = 'error' AND fingerprint IN ('0', '1')) GROUP BY source, fingerprint")
def hold_dedup(spark, d):
    e = table(spark, d, "events")
    batches = e.where("value > 20").select(F.col("event_type").alias("source"), (F.col("user_id") % 5).cast("string").alias("fingerprint"), F.col("event_id").alias("batch"))
    holds = e.where("event_type = 'error'").select(F.col("event_type").alias("source"), (F.col("user_id") % 2).cast("string").alias("fingerprint"), F.lit("HELD").alias("status")).distinct()
    return containment.new_holds(batches, holds)


def _runs(spark, d) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "signup", "HELD").otherwise("COMMITTED")
    return table(spark, d, "events").select(F.col("event_id").alias("run_id"), status.alias("status"), F.col("ts").alias("started"), F.floor("value").cast("bigint").alias("seen"), (F.col("user_id") % 7).alias("changed"), (F.col("user_id") % 3).alias("held"))


RUNS = "runs AS (SELECT event_id AS run_id, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'HELD' ELSE 'COMMITTED' END AS status, ts AS started, CAST(floor(value) AS BIGINT) AS seen, user_id % 7 AS changed, user_id % 3 AS held FROM events)"


@query(f"WITH {RUNS} SELECT coalesce(status, 'ALL') AS status, count(*) AS runs, CAST(sum(seen) AS BIGINT) AS seen, CAST(sum(changed) AS BIGINT) AS changed, CAST(sum(held) AS BIGINT) AS held FROM runs GROUP BY ROLLUP (status)")
def run_counts(spark, d):
    return metrics.run_counts(_runs(spark, d))


@query(f"WITH {RUNS} SELECT run_id, status, seen FROM runs ORDER BY started DESC, run_id LIMIT 50 OFFSET 10")
def recent_runs(spark, d):
    return containment.newest(_runs(spark, d), "started", "run_id", 50, 10).select("run_id", "status", "seen")


@query(f"WITH {RUNS} SELECT run_id, status, seen FROM runs WHERE status = 'HELD' AND held = 2")
def filtered_runs(spark, d):
    return containment.filtered(_runs(spark, d), status="HELD", held=2, seen=None).select("run_id", "status", "seen")


@query(f"WITH {RUNS}, {HOLDS[5:]}, m AS (SELECT count(*) AS runs, CAST(sum(seen) AS BIGINT) AS seen, CAST(sum(changed) AS BIGINT) AS changed, arg_max(run_id, started) AS last_run, arg_max(status, started) AS last_status FROM runs), h AS (SELECT count(*) FILTER (WHERE status = 'HELD') AS active_holds FROM s) SELECT runs, seen, changed, last_run, last_status, active_holds, (SELECT max(ts) FROM events) AS last_checkpoint, CASE WHEN last_status = 'FAILED' THEN 'critical' WHEN active_holds > 0 THEN 'degraded' ELSE 'nominal' END AS health FROM m, h")
def ops_metrics(spark, d):
    holds = containment.hold_states(_hold_events(spark, d))
    marks = table(spark, d, "events").select(F.col("ts").alias("updated"))
    return metrics.ops_metrics(_runs(spark, d), holds, marks)


FAILURES = """f AS (SELECT event_id, user_id % 4 AS t, CASE event_type WHEN 'error' THEN 'Rate limit: try again' WHEN 'signup' THEN 'Column x is missing' WHEN 'view' THEN 'Bad CSV' WHEN 'click' THEN 'Duplicate business key' ELSE 'odd' END AS message, CASE user_id % 3 WHEN 0 THEN 'ValueError' WHEN 1 THEN 'FileNotFoundError' ELSE 'DuplicateBusinessKeyError' END AS kind FROM events)"""


@query(f"""WITH {FAILURES} SELECT event_id, CASE WHEN kind = 'DuplicateBusinessKeyError' THEN 'deterministic_scd2_error' WHEN t = 0 THEN 'deterministic_input_error' WHEN t = 1 AND (kind = 'ValueError' OR regexp_matches(lower(message), 'key|column')) THEN 'deterministic_schema_error' WHEN t = 2 THEN 'persistence_error'
WHEN message = 'Rate limit: try again' THEN 'transient_ai_error' WHEN t = 3 THEN 'unexpected_internal_error' WHEN message = 'Duplicate business key' THEN 'deterministic_scd2_error' ELSE 'unexpected_internal_error' END AS category FROM f""")
def failure_categories(spark, d):
    said = {"error": "Rate limit: try again", "signup": "Column x is missing", "view": "Bad CSV", "click": "Duplicate business key"}
    message = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in said.items() for x in kv]), F.col("event_type")), F.lit("odd"))
    kind = F.element_at(F.array(*map(F.lit, ("ValueError", "FileNotFoundError", "DuplicateBusinessKeyError"))), (F.col("user_id") % 3 + 1).cast("int"))
    task = F.element_at(F.array(*map(F.lit, ("ingest_csvs", "detect_schema", "persist_artifacts", "explain_changes"))), (F.col("user_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", metrics.failure_category(message, kind, task).alias("category"))


@query("WITH c AS (SELECT count(*) FILTER (WHERE toxic = 1 AND n_chars > 1500) AS tp, count(*) FILTER (WHERE toxic <> 1 AND n_chars <= 1500) AS tn, count(*) FILTER (WHERE toxic <> 1 AND n_chars > 1500) AS fp, count(*) FILTER (WHERE toxic = 1 AND n_chars <= 1500) AS fn FROM labels JOIN documents USING (doc_id)) SELECT *, (tp + tn) * 10000 // (tp + tn + fp + fn) AS accuracy, CASE WHEN tp + fp > 0 THEN tp * 10000 // (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp * 10000 // (tp + fn) END AS recall, CASE WHEN tn + fp > 0 THEN tn * 10000 // (tn + fp) END AS specificity, CASE WHEN tp + fp + fn > 0 THEN 2 * tp * 10000 // (2 * tp + fp + fn) END AS f1, CASE WHEN fp + tn > 0 THEN fp * 10000 // (fp + tn) END AS fpr, CASE WHEN fn + tp > 0 THEN fn * 10000 // (fn + tp) END AS fnr FROM c")
def classification_metrics(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select((F.col("toxic") == 1).alias("expected"), (F.col("n_chars") > 1500).alias("predicted"))
    return guardrail.classification_metrics(rows, "expected", "predicted")


@query("""SELECT event_type, count(*) AS n, sum(c) / count(*) AS mean, min(c) AS "min", max(c) FILTER (WHERE r = 1 + CAST(floor(t * 0.5) AS BIGINT)) AS p50, max(c) FILTER (WHERE r = 1 + CAST(floor(t * 0.95) AS BIGINT)) AS p95, max(c) FILTER (WHERE r = 1 + CAST(floor(t * 0.99) AS BIGINT)) AS p99, max(c) AS "max"
FROM (SELECT event_type, c, row_number() OVER (PARTITION BY event_type ORDER BY c) AS r, count(*) OVER (PARTITION BY event_type) AS t FROM (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS c FROM events)) GROUP BY event_type""")
def latency_percentiles(spark, d):
    rows = table(spark, d, "events").select("event_type", F.round(F.col("value") * 100).cast("bigint").alias("c"))
    return guardrail.latency_percentiles(rows, ["event_type"], "c")


PROFILED = ["doc_id", "lang", "source", "n_chars"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) AS total, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", CAST(floor(count(DISTINCT {c}) * 10000 / count({c})) AS BIGINT) AS uniqueness, count(DISTINCT {c}) = count({c}) AS is_unique, min(length(CAST({c} AS VARCHAR))) AS min_length, max(length(CAST({c} AS VARCHAR))) AS max_length FROM documents" for c, t in zip(PROFILED, ("integer", "string", "string", "integer"), strict=True)))
def profile_columns(spark, d):
    return profile.profile_columns(table(spark, d, "documents"), PROFILED)


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS \"column\", row_number() OVER (ORDER BY n DESC, value) AS rank, value, n, CAST(floor(n * 10000 / sum(n) OVER ()) AS BIGINT) AS share FROM (SELECT {c} AS value, count(*) AS n FROM documents GROUP BY 1)) WHERE rank <= 5" for c in ("lang", "source")))
def top_values(spark, d):
    return profile.top_values(table(spark, d, "documents"), PROFILED)


@query("""SELECT * FROM (SELECT 's_name' AS "column", row_number() OVER (ORDER BY s_suppkey) AS position, s_name AS sample FROM supplier) WHERE position <= 5 UNION ALL SELECT * FROM (SELECT 'full_name', row_number() OVER (ORDER BY s_suppkey) AS position, upper(substr(s_name, 1, 1)) || '***' FROM supplier) WHERE position <= 5
UNION ALL SELECT * FROM (SELECT 'phone', row_number() OVER (ORDER BY s_suppkey) AS position, '***-' || right('0000' || s_suppkey, 4) FROM supplier) WHERE position <= 5 UNION ALL SELECT * FROM (SELECT 'email', row_number() OVER (ORDER BY s_suppkey) AS position, 's***@x.org' FROM supplier) WHERE position <= 1""")
def samples_masked(spark, d):
    """Names, phone numbers and e-mails are masked by what their column is called."""
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_name").alias("full_name"), F.concat(F.lit("call ext "), F.lpad(F.col("s_suppkey").cast("string"), 4, "0")).alias("phone"), F.lit("sales team@x.org").alias("email"))
    return profile.first_samples(rows, ["s_name", "full_name", "phone", "email"], "s_suppkey")


@query("SELECT event_id, regexp_replace(regexp_replace(regexp_replace(event_type || '-' || user_id, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '#', 'g') AS shape FROM events")
def shape_tokens(spark, d):
    from dimtrail.functions.text import shape_token

    return table(spark, d, "events").select("event_id", shape_token(F.concat("event_type", F.lit("-"), F.col("user_id").cast("string"))).alias("shape"))


@query("SELECT 'a' AS \"column\", 'YYYY-MM-DD' AS pattern, least(count(*), 100) AS n FROM orders UNION ALL SELECT 'b', CASE WHEN dd > 12 THEN 'DD/MM/YYYY' WHEN dd <> mm THEN 'AMBIGUOUS' ELSE 'MM/DD/YYYY' END, count(*) FROM (SELECT day(o_orderdate) AS dd, month(o_orderdate) AS mm FROM orders ORDER BY o_orderkey LIMIT 100) GROUP BY 2")
def date_patterns(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("a"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("b"))
    return profile.date_patterns(rows, ["a", "b"], "o_orderkey")


MAPPING = (
    onboarding.FieldMapping("customer_id", ("cust_no",), (("TRIM", None),)),
    onboarding.FieldMapping("first_name", ("first",), (("TRIM", None),)),
    onboarding.FieldMapping("last_name", ("last",), (("TRIM", None),)),
    onboarding.FieldMapping("email", ("mail",), (("NORMALIZE_EMAIL", None),)),
    onboarding.FieldMapping("date_of_birth", ("dob",), (("PARSE_DATE", "%Y-%m-%d"),)),
    onboarding.FieldMapping("status", ("state",), (("MAP_ENUM", {"A": "ACTIVE", "P": "PENDING"}), ("UPPERCASE", None))),
    onboarding.FieldMapping("created_at", ("signup",), (("PARSE_DATE", "%Y-%m-%d"),)),
)


def _mapped(spark, d) -> DataFrame:
    return onboarding.apply_mapping(x4_feed(spark, d), MAPPING, "row_no")


def _validated(spark, d) -> DataFrame:
    return onboarding.validate_records(_mapped(spark, d), TODAY)


@query(f"WITH {X4} SELECT row_no AS row_index, customer_id, first_name, last_name, email, date_of_birth, status, created_at, CASE WHEN bad_date THEN CAST(1 AS BIGINT) ELSE 0 END AS n_errors FROM mapped")
def mapped_feed(spark, d):
    return _mapped(spark, d).withColumn("n_errors", F.size("errors").cast("bigint")).drop("errors")


@query(f"WITH {X4} SELECT row_no AS row_index, rule_id, field FROM errors")
def record_errors(spark, d):
    return _validated(spark, d).select("row_index", F.inline("errors")).select("row_index", "rule_id", "field")


@query(f"WITH {X4} SELECT row_no AS row_index, customer_id, first_name, last_name, email, date_of_birth, status, created_at FROM mapped WHERE row_no NOT IN (SELECT row_no FROM errors)")
def valid_records(spark, d):
    return onboarding.valid_records(_validated(spark, d))


@query(f"WITH {X4} SELECT rule_id, count(*) AS n FROM errors GROUP BY rule_id")
def violations_by_rule(spark, d):
    return onboarding.violations_by_rule(_validated(spark, d))


def _exceptions(spark, d) -> DataFrame:
    return onboarding.to_exceptions(_validated(spark, d), "crm", "run1")


EXCEPTIONS = f"WITH {X4}, x AS (SELECT DISTINCT regexp_replace('crm-' || e.row_no || '-' || m.customer_id || '-' || rule_id || '-' || field, '[^A-Za-z0-9_-]', '_', 'g') AS exception_id, e.row_no AS row_index, rule_id, field, rule_id IN ('CUSTOMER_ID_REQUIRED', 'CUSTOMER_ID_DUPLICATE') AS protected FROM errors e JOIN mapped m USING (row_no))"


@query(f"""{EXCEPTIONS} SELECT exception_id, row_index, rule_id, field, CASE WHEN rule_id LIKE '%REQUIRED' OR rule_id IN ('EMAIL_FORMAT', 'STATUS_ENUM') THEN 'VALIDATION_ERROR' WHEN rule_id = 'INVALID_DATE' THEN 'TRANSFORMATION_ERROR' WHEN rule_id = 'DOB_IN_FUTURE' THEN 'BUSINESS_RULE_ERROR' ELSE 'DUPLICATE_ERROR' END AS category,
CASE WHEN rule_id LIKE '%REQUIRED' THEN 'Give a value for the field.' WHEN rule_id = 'INVALID_DATE' THEN 'Write the date as YYYY-MM-DD.' WHEN rule_id = 'DOB_IN_FUTURE' THEN 'Give a date that is not in the future.' WHEN rule_id = 'EMAIL_FORMAT' THEN 'Give a valid e-mail address.' WHEN rule_id = 'STATUS_ENUM' THEN 'Use one of the allowed values.' ELSE 'Keep one record or give another key.' END AS suggestion,
CASE field WHEN 'email' THEN '<MASKED_EMAIL>' WHEN 'date_of_birth' THEN CAST(date_of_birth AS VARCHAR) WHEN 'status' THEN status ELSE customer_id END AS observed, protected FROM x JOIN mapped ON row_no = row_index""")
def exceptions(spark, d):
    return _exceptions(spark, d).select("exception_id", "row_index", "rule_id", "field", "category", "suggestion", "observed", "protected")


def _corrections(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    one = table(spark, d, "customer").where(k % 29 == 0).select(k.alias("row_index"), F.lit("dob").alias("field"), F.lit("1970-01-02").alias("value"), F.lit("2025-01-01").cast("timestamp").alias("at"))
    two = table(spark, d, "customer").where(k % 58 == 0).select(k.alias("row_index"), F.lit("dob").alias("field"), F.lit("1970-01-03").alias("value"), F.lit("2025-01-02").cast("timestamp").alias("at"))
    return one.unionByName(two)


@query(f"WITH {X4} SELECT row_no AS row_index, CASE WHEN row_no % 58 = 0 THEN DATE '1970-01-03' ELSE DATE '1970-01-02' END AS date_of_birth, email FROM mapped WHERE row_no % 29 = 0")
def corrected_records(spark, d):
    fixed = onboarding.apply_corrections(x4_feed(spark, d), "row_no", _corrections(spark, d))
    return onboarding.apply_mapping(fixed, MAPPING, "row_no").select("row_index", "date_of_birth", "email")


@query(f"{EXCEPTIONS} SELECT exception_id, CASE WHEN row_index % 2 = 0 THEN 'RESOLVED' WHEN NOT protected THEN 'DISMISSED' ELSE 'OPEN' END AS status, CASE WHEN row_index % 2 = 0 THEN CAST(0 AS BIGINT) WHEN protected THEN 1 ELSE 0 END AS refused FROM x")
def exception_states(spark, d):
    found = _exceptions(spark, d)
    even = F.when(F.col("row_index") % 2 == 0, F.array(F.lit("CORRECTED"), F.lit("RESOLVED"))).otherwise(F.array(F.lit("DISMISSED")))
    events = found.select("exception_id", F.posexplode(even).alias("p", "status")).select("exception_id", "status", F.timestamp_seconds(F.col("p") + 1_700_000_000).alias("at"))
    return onboarding.exception_states(found, events)


FEED = ("cust_no", "first", "last", "mail", "dob", "state", "signup")
RULES = {f.name: f for f in onboarding.CUSTOMER_V1}


def _ratios(pairs) -> str:
    """The library's name ratios as SQL rows: SQL has no such function, so its scores take them as input."""
    from difflib import SequenceMatcher

    plain = lambda s: s.replace("_", " ")
    return ", ".join(f"('{a}', '{b}', CAST({SequenceMatcher(None, plain(a), plain(b)).ratio()!r} AS DOUBLE))" for a, b in pairs)


def _texts(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


SIGNALS = " UNION ALL ".join(f"""SELECT '{c}' AS source_field, 'string' AS type, (SELECT count(DISTINCT {c}) / count({c}) FROM feed) AS uniqueness,
 (SELECT bool_or(contains(v, '@')) FROM (SELECT {c} AS v FROM feed GROUP BY 1 ORDER BY min(row_no) LIMIT 5)) AS has_at,
 (SELECT bool_or(regexp_matches(trim(v), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')) FROM (SELECT {c} AS v FROM feed ORDER BY row_no LIMIT 100)) AS has_date,
 (SELECT CASE WHEN (SELECT count(DISTINCT {c}) FROM feed) <= 25 THEN list(upper(v)) ELSE [] END FROM (SELECT {c} AS v FROM feed GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)) AS top""" for c in FEED)
FIELDS = ", ".join(f"({i}, '{f.name}', '{f.type}', {str(f.required).upper()}, {str(f.unique).upper()}, {_texts(f.allowed)}, {_texts((f.name, *onboarding.ALIASES[f.name]))}, '{onboarding.NAME_PARTS.get(f.name, '')}')" for i, f in enumerate(onboarding.CUSTOMER_V1))
SCORED = f"""{X4}, signals AS ({SIGNALS}),
fields(place, target, wanted, required, is_key, allowed, aliases, parts) AS (VALUES {FIELDS}),
ratios(source_field, target, ratio) AS (VALUES {_ratios((c, f) for c in FEED for f in RULES)}),
pairs AS (SELECT *, list_contains(aliases, source_field) AS known FROM signals CROSS JOIN fields JOIN ratios USING (source_field, target)),
raw AS (SELECT source_field, target, place, greatest(0e0, least(1e0, CASE WHEN known THEN 85e-2 ELSE 7e-1 * ratio END
  + CASE WHEN type = wanted OR wanted = 'string' OR wanted IN ('date', 'datetime') AND type IN ('date', 'datetime', 'string') OR wanted = 'enum' AND type IN ('string', 'integer') THEN 1e-1 ELSE -3e-1 END
  + CASE WHEN is_key AND uniqueness = 1 THEN 15e-2 WHEN is_key AND uniqueness < 8e-1 THEN -5e-1 ELSE 0e0 END
  + CASE WHEN target = 'email' AND (has_at OR contains(source_field, 'email')) THEN 2e-1 ELSE 0e0 END
  + CASE WHEN wanted IN ('date', 'datetime') AND (type IN ('date', 'datetime') OR has_date) THEN 15e-2 ELSE 0e0 END
  + CASE WHEN list_has_any(top, allowed) THEN 2e-1 ELSE 0e0 END
  + CASE WHEN parts <> '' AND NOT known AND NOT regexp_matches(source_field, parts) THEN -3e-1 ELSE 0e0 END)) AS score FROM pairs),
candidates AS (SELECT source_field, target, place, round_even(score, 2) AS score FROM raw WHERE score >= 35e-2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_field ORDER BY score DESC, place) AS r FROM candidates) WHERE r = 1),
proposed AS (SELECT s.source_field, CASE WHEN score >= 4e-1 THEN target ELSE 'UNMAPPED' END AS target, CASE WHEN score >= 4e-1 THEN score ELSE 9e-1 END AS score FROM signals s LEFT JOIN best USING (source_field)),
proposals AS (SELECT *, target <> 'UNMAPPED' AND count(*) OVER (PARTITION BY target) > 1 AS ambiguous FROM proposed)"""


def _proposals(spark, d) -> DataFrame:
    columns = onboarding.column_signals(x4_feed(spark, d), "row_no")
    return onboarding.propose_mapping(columns, onboarding.mapping_candidates(columns))


@query(f"WITH {SCORED} SELECT source_field, target, score FROM candidates")
def mapping_candidates(spark, d):
    return onboarding.mapping_candidates(onboarding.column_signals(x4_feed(spark, d), "row_no")).drop("place")


@query(f"WITH {SCORED} SELECT * FROM proposals")
def mapping_proposals(spark, d):
    return _proposals(spark, d)


@query(f"WITH {SCORED} SELECT 'unmapped_required' AS finding, target FROM fields WHERE required AND target NOT IN (SELECT target FROM proposals) UNION ALL SELECT DISTINCT 'ambiguous_target', target FROM proposals WHERE ambiguous")
def mapping_checks(spark, d):
    return onboarding.mapping_findings(_proposals(spark, d))


@query(f"WITH {SCORED}, labels(source_field, expected) AS (VALUES ('cust_no', 'customer_id'), ('first', 'first_name'), ('last', 'last_name'), ('mail', 'email'), ('dob', 'date_of_birth'), ('state', 'status'), ('signup', 'created_at')) SELECT count(*) AS labelled, count(*) FILTER (WHERE target = expected) AS correct, count(*) FILTER (WHERE target = 'UNMAPPED') AS unmapped, count(*) FILTER (WHERE ambiguous) AS ambiguous FROM labels LEFT JOIN proposals USING (source_field)")
def mapping_accuracy(spark, d):
    labels = spark.createDataFrame([(m.sources[0], m.target) for m in MAPPING], "source_field string, expected string")
    return onboarding.mapping_accuracy(_proposals(spark, d), labels)


def _registries(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two versions of the feed: mail renamed, state gone, signup retyped, first with blanks, a score added."""
    feed = x4_feed(spark, d).drop("row_no")
    later = feed.withColumnRenamed("mail", "E-Mail").drop("state").withColumn("signup", F.to_date("signup")).withColumn("first", F.when(F.col("last").startswith("Lee0"), None).otherwise(F.col("first"))).withColumn("Score", F.lit(1))
    return drift.snapshot_schema(feed, "crm", 1), drift.snapshot_schema(later, "crm", 2)


def _registry_sql(columns: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{slug}' AS slug, CASE typeof(any_value({e})) WHEN 'VARCHAR' THEN 'string' WHEN 'DATE' THEN 'date' WHEN 'INTEGER' THEN 'integer' END AS type, count(*) FILTER (WHERE {e} IS NULL OR trim(CAST({e} AS VARCHAR)) = '') > 0 AS nullable FROM feed" for slug, e in columns.items())


DRIFT = f"""{X4}, a AS ({_registry_sql({c: c for c in FEED})}),
b AS ({_registry_sql({"cust_no": "cust_no", "first": "CASE WHEN last LIKE 'Lee0%' THEN NULL ELSE first END", "last": "last", "e_mail": "mail", "dob": "dob", "signup": "CAST(signup AS DATE)", "score": "1"})}),
joined AS (SELECT slug, a.type AS t1, b.type AS t2, a.nullable AS n1, b.nullable AS n2 FROM a FULL JOIN b USING (slug)),
events AS (SELECT 'crm' AS source, slug, 'ADDED' AS event, NULL AS old, t2 AS new FROM joined WHERE t1 IS NULL UNION ALL SELECT 'crm', slug, 'REMOVED', t1, NULL FROM joined WHERE t2 IS NULL
 UNION ALL SELECT 'crm', slug, 'TYPE_CHANGED', t1, t2 FROM joined WHERE t1 <> t2 UNION ALL SELECT 'crm', slug, 'NULLABILITY_CHANGED', CAST(n1 AS VARCHAR), CAST(n2 AS VARCHAR) FROM joined WHERE n1 <> n2),
mapping(slug, target, wanted, required) AS (VALUES {", ".join(f"('{m.sources[0]}', '{m.target}', '{RULES[m.target].type}', {str(RULES[m.target].required).upper()})" for m in MAPPING)}),
ranked AS (SELECT m.slug, m.target, coalesce(max(CASE WHEN event = 'REMOVED' THEN 2 WHEN event = 'TYPE_CHANGED' THEN CASE WHEN new = wanted OR wanted = 'string' OR wanted IN ('date', 'datetime') AND new IN ('date', 'datetime', 'string') OR wanted = 'enum' AND new IN ('string', 'integer') THEN 1 ELSE 2 END
  WHEN event = 'NULLABILITY_CHANGED' AND required AND new = 'true' THEN 1 ELSE 0 END), 0) AS rank FROM mapping m LEFT JOIN events e USING (slug) GROUP BY 1, 2),
worst AS (SELECT max(rank) AS rank FROM ranked), counts AS (SELECT count(*) FILTER (WHERE event = 'ADDED') AS x1, count(*) FILTER (WHERE event = 'REMOVED') AS x2, count(*) FILTER (WHERE event = 'TYPE_CHANGED') AS x3, count(*) FILTER (WHERE event = 'NULLABILITY_CHANGED') AS x4 FROM events)"""


@query(f"WITH {DRIFT} SELECT * FROM events")
def schema_diff(spark, d):
    return drift.diff_schema(*_registries(spark, d))


def _impact(spark, d) -> tuple[DataFrame, DataFrame]:
    events = drift.diff_schema(*_registries(spark, d))
    mapping = spark.createDataFrame([("crm", m.sources[0], m.target, RULES[m.target].type, RULES[m.target].required) for m in MAPPING], "source string, slug string, target string, wanted string, required boolean")
    return events, drift.mapping_impact(events, mapping)


@query(f"WITH {DRIFT} SELECT 'crm' AS source, slug, target, CASE rank WHEN 2 THEN 'BROKEN' WHEN 1 THEN 'REVIEW' ELSE 'COMPATIBLE' END AS impact FROM ranked")
def mapping_impact(spark, d):
    return _impact(spark, d)[1]


@query(f"WITH {DRIFT} SELECT 'crm' AS source, CASE rank WHEN 2 THEN 'BROKEN' WHEN 1 THEN 'REVIEW' ELSE 'COMPATIBLE' END AS overall, rank > 0 AS needs_review, x1 || ' added, ' || x2 || ' removed, ' || x3 || ' type_changed, ' || x4 || ' nullability_changed' AS summary FROM worst, counts")
def drift_report(spark, d):
    return drift.drift_report(*_impact(spark, d))


@query(f"""WITH {DRIFT}, ratios(removed, added, ratio) AS (VALUES {_ratios((x, y) for x in FEED for y in ("e_mail", "score"))}), known(names) AS (VALUES {", ".join(f"({_texts((k, *v))})" for k, v in onboarding.ALIASES.items())}),
scored AS (SELECT r.slug AS removed, c.slug AS added, round_even(greatest(ratio, CASE WHEN EXISTS (SELECT 1 FROM known WHERE list_contains(names, r.slug) AND list_contains(names, c.slug)) THEN 88e-2 ELSE 0e0 END)
  - CASE WHEN c.new = r.old OR r.old = 'string' THEN 0e0 ELSE 25e-2 END, 4) AS score FROM events r, events c, ratios WHERE r.event = 'REMOVED' AND c.event = 'ADDED' AND ratios.removed = r.slug AND ratios.added = c.slug)
SELECT 'crm' AS source, removed, added, score FROM (SELECT *, row_number() OVER (PARTITION BY removed ORDER BY score DESC, added) AS r FROM scored WHERE score >= 6e-1) WHERE r = 1""")
def possible_renames(spark, d):
    return drift.possible_renames(_impact(spark, d)[0])

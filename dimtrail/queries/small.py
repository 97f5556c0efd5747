"""Queries of the operators that no other query runs alone."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from dimtrail.functions import text
from dimtrail.operators import containment, contracts, guardrail, history, keys, metrics, profile
from dimtrail.queries.files import scratch
from dimtrail.queries.fixtures import X2, X3, X4, table, x2_history, x4_feed
from dimtrail.queries.judging import _evidence
from dimtrail.sources import readers

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15 08:30:00'")
def rows_since(spark, d):
    """Rows after a time alone, for sources without a cursor on keys."""
    return keys.page_after(table(spark, d, "events"), "ts", [], {"ts": "2024-01-15 08:30:00"}).select("event_id")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, user_id, event_id) AS place FROM events")
def all_rows_in_order(spark, d):
    """A whole source in (time, keys) order, numbered as it comes."""
    ordered = keys.page_after(table(spark, d, "events"), "ts", ["user_id", "event_id"], None)
    return keys.with_sorted_ordinal(ordered.select("event_id"), scratch(spark), "at").select("event_id", (F.col("at") + 1).alias("place"))


@query("SELECT c_name AS name, c_mktsegment AS segment, NULL AS nation FROM customer UNION ALL SELECT s_name, NULL, s_nationkey FROM supplier")
def union_of_feeds(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return readers.union_feeds(customers, table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))).select("name", "segment", "nation")


_SAID = "CASE c_custkey % 6 WHEN 0 THEN ' ' || c_custkey || ' ' WHEN 1 THEN c_custkey || '.5' WHEN 2 THEN 'x' || c_custkey WHEN 3 THEN 'Yes' WHEN 4 THEN '' ELSE '0' END"


@query(f"""WITH t AS (SELECT c_custkey AS custkey, nullif(trim({_SAID}), '') AS v FROM customer) SELECT custkey, v AS as_string, CAST(trunc(try_cast(v AS DOUBLE)) AS BIGINT) AS as_integer, try_cast(v AS DOUBLE) AS as_float, CASE WHEN lower(v) IN ('true', '1', 't', 'yes', 'y') THEN TRUE WHEN lower(v) IN ('false', '0', 'f', 'no', 'n') THEN FALSE END AS as_boolean FROM t""")
def cast_values(spark, d):
    said = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.expr(_SAID).alias("v"))
    return said.select("custkey", *[text.cast_text("v", k).alias(f"as_{k}") for k in ("string", "integer", "float", "boolean")])


@query("""WITH t AS (SELECT c_custkey AS custkey, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE ' ' || c_name END AS a, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS b FROM customer)
SELECT custkey, nullif(concat_ws('-', nullif(trim(a), ''), b), '') AS skipped, concat_ws('-', coalesce(nullif(trim(a), ''), ''), coalesce(b, '')) AS kept, CASE WHEN trim(a) <> '' AND b IS NOT NULL THEN trim(a) || '-' || b END AS failed FROM t""")
def concat_values(spark, d):
    """Joined values: blanks left out, kept, or failing the whole."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(k.alias("custkey"), F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit(" "), "c_name")).alias("a"), F.when(k % 5 == 0, None).otherwise(F.col("c_mktsegment")).alias("b"))
    return rows.select("custkey", *[text.concat_fields(("a", "b"), "-", how).alias(name) for how, name in (("skip", "skipped"), ("empty", "kept"), ("fail", "failed"))])


@query("""WITH t AS (SELECT c_custkey AS custkey, CASE c_custkey % 3 WHEN 0 THEN lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '-12-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') WHEN 1 THEN NULL ELSE c_name END AS v FROM customer)
SELECT custkey, CASE WHEN v IS NOT NULL THEN '***-**-1234' END AS masked, CASE custkey % 3 WHEN 0 THEN '<SSN>' WHEN 2 THEN regexp_replace(regexp_replace(regexp_replace(v, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '#', 'g') END AS shape FROM t""")
def masked_ssn(spark, d):
    k = F.col("c_custkey")
    number = F.concat(F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("-12-"), F.lpad((k % 10000).cast("string"), 4, "0"))
    rows = table(spark, d, "customer").select(k.alias("custkey"), F.when(k % 3 == 0, number).when(k % 3 == 1, None).otherwise(F.col("c_name")).alias("v"))
    return rows.select("custkey", text.sample_value("v", "masked", "ssn").alias("masked"), text.sample_value("v", "shape_only").alias("shape"))


@query("SELECT o_orderkey AS orderkey, CAST(o_orderdate AS TIMESTAMP) AS at FROM orders")
def utc_times(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), text.to_utc(F.col("o_orderdate").cast("date")).cast("timestamp_ntz").alias("at"))


@query(f"WITH {X2} SELECT custkey, effective_from, row_number() OVER (ORDER BY custkey NULLS FIRST, effective_from NULLS FIRST) AS place FROM history")
def history_in_order(spark, d):
    """The canonical order of a history, numbered as it comes."""
    ordered = history.sorted_history(x2_history(spark, d), ["custkey"]).select("custkey", "effective_from")
    return keys.with_sorted_ordinal(ordered, scratch(spark), "at").select("custkey", "effective_from", (F.col("at") + 1).alias("place"))


@query("SELECT c_custkey AS custkey, c_name AS name, DATE '2020-01-01' AS effective_from, DATE '2020-01-01' AS effective_to, TRUE AS is_current FROM customer WHERE FALSE")
def empty_history(spark, d):
    """No source rows on no history: no rows, with all columns and types."""
    none = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name")).where("false")
    return history.apply_history(none, none.selectExpr("*", "date'2020-01-01' AS effective_from", "cast(null AS date) AS effective_to", "true AS is_current"), ["custkey"], ["name"], datetime.date(2020, 1, 1))


@query(f"WITH {X4}, said AS (SELECT unnest(['row_no', 'cust_no', 'dob', 'state']) AS c, unnest([count(*) FILTER (row_no IS NULL), count(*) FILTER (trim(cust_no) = ''), count(*) FILTER (trim(dob) = ''), count(*) FILTER (trim(state) = '')]) AS n FROM feed) SELECT c AS \"column\", CASE c WHEN 'row_no' THEN 'bigint' ELSE 'string' END AS type, c = 'row_no' AS of_key, n > 0 AS nullable FROM said")
def derived_contract(spark, d):
    """The contract that a feed fulfils."""
    made = contracts.derive_contract(x4_feed(spark, d), ["row_no"], ["cust_no", "dob", "state"])
    return spark.createDataFrame([(c, t, c in made.key, c in made.nullable) for c, t in made.columns], "column string, type string, of_key boolean, nullable boolean")


@query("SELECT event_id AS run_id, event_type AS status FROM events WHERE user_id % 7 = 3 AND event_id <> (SELECT max(event_id) FROM events WHERE user_id % 7 = 3)")
def runs_without_one(spark, d):
    """The runs of one fingerprint, but for one that is deleted."""
    runs = table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("status"), (F.col("user_id") % 7).cast("string").alias("fingerprint"))
    found = metrics.find_runs(runs, "3")
    last = found.agg(F.max("run_id")).first()[0]
    return metrics.without_run(found, last).select("run_id", "status")


@query("SELECT event_id, ts, (SELECT count(*) FROM events WHERE event_type = 'error') AS total FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")
def page_of_runs(spark, d):
    """The third page of twenty, with the number of all rows."""
    errors = table(spark, d, "events").where("event_type = 'error'").select("event_id", "ts")
    return containment.page_with_total(errors, "ts", "event_id", 20, 40)


@query(f"WITH {X3} SELECT day, changed > CASE WHEN CAST(extract(day FROM day) AS BIGINT) % 2 = 0 THEN 3 ELSE 1000 END AS fired FROM judged")
def thresholds_of_monitors(spark, d):
    """Several monitors at once, each with a limit of its own."""
    limits = _evidence(spark, d).withColumn("limit_changed", F.when(F.dayofmonth("day") % 2 == 0, 3).otherwise(1000))
    return guardrail.decide(limits).select("day", F.array_contains("rules", "HIGH_CHANGE_VOLUME").alias("fired"))


@query("SELECT * EXCLUDE (c_custkey, c_nationkey) FROM customer")
def columns_without_secrets(spark, d):
    return profile.without_secrets(table(spark, d, "customer"))


@query(f"WITH {X4} SELECT cust_no, mail FROM feed JOIN (SELECT row_no AS n FROM errors WHERE rule_id = 'EMAIL_FORMAT') ON n = row_no")
def source_rows_of_keys(spark, d):
    """A source's rows of some keys."""
    wanted = table(spark, d, "customer").where(F.col("c_custkey") % 23 == 0).select(F.col("c_custkey").alias("row_no"))
    return history.versions_of(x4_feed(spark, d), wanted, ["row_no"]).select("cust_no", "mail")

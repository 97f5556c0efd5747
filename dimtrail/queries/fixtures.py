"""Inputs of the registered queries, derived from the shared tables; each with the same input as SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dimtrail.operators.history import versions_from_events
from dimtrail.operators.keys import latest_per_key

KEY, TRACKED = ["custkey"], ["segment", "nation", "cents"]
DATE = datetime.date(1996, 1, 1)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _customer(spark: SparkSession, d: str) -> DataFrame:
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"), cents.alias("cents"))


def x1_target(spark: SparkSession, d: str) -> DataFrame:
    base = _customer(spark, d).where("custkey % 20 <> 0")
    now = base.selectExpr("*", "date'1995-01-01' as effective_from", "cast(null as date) as effective_to", "true as is_current")
    old = base.where("custkey % 10 = 0").selectExpr("custkey", "concat('OLD_', segment) as segment", "nation", "cents", "date'1994-01-01' as effective_from", "date'1995-01-01' as effective_to", "false as is_current")
    more = base.where("custkey % 10 = 1").selectExpr("custkey", "concat('OLD_', segment) as segment", "nation", "cents", "date'1994-01-01' as effective_from", "date'1994-06-01' as effective_to", "false as is_current")
    return now.unionByName(old).unionByName(more)


def x1_source(spark: SparkSession, d: str) -> DataFrame:
    return _customer(spark, d).where("custkey % 20 <> 1").withColumn("segment", F.when(F.col("custkey") % 20 == 11, F.concat("segment", F.lit("_X"))).otherwise(F.col("segment")))


def x1b_source(spark: SparkSession, d: str) -> DataFrame:
    """The same source with blanks around its text; it must classify alike."""
    return x1_source(spark, d).withColumn("segment", F.concat(F.lit(" \t"), "segment", F.lit("  "))).withColumn("nation", F.concat("nation", F.lit(" \n")))


X1 = """
base AS (SELECT c_custkey AS custkey, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation, CAST(round(c_acctbal * 100) AS BIGINT) AS cents FROM customer),
target AS (
  SELECT *, DATE '1995-01-01' AS effective_from, CAST(NULL AS DATE) AS effective_to, TRUE AS is_current FROM base WHERE custkey % 20 <> 0
  UNION ALL SELECT custkey, 'OLD_' || segment, nation, cents, DATE '1994-01-01', DATE '1995-01-01', FALSE FROM base WHERE custkey % 20 <> 0 AND custkey % 10 = 0
  UNION ALL SELECT custkey, 'OLD_' || segment, nation, cents, DATE '1994-01-01', DATE '1994-06-01', FALSE FROM base WHERE custkey % 20 <> 0 AND custkey % 10 = 1),
source AS (SELECT custkey, segment || CASE WHEN custkey % 20 = 11 THEN '_X' ELSE '' END AS segment, nation, cents FROM base WHERE custkey % 20 <> 1),
cur AS (SELECT * FROM target WHERE is_current),
classed AS (
  SELECT coalesce(s.custkey, t.custkey) AS custkey, s.segment AS new_segment, t.segment AS old_segment,
    CASE WHEN t.custkey IS NULL THEN 'NEW' WHEN s.custkey IS NULL THEN 'DELETED'
      WHEN s.segment IS DISTINCT FROM t.segment OR s.nation IS DISTINCT FROM t.nation OR s.cents IS DISTINCT FROM t.cents THEN 'CHANGED' ELSE 'UNCHANGED' END AS change_type
  FROM cur t FULL JOIN source s ON s.custkey = t.custkey)
"""


def x1c(spark: SparkSession, d: str) -> DataFrame:
    """X1's target with faults put in by modulus."""
    k = F.col("custkey")
    current, closed = F.col("is_current"), ~F.col("is_current")
    df = x1_target(spark, d)
    df = df.withColumn("effective_to", F.when(closed & (k % 70 == 0), F.lit(datetime.date(1993, 6, 1))).when(closed & (k % 110 == 0), F.col("effective_from")).when(closed & (k % 130 == 0), F.lit(datetime.date(1995, 6, 1))).when(closed & (k % 170 == 0), None).when(current & (k % 190 == 0), F.lit(datetime.date(1999, 1, 1))).otherwise(F.col("effective_to")))
    df = df.withColumn("is_current", F.when(closed & (k % 230 == 0), True).otherwise(F.col("is_current")))
    return df.withColumn("custkey", F.when(k % 290 == 0, None).otherwise(k))


X1C = X1 + """,
f1 AS (SELECT custkey, segment, nation, cents, effective_from, is_current, CASE
    WHEN NOT is_current AND custkey % 70 = 0 THEN DATE '1993-06-01' WHEN NOT is_current AND custkey % 110 = 0 THEN effective_from
    WHEN NOT is_current AND custkey % 130 = 0 THEN DATE '1995-06-01' WHEN NOT is_current AND custkey % 170 = 0 THEN NULL
    WHEN is_current AND custkey % 190 = 0 THEN DATE '1999-01-01' ELSE effective_to END AS effective_to FROM target),
bad AS (SELECT CASE WHEN custkey % 290 = 0 THEN NULL ELSE custkey END AS custkey, segment, nation, cents, effective_from, effective_to,
    CASE WHEN NOT is_current AND custkey % 230 = 0 THEN TRUE ELSE is_current END AS is_current FROM f1),
pairs AS (SELECT * FROM (SELECT custkey, effective_from, effective_to, lag(effective_from) OVER w AS prev_from, lag(effective_to) OVER w AS prev_to, row_number() OVER w AS n
    FROM bad WHERE custkey IS NOT NULL WINDOW w AS (PARTITION BY custkey ORDER BY effective_from NULLS LAST, effective_to NULLS LAST)) WHERE n > 1)
"""


def x2_history(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("orderkey"))
    return versions_from_events(orders, ["custkey"], "at", ["priority"], "orderkey")


X2 = """
daily AS (SELECT o_custkey AS custkey, CAST(o_orderdate AS DATE) AS effective_from, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY 1, 2),
history AS (SELECT custkey, priority, effective_from, lead(effective_from) OVER (PARTITION BY custkey ORDER BY effective_from) AS effective_to FROM daily)
"""


def x3_rows(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user and day."""
    e = table(spark, d, "events").select(F.col("ts").cast("date").alias("day"), "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", F.round(F.col("value") * 100).cast("bigint").alias("cents"), "event_id")
    return latest_per_key(e, ["day", "user_id"], "ts", ["event_id"])


def x3_changes(spark: SparkSession, d: str) -> DataFrame:
    """Every day's rows as a batch against the rows that its users had before."""
    w = Window.partitionBy("user_id").orderBy("day")
    rows = x3_rows(spark, d).withColumn("old_type", F.lag("event_type").over(w)).withColumn("old_cents", F.lag("cents").over(w)).withColumn("n", F.row_number().over(w))
    diff = lambda c, old, new: F.when(~old.eqNullSafe(new), F.struct(F.lit(c).alias("column"), old.cast("string").alias("old_value"), new.cast("string").alias("new_value")))
    changes = F.when(F.col("n") == 1, F.array().cast("array<struct<column:string,old_value:string,new_value:string>>")).otherwise(F.array_compact(F.array(diff("event_type", F.col("old_type"), F.col("event_type")), diff("cents", F.col("old_cents"), F.col("cents")))))
    rows = rows.withColumn("field_changes", changes)
    kind = F.when(F.col("n") == 1, "NEW").when(F.size("field_changes") > 0, "CHANGED").otherwise("UNCHANGED")
    return rows.select("day", "user_id", "ts", kind.alias("change_type"), "field_changes")


X3 = """
x3 AS (SELECT day, user_id, ts, event_type, cents FROM (
  SELECT CAST(ts AS DATE) AS day, user_id, ts, event_type, CAST(round(value * 100) AS BIGINT) AS cents, row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1),
lagged AS (SELECT *, lag(event_type) OVER w AS old_type, lag(cents) OVER w AS old_cents, row_number() OVER w AS n FROM x3 WINDOW w AS (PARTITION BY user_id ORDER BY day)),
changed AS (SELECT *, CASE WHEN n = 1 THEN 'NEW' WHEN event_type <> old_type OR cents <> old_cents THEN 'CHANGED' ELSE 'UNCHANGED' END AS change_type FROM lagged),
counts AS (SELECT day, count(*) AS evaluated, count(*) FILTER (WHERE change_type = 'CHANGED') AS changed, count(*) FILTER (WHERE change_type = 'NEW') AS new_rows,
  count(DISTINCT CASE WHEN change_type <> 'UNCHANGED' THEN user_id END) AS spread, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM changed GROUP BY day),
swings AS (SELECT day, max(CASE WHEN old_cents > 0 THEN abs(cents - old_cents) / CAST(old_cents AS DOUBLE) WHEN old_cents = 0 AND cents <> 0 THEN abs(cents) ELSE 0 END) AS max_relative, max(abs(cents - old_cents)) AS max_absolute, CAST(sum(abs(cents - old_cents)) AS BIGINT) AS total_absolute
  FROM changed WHERE n > 1 AND cents <> old_cents GROUP BY day),
words AS (SELECT day, count(*) AS transitions FROM changed WHERE n > 1 AND event_type <> old_type GROUP BY day),
evidence AS (SELECT c.day, evaluated, changed, new_rows, CASE WHEN changed = 0 AND c.day = (SELECT min(day) FROM x3) THEN 0 ELSE changed + new_rows END AS mutated,
  CASE WHEN changed = 0 AND c.day = (SELECT min(day) FROM x3) THEN 0 ELSE spread END AS dispersion, coalesce(max_relative, 0) AS max_relative, coalesce(max_absolute, 0) AS max_absolute, coalesce(total_absolute, 0) AS total_absolute,
  coalesce(transitions, 0) AS transitions, changed / greatest(us / 1e6, 1.0) AS per_second FROM counts c LEFT JOIN swings s ON s.day = c.day LEFT JOIN words w ON w.day = c.day),
judged AS (SELECT *, list_filter([CASE WHEN changed >= 10 AND per_second > 50 THEN 'HIGH_CHANGE_VELOCITY' END, CASE WHEN changed > 25 THEN 'HIGH_CHANGE_VOLUME' END, CASE WHEN evaluated >= 10 AND round(mutated / CAST(evaluated AS DOUBLE), 4) > 0.8 THEN 'HIGH_POPULATION_IMPACT' END,
  CASE WHEN max_relative > 3.0 AND max_absolute >= 50 THEN 'LARGE_QUANTITY_SWING' END, CASE WHEN dispersion > 5 THEN 'WIDE_GEOGRAPHIC_IMPACT' END], lambda x: x IS NOT NULL) AS rules FROM evidence)
"""


def x4_feed(spark: SparkSession, d: str) -> DataFrame:
    """A messy customer feed; all columns are text."""
    k = F.col("c_custkey")
    text = k.cast("string")
    return table(spark, d, "customer").select(
        k.alias("row_no"),
        F.when(k % 37 == 0, "").when(k % 41 == 1, (k - 1).cast("string")).otherwise(F.concat(F.lit(" C"), text)).alias("cust_no"),
        F.concat(F.lit(" Ann"), text).alias("first"),
        F.concat(F.lit("Lee"), (k % 7).cast("string"), F.lit(" ")).alias("last"),
        F.when(k % 23 == 0, F.concat(F.lit("user"), text)).otherwise(F.concat(F.lit("User"), text, F.lit("@Example.com "))).alias("mail"),
        F.when(k % 29 == 0, "not a date").when(k % 31 == 0, "2999-01-01").otherwise(F.concat(F.lit("19"), (60 + k % 40).cast("string"), F.lit("-0"), (1 + k % 9).cast("string"), F.lit("-1"), (k % 10).cast("string"))).alias("dob"),
        F.when(k % 19 == 0, "zombie").when(k % 3 == 0, "a").when(k % 3 == 1, "P").otherwise("inactive").alias("state"),
        F.concat(F.lit("2024-0"), (1 + k % 9).cast("string"), F.lit("-15")).alias("signup"),
    )


X4 = """
feed AS (SELECT c_custkey AS row_no,
  CASE WHEN c_custkey % 37 = 0 THEN '' WHEN c_custkey % 41 = 1 THEN CAST(c_custkey - 1 AS VARCHAR) ELSE ' C' || c_custkey END AS cust_no, ' Ann' || c_custkey AS first, 'Lee' || (c_custkey % 7) || ' ' AS last,
  CASE WHEN c_custkey % 23 = 0 THEN 'user' || c_custkey ELSE 'User' || c_custkey || '@Example.com ' END AS mail,
  CASE WHEN c_custkey % 29 = 0 THEN 'not a date' WHEN c_custkey % 31 = 0 THEN '2999-01-01' ELSE '19' || (60 + c_custkey % 40) || '-0' || (1 + c_custkey % 9) || '-1' || (c_custkey % 10) END AS dob,
  CASE WHEN c_custkey % 19 = 0 THEN 'zombie' WHEN c_custkey % 3 = 0 THEN 'a' WHEN c_custkey % 3 = 1 THEN 'P' ELSE 'inactive' END AS state, '2024-0' || (1 + c_custkey % 9) || '-15' AS signup FROM customer),
mapped AS (SELECT row_no, trim(cust_no) AS customer_id, trim(first) AS first_name, trim(last) AS last_name, lower(trim(mail)) AS email, try_cast(dob AS DATE) AS date_of_birth,
  CASE lower(state) WHEN 'a' THEN 'ACTIVE' WHEN 'p' THEN 'PENDING' ELSE upper(state) END AS status, CAST(signup AS DATE) AS created_at, try_cast(dob AS DATE) IS NULL AS bad_date FROM feed),
marked AS (SELECT *, count(*) OVER (PARTITION BY customer_id) AS same_id FROM mapped),
errors AS (
  SELECT row_no, 'INVALID_DATE' AS rule_id, 'date_of_birth' AS field FROM marked WHERE bad_date
  UNION ALL SELECT row_no, 'CUSTOMER_ID_REQUIRED', 'customer_id' FROM marked WHERE customer_id = ''
  UNION ALL SELECT row_no, 'DOB_IN_FUTURE', 'date_of_birth' FROM marked WHERE date_of_birth > DATE '2025-06-01'
  UNION ALL SELECT row_no, 'EMAIL_FORMAT', 'email' FROM marked WHERE NOT contains(email, '@')
  UNION ALL SELECT row_no, 'STATUS_ENUM', 'status' FROM marked WHERE status NOT IN ('ACTIVE', 'INACTIVE')
  UNION ALL SELECT row_no, 'CUSTOMER_ID_DUPLICATE', 'customer_id' FROM marked WHERE customer_id <> '' AND same_id > 1)
"""

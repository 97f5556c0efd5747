"""Queries through files and streams: what is written comes back. Their scratch files lie beside the checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimtrail.operators import containment
from dimtrail.operators.changes import classify_changes
from dimtrail.operators.guardrail import Thresholds
from dimtrail.plans.pipeline import run_pipeline
from dimtrail.queries.fixtures import DATE, KEY, TRACKED, X1, X3, table, x1_source, x1_target, x3_rows
from dimtrail.queries.history import _history_sql
from dimtrail.sources import readers, sinks
from dimtrail.streaming.stream import HistoryStream, read_stream

QUERIES, ORACLES = {}, {}
PAGE_ROWS = 1000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="dimtrail-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@query(f"WITH {X1} SELECT custkey, segment, nation, cents, effective_from, effective_to, is_current FROM target")
def csv_roundtrip(spark, d):
    at = scratch(spark)
    sinks.export_csv(x1_target(spark, d), at)
    return readers.read_snapshot_csv(spark, at, "custkey bigint, segment string, nation string, cents bigint, effective_from string, effective_to string, is_current string")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier")
def delimited_sniff(spark, d):
    at = scratch(spark)
    table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")).write.option("header", True).option("sep", ";").csv(at)
    return readers.read_delimited(spark, at)


def _page(key: str):
    """Pages of PAGE_ROWS keys, however many there are."""
    return F.expr(f"({key} - 1) div {PAGE_ROWS}").alias("page")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier")
def json_envelope(spark, d):
    at = scratch(spark)
    rows = table(spark, d, "supplier").select(_page("s_suppkey"), F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).alias("r"))
    sinks.write_pages(rows.groupBy("page").agg(F.array_sort(F.collect_list("r")).alias("data")), at)
    return readers.read_json_records(spark, at, "data array<struct<id:bigint,name:string>>", lines=True)


@query("SELECT s_suppkey AS id FROM supplier ORDER BY s_suppkey LIMIT 7")
def paged_feed(spark, d):
    at = scratch(spark)
    rows = table(spark, d, "supplier").select(_page("s_suppkey"), F.struct(F.col("s_suppkey").alias("id")).alias("r"))
    sinks.write_pages(rows.groupBy("page").agg(F.array_sort(F.collect_list("r")).alias("data")), at)
    return readers.read_pages(spark, at, most=7, lines=True)


@query("""WITH p AS (SELECT s_suppkey AS id, s_suppkey // 5 AS page FROM supplier WHERE s_suppkey % 20 <> 19), n AS (SELECT page, count(*) AS n FROM p GROUP BY page)
SELECT id FROM p WHERE page <= (SELECT min(page) FROM n WHERE n < 5)""")
def chained_pages(spark, d):
    """Pages of five suppliers until the first short one; what lies behind it is no part of the feed."""
    at = scratch(spark)
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").where(k % 20 != 19).select(F.expr("s_suppkey div 5").alias("page"), F.struct(k.alias("id")).alias("r"))
    sinks.write_pages(rows.groupBy("page").agg(F.array_sort(F.collect_list("r")).alias("data")), at)
    return readers.read_pages(spark, at, page_size=5, lines=True)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, 'Café ' || n_name AS name, 'a;b' AS \"odd; header\" FROM nation")
def latin1_file(spark, d):
    """A file that isn't UTF-8, with a quoted header: its encoding is found from its bytes."""
    at = scratch(spark)
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.concat(F.lit("Café "), "n_name").alias("name"), F.lit("a;b").alias("odd; header"))
    rows.coalesce(1).write.options(header=True, sep=";", encoding="ISO-8859-1").csv(at)
    return readers.read_delimited(spark, at)


@query(_history_sql("'CHANGED', 'DELETED'"))
def parquet_history(spark, d):
    """The pipeline's promoted version, read back."""
    at = scratch(spark)
    run_pipeline(x1_source(spark, d), x1_target(spark, d), at, DATE, KEY, TRACKED)
    return sinks.read_history(spark, at)


@query(f"WITH {X1} SELECT custkey, change_type FROM classed WHERE change_type <> 'UNCHANGED'")
def change_log(spark, d):
    at = scratch(spark)
    changes = classify_changes(x1_source(spark, d), x1_target(spark, d), KEY, TRACKED).where("change_type != 'UNCHANGED'")
    sinks.write_change_log(changes, at)
    return sinks.read_change_log(spark, at, changes.schema).select("custkey", "change_type")


def _streamed(spark: SparkSession, d: str, late: bool, limits: Thresholds = Thresholds(enabled=False), buckets: tuple = (16, 16, 16)) -> HistoryStream:  # noqa: B008
    """The events of each ten days as one batch of a stream into a history; late: a tenth of the users come in the opposite order. buckets: of each batch."""
    at = scratch(spark)
    rows = x3_rows(spark, d).withColumn("part", F.floor((F.dayofmonth("day") - 1) / 10))
    if late:
        rows = rows.withColumn("part", F.when(F.col("user_id") % 10 == 3, 2 - F.col("part")).otherwise(F.col("part")))
    rows = rows.select("user_id", "event_type", "cents", "ts", F.col("part").cast("int").alias("part"))
    rows.write.partitionBy("part").parquet(f"{at}/days")  # the three batches from one pass over the events
    rows = spark.read.schema(rows.schema).parquet(f"{at}/days")
    for k in range(3):
        stream = HistoryStream(f"{at}/history", ["user_id"], ["event_type", "cents"], "ts", limits, "divert", buckets=buckets[k])
        rows.where(F.col("part") == k).drop("part").write.mode("append").parquet(f"{at}/in")
        stream.start(read_stream(spark, f"{at}/in", rows.drop("part").schema, None), f"{at}/checkpoint").awaitTermination()
    return stream


STREAMED = f"""{X3}, parts AS (SELECT *, floor((day(day) - 1) / 10) AS own FROM x3),
ranked AS (SELECT CAST(part AS INTEGER) AS part, user_id, event_type, cents, ts, row_number() OVER (PARTITION BY part, user_id ORDER BY ts DESC, event_type DESC, cents DESC) AS r FROM (SELECT *, {{part}} AS part FROM parts)),
latest AS (SELECT * FROM ranked WHERE r = 1)"""


VERSIONS = ["user_id", "event_type", "cents", "effective_from", "effective_to", "is_current"]
BEGUN = f"""{STREAMED.format(part="own")}, dates AS (SELECT part, CAST(max(ts) AS DATE) AS d FROM latest GROUP BY part),
told AS (SELECT l.*, d, lag(event_type) OVER w AS e, lag(cents) OVER w AS c, row_number() OVER w AS n FROM latest l JOIN dates USING (part) {{where}} WINDOW w AS (PARTITION BY user_id ORDER BY part)),
begun AS (SELECT user_id, event_type, cents, d, part FROM told WHERE n = 1 OR e <> event_type OR c <> cents)"""
ALL_VERSIONS = "SELECT user_id, event_type, cents, d AS effective_from, lead(d) OVER w AS effective_to, lead(d) OVER w IS NULL AS is_current FROM begun WINDOW w AS (PARTITION BY user_id ORDER BY d)"
#: Ten days change more users than these limits allow; the first batch is a bootstrap and passes.
STRICT = Thresholds(changed=10, ratio=2.0, relative=1e12, velocity=1e12, dispersion=1 << 40, deactivations=1 << 40)


@query(f"WITH {BEGUN.format(where='')} {ALL_VERSIONS}")
def stream_history(spark, d):
    return _streamed(spark, d, late=False).store(spark).read().select(*VERSIONS)


@query(f"WITH {BEGUN.format(where='')} {ALL_VERSIONS}")
def stream_rebucketed(spark, d):
    """The same with another number of buckets for every batch."""
    return _streamed(spark, d, late=False, buckets=(4, 16, 7)).store(spark).read().select(*VERSIONS)


@query(f"WITH {BEGUN.format(where='')} SELECT CAST(part AS VARCHAR) AS run_id, 'COMPLETED' AS status, count(*) AS seen, (SELECT count(*) FROM begun WHERE begun.part = latest.part) AS changed, CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS late FROM latest GROUP BY part")
def stream_runs(spark, d):
    """The run log that the stream writes: a batch writes as many delta rows as keys change."""
    return _streamed(spark, d, late=False).store(spark).runs().select("run_id", "status", "seen", "changed", "held", "late")


@query(f"WITH {BEGUN.format(where='')} {ALL_VERSIONS}")
def hold_released(spark, d):
    """The second and third batch are held, then released in order; releasing one again, and discarding it, change nothing."""
    store = _streamed(spark, d, late=False, limits=STRICT).store(spark)
    for hold in [r.hold_id for r in store.holds().where("status = 'HELD'").orderBy("hold_id").collect()]:
        store.release(hold)
        store.release(hold)
        try:
            store.discard(hold)
        except containment.HoldError:
            continue
        raise AssertionError("a released hold was discarded")
    return store.read().select(*VERSIONS)


@query(f"WITH {BEGUN.format(where='WHERE part <> 1')} {ALL_VERSIONS}")
def hold_discarded(spark, d):
    """The second batch is held and given up, the third one released: the history as it is stored has nothing of the second."""
    store = _streamed(spark, d, late=False, limits=STRICT).store(spark)
    second, third = [r.hold_id for r in store.holds().orderBy("hold_id").collect()]
    store.discard(second, advance=True)
    store.release(third)
    return store.read().select(*VERSIONS)


@query(f"""WITH {BEGUN.format(where='')}, held AS (SELECT part, count(*) AS n FROM latest WHERE part > 0 GROUP BY part), dates3 AS (SELECT max(ts) AS t FROM latest)
SELECT CAST(part AS VARCHAR) AS batch, CASE part WHEN 1 THEN 'DISCARDED' ELSE 'REPROCESSED' END AS status, n AS frozen, (SELECT t FROM dates3) AS cursor FROM held""")
def hold_store_states(spark, d):
    """The stored holds after one was discarded and one reprocessed by force; the frozen rows stay, the cursor is that of the last batch."""
    store = _streamed(spark, d, late=False, limits=STRICT).store(spark)
    second, third = [r.hold_id for r in store.holds().orderBy("hold_id").collect()]
    if store.reprocess(third) != containment.HELD:
        raise AssertionError("a batch as suspicious as before was let in")
    store.discard(second)
    store.reprocess(third, force=True)
    frozen = spark.read.parquet(f"{store.root}/held").groupBy("batch_id").agg(F.count("*").alias("frozen"))
    return store.holds().withColumn("batch", F.split("hold_id", "-")[0]).join(frozen, F.col("batch") == F.col("batch_id")).select("batch", "status", "frozen", F.lit(store.cursor()).cast("timestamp").alias("cursor"))


@query(f"""WITH {STREAMED.format(part="CASE WHEN user_id % 10 = 3 THEN 2 - own ELSE own END")},
b0 AS (SELECT user_id, event_type, cents, max(CAST(ts AS DATE)) OVER () AS begun FROM latest WHERE part = 0),
l1 AS (SELECT l.*, b.begun, b.event_type AS e, b.cents AS c, coalesce(CAST(ts AS DATE) < b.begun, FALSE) AS late FROM latest l LEFT JOIN b0 b USING (user_id) WHERE part = 1),
d1 AS (SELECT max(CAST(ts AS DATE)) AS d FROM l1 WHERE NOT late),
b1 AS (SELECT user_id, CASE WHEN l1.user_id IS NULL OR late OR (e = l1.event_type AND c = l1.cents) THEN b0.begun ELSE (SELECT d FROM d1) END AS begun FROM b0 FULL JOIN l1 USING (user_id)),
l2 AS (SELECT l.*, coalesce(CAST(ts AS DATE) < b.begun, FALSE) AS late FROM latest l LEFT JOIN b1 b USING (user_id) WHERE part = 2)
SELECT user_id, event_type, cents, CAST(part AS VARCHAR) AS batch_id FROM (SELECT user_id, event_type, cents, part, late FROM l1 UNION ALL SELECT user_id, event_type, cents, part, late FROM l2) WHERE late""")
def stream_late_rows(spark, d):
    return sinks.read_rows(spark, f"{_streamed(spark, d, late=True).root}/late").select("user_id", "event_type", "cents", "batch_id")

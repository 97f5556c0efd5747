"""Appended histories, run rows, landed streams and tables of a database."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from dimtrail.operators.history import HistoryError
from dimtrail.plans.appended import AppendedHistory
from dimtrail.plans.pipeline import run_pipeline
from dimtrail.sources import database, sinks
from dimtrail.sources.readers import SourceError
from dimtrail.streaming.landing import Landing
from dimtrail.streaming.stream import read_stream

D0, D1 = datetime.date(2024, 1, 1), datetime.date(2024, 2, 1)
ROWS = "id string, v string, effective_from date, effective_to date, is_current boolean"
DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def parts(spark, n):
    return [spark.createDataFrame([(f"k{i}", "x", D0, D1, False), (f"k{i}", "y", D1, None, True)], ROWS) for i in range(n)]


def test_parts_are_appended_once_and_merged(spark, tmp_path):
    store = AppendedHistory(spark, str(tmp_path), ["id"], fan_in=2)
    assert store.read() is None and store.log().count() == 0
    for i, part in enumerate(parts(spark, 5)):
        assert store.append(part, f"p{i}") == "APPENDED"
        assert store.append(part, f"p{i}") == "SEEN"
    assert sorted(tuple(r) for r in store.read().collect()) == sorted(tuple(r) for p in parts(spark, 5) for r in p.collect())
    levels = store.ledger.latest()[1]["parts"]
    assert all(len(level) < 2 for level in levels) and sum(map(len, levels)) == 2  # 5 parts: four in one, and one
    assert [(r.name, r.rows) for r in store.log().orderBy("at").collect()] == [(f"p{i}", 2) for i in range(5)]
    assert store.append(parts(spark, 1)[0].limit(0), "none") == "APPENDED" and store.read().count() == 10


@pytest.mark.parametrize(
    ("row", "fault"),
    [
        (("a", "x", D1, D0, False), "reversed"),
        (("a", "x", D0, D0, False), "reversed"),
        (("a", "x", D0, D1, True), "active_with_end"),
        (("a", "x", D0, None, False), "closed_without_end"),
        (("a", "x", None, None, True), "without_begin_or_flag"),
        (("a", "x", D0, None, None), "without_begin_or_flag"),
        ((None, "x", D0, None, True), "null_keys"),
    ],
)
def test_faulty_parts_leave_nothing_but_a_line(spark, tmp_path, row, fault):
    store = AppendedHistory(spark, str(tmp_path), ["id"])
    store.append(parts(spark, 1)[0], "fine")
    with pytest.raises(HistoryError, match=fault):
        store.append(parts(spark, 2)[1].unionByName(spark.createDataFrame([row], ROWS)), "bad")
    assert store.read().count() == 2
    told = {r.name: r.asDict() for r in store.log().collect()}
    assert told["bad"]["status"] == "REFUSED" and told["bad"][fault] == 1 and told["bad"]["rows"] == 3
    assert store.append(parts(spark, 2)[1], "bad") == "APPENDED"  # the name is free after a refusal


def test_parts_of_another_schema_are_refused(spark, tmp_path):
    store = AppendedHistory(spark, str(tmp_path), ["id"])
    store.append(parts(spark, 1)[0], "fine")
    with pytest.raises(HistoryError, match="columns differ"):
        store.append(parts(spark, 1)[0].withColumn("v", F.lit(1)), "other")


def test_names_older_than_the_state_are_known(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("dimtrail.plans.appended.REMEMBERED", 1)
    store = AppendedHistory(spark, str(tmp_path), ["id"])
    for i, part in enumerate(parts(spark, 3)):
        store.append(part, f"p{i}")
    assert store.append(parts(spark, 1)[0], "p0") == "SEEN" and store.read().count() == 6


def test_runs_tell_of_themselves(spark, tmp_path):
    target = parts(spark, 1)[0]
    source = spark.createDataFrame([("k0", "z"), ("k9", "n")], "id string, v string")
    done = run_pipeline(source, target, str(tmp_path), datetime.date(2024, 3, 1), ["id"], ["v"])
    assert run_pipeline(source, target, str(tmp_path), datetime.date(2024, 3, 1), ["id"], ["v"]).status == "reused"
    bad = target.withColumn("effective_from", F.when(~F.col("is_current"), F.lit(datetime.date(2025, 1, 1))).otherwise(F.col("effective_from")))
    assert run_pipeline(source, bad, str(tmp_path), datetime.date(2024, 3, 1), ["id"], ["v"]).status == "invalid"
    runs = {r.status: r for r in sinks.read_runs(spark, str(tmp_path)).collect()}
    assert set(runs) == {"promoted", "invalid"} and runs["invalid"].version is None
    assert (runs["promoted"].run, runs["promoted"].rows, runs["promoted"].counts["changed_rows"], runs["promoted"].settings["key"]) == (done.fingerprint, 4, 1, "id")
    assert {r.status for r in sinks.read_report(spark, f"{tmp_path}/validation/{runs['invalid'].run}").collect()} == {"pass", "fail"}


def test_landed_batches(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [[("a", "x", at), (None, " ", at + datetime.timedelta(seconds=10))], [("b", None, at + datetime.timedelta(seconds=5))], [("c", "y", None)]]
    schema = "id string, v string, at timestamp"
    landing = Landing(f"{tmp_path}/landed", ["id"], ["v"], "at")
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        landing.start(read_stream(spark, f"{tmp_path}/in", schema), f"{tmp_path}/checkpoint").awaitTermination()
    landing.process(spark.createDataFrame(rows[0], schema), 0)  # a batch that comes again
    found = [(r.batch, r.rows, r.null_keys, r.blanks[0].n, r.usual, r.overlapping, r.per_second) for r in landing.statistics(spark).orderBy("batch").collect()]
    assert [f[:6] for f in found] == [(0, 2, 1, 1, None, False), (1, 1, 0, 1, 2.0, True), (2, 1, 0, 0, 1.5, False)]
    assert found[0][6] == pytest.approx(0.2)
    assert sinks.read_rows(spark, f"{tmp_path}/landed/rows").count() == 4


@pytest.fixture(scope="module")
def db(spark):
    """A Derby database in memory as catalog `db`: 300 rows, times that repeat, nulls among times and keys."""
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    k = F.col("id")
    rows = spark.range(300).select(k.alias("K"), F.when(k % 11 != 0, F.timestamp_seconds(1_700_000_000 + k % 50)).alias("TS"), F.concat(F.lit("n"), k.cast("string")).alias("NAME"), F.when(k % 7 != 0, k % 4).alias("PART"))
    rows.write.jdbc(url, "ITEMS", properties={"driver": DERBY})
    database.use_database(spark, "db", url, DERBY)
    return rows


def plain(db):
    """(time, key) of all rows in order, nulls last."""
    return sorted(((r.TS is None, r.TS or datetime.datetime.min, r.K) for r in db.collect()))


def test_snapshot_in_order(spark, db):
    order = [k for *_, k in plain(db)]
    for limit in (None, 0, 7, 299, 1000):
        found = database.table_snapshot(spark, "db.APP.ITEMS", ["K"], ["NAME", "K"], "TS", limit)
        assert found.columns == ["K", "NAME", "TS"]
        assert [r.K for r in found.collect()] == order[:limit]


def test_split_reads_hold_all_rows(spark, db):
    for split in ("K", "TS", "PART"):
        rows = database.table_rows(spark, "db.APP.ITEMS", ["K", "NAME"], split, 5)
        assert sorted(r.K for r in rows.collect()) == list(range(300))
    assert database.table_rows(spark, "db.APP.ITEMS", ["K"], "K", 5).rdd.getNumPartitions() == 5
    with pytest.raises(SourceError):
        database.table_rows(spark, "db.APP.ITEMS", ["K"], "NAME")
    with pytest.raises(SourceError):
        database.table_rows(spark, "db.APP.ITEMS", ["K", "NONE"])


def test_work_of_the_database(spark, db):
    plan = database.rows_after(spark, "db.APP.ITEMS", ["K"], ["NAME"], "TS", {"TS": "2023-11-14 22:13:40", "K": 40})._jdf.queryExecution().executedPlan().toString()
    assert "TS >=" in plan and "PART" not in plan
    whole = spark.table("db.APP.ITEMS").agg(F.max("K"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregates: [MAX(K)]" in whole


def test_pages_behind_a_cursor_are_the_whole_table(spark, db):
    known, cursor = [], None
    timed = [k for null, _, k in plain(db) if not null]
    start = {"TS": "2000-01-01 00:00:00", "K": -1}
    cursor = start
    while page := database.rows_after(spark, "db.APP.ITEMS", ["K"], ["NAME"], "TS", cursor, 70).collect():
        known += [r.K for r in page]
        cursor = {"TS": str(page[-1].TS), "K": page[-1].K}
    assert known == timed


def test_declared_schema(spark, db):
    assert database.tables_of(spark, "db", "APP") == ["ITEMS"]
    found = database.table_schema(spark, "db.APP.ITEMS", "items", 1).orderBy("ordinal").collect()
    assert [(r.slug, r.ordinal) for r in found] == [("k", 0), ("ts", 1), ("name", 2), ("part", 3)]

"""Readers, the pipeline with reuse, and streams with restart, holds and late rows."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from dimtrail.operators.containment import HoldError
from dimtrail.operators.contracts import Contract
from dimtrail.operators.guardrail import Thresholds
from dimtrail.operators.invariants import passes, validate_history
from dimtrail.plans.pipeline import run_pipeline
from dimtrail.sources import readers, sinks
from dimtrail.sources.ledger import ConflictError, Ledger, event
from dimtrail.streaming.stream import HistoryStream, read_stream


def test_snapshot_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" ID ,City,effective_from,effective_to,is_current\n1,  Pune ,2026-01-01,,yes\n2,X,2026-01-01 10:00:00,2026-02-01,no\n")
    df = readers.read_snapshot_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "city", "effective_from", "effective_to", "is_current"]
    rows = {r.id: r for r in df.collect()}
    assert rows[1].city == "Pune" and rows[1].is_current and rows[2].effective_to == datetime.date(2026, 2, 1) and not rows[2].is_current


@pytest.mark.parametrize(("body", "fine"), [("a;b\n1;2\n", True), ("a|b\n1|2\n", True), ("a,b\n", False), ("", False), ("a,A\n1,2\n", False), ("a,,b\n1,2,3\n", False)])
def test_delimited(spark, tmp_path, body, fine):
    path = tmp_path / "f.txt"
    path.write_text(body)
    if fine:
        assert [tuple(r) for r in readers.read_delimited(spark, str(path)).collect()] == [("1", "2")]
    else:
        with pytest.raises(readers.SourceError):
            readers.read_delimited(spark, str(path))


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"results": [{"x": 1}, {"x": 2}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"x": 1}]))
    assert readers.read_json_records(spark, str(tmp_path / "a.json")).count() == 2
    assert readers.read_json_records(spark, str(tmp_path / "b.json")).count() == 1


def test_pipeline_promotes_reuses_and_refuses(spark, tmp_path):
    source = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, city string")
    target = spark.createDataFrame([], "id string, city string, effective_from date, effective_to date, is_current boolean")
    root, day = str(tmp_path / "h"), datetime.date(2026, 6, 8)
    first = run_pipeline(source, target, root, day, ["id"], ["city"])
    assert first.status == "promoted" and first.summary["new_rows"] == 2
    assert run_pipeline(source, target, root, day, ["id"], ["city"]).status == "reused"
    history = sinks.read_history(spark, root)
    late = run_pipeline(source.withColumn("city", F.lit("z")), history, root, day, ["id"], ["city"])
    assert late.status == "invalid" and sinks.current_version(spark, root)["version"] == 1  # a second change on one day
    contract = Contract((("id", "string"), ("city", "string")), ("id",), ("city",))
    bad = spark.createDataFrame([(None, "a")], "id string, city string")
    assert run_pipeline(bad, history, root, day, ["id"], ["city"], contract=contract).status == "rejected"
    assert spark.read.parquet(f"{root}/quarantine").first().category == "blank_key"


ROWS = "k string, v bigint, ts timestamp"


def put(spark, path, rows):
    spark.createDataFrame([(k, v, datetime.datetime(2026, 1, d)) for k, v, d in rows], ROWS).coalesce(1).write.mode("append").parquet(path)


def test_stream(spark, tmp_path):
    at = str(tmp_path)
    stream = HistoryStream(f"{at}/h", ["k"], ["v"], "ts", Thresholds(enabled=False))
    go = lambda: stream.start(read_stream(spark, f"{at}/in", ROWS, 10), f"{at}/c").awaitTermination()
    put(spark, f"{at}/in", [("a", 1, 1), ("a", 2, 2), ("b", 1, 1)])
    go()
    put(spark, f"{at}/in", [("a", 3, 5), ("b", 9, 1)])
    go()  # a restart goes on where it was; b's row is of the day that b's version began, after a's batch date
    store = stream.store(spark)
    rows = {(r.k, r.v, r.is_current) for r in store.read().collect()}
    assert ("a", 3, True) in rows and ("a", 2, False) in rows
    n = store.ledger.latest()[0]
    stream.process(day(spark, 9, 7, "a"), 0)
    assert store.ledger.latest()[0] == n  # a batch that was committed is a no-op
    assert store.cursor() == "2026-01-05T00:00:00"


def day(spark, d, v, keys="abcdef"):
    return spark.createDataFrame([(c, v, datetime.datetime(2026, 1, d)) for c in keys], ROWS)


def held(spark, at, mode="divert"):
    """A stream whose second batch is held."""
    stream = HistoryStream(f"{at}/h", ["k"], ["v"], "ts", Thresholds(dispersion=2), mode=mode)
    stream.process(day(spark, 1, 1), 0)  # the first batch is a bootstrap
    if mode == "divert":
        stream.process(day(spark, 2, 2), 1)
    else:
        with pytest.raises(RuntimeError):
            stream.process(day(spark, 2, 2), 1)
    return stream, stream.store(spark)


def values(store):
    return sorted((r.k, r.v, r.effective_from.day, r.effective_to and r.effective_to.day, r.is_current) for r in store.read().collect())


FIRST = [(c, 1, 1, None, True) for c in "abcdef"]
BOTH = sorted(x for c in "abcdef" for x in ((c, 1, 1, 2, False), (c, 2, 2, None, True)))


def test_stream_holds(spark, tmp_path):
    stream, store = held(spark, tmp_path)
    assert values(store) == FIRST and store.cursor() == "2026-01-01T00:00:00"
    (hold,) = store.holds().collect()
    assert hold.status == "HELD" and store.frozen(hold.hold_id).count() == 6
    stream.mode = "block"
    with pytest.raises(RuntimeError):
        stream.process(day(spark, 2, 2), 2)
    assert store.holds().count() == 1  # the same batch by another name makes no second hold
    assert [(r.run_id, r.status, r.seen, r.changed, r.held) for r in store.runs().orderBy("at").collect()] == [("0", "COMPLETED", 6, 6, 0), ("1", "HELD", 6, 0, 6)]


def test_release(spark, tmp_path):
    stream, store = held(spark, tmp_path)
    stream.process(day(spark, 3, 5, "a"), 2)
    (hold,) = [r.hold_id for r in store.holds().collect()]
    assert store.release(hold) == "RELEASED"
    n = store.ledger.latest()[0]
    want = sorted([x for x in BOTH if x[0] != "a"] + [("a", 1, 1, 3, False), ("a", 5, 3, None, True)])  # a has gone on; its frozen row is late
    assert values(store) == want and store.cursor() == "2026-01-03T00:00:00"
    assert store.release(hold) == "RELEASED" and store.ledger.latest()[0] == n
    for other in (store.discard, store.reprocess):
        with pytest.raises(HoldError):
            other(hold)
    with pytest.raises(HoldError):
        store.release("none")


def test_reprocess_and_discard(spark, tmp_path):
    stream, store = held(spark, tmp_path)
    (hold,) = [r.hold_id for r in store.holds().collect()]
    assert store.reprocess(hold) == "HELD" and values(store) == FIRST
    assert store.reprocess(hold, force=True) == "REPROCESSED" and values(store) == BOTH
    stream.process(day(spark, 3, 3), 2)
    (hold,) = [r.hold_id for r in store.holds().where("status = 'HELD'").collect()]
    assert store.discard(hold) == "DISCARDED" and values(store) == BOTH and store.cursor() == "2026-01-02T00:00:00"
    stream.process(day(spark, 4, 3), 3)
    (hold,) = [r.hold_id for r in store.holds().where("status = 'HELD'").collect()]
    assert store.discard(hold, advance=True) == "DISCARDED" and store.cursor() == "2026-01-04T00:00:00"


def test_blocked_stream_goes_on_after_its_hold_is_closed(spark, tmp_path):
    stream, store = held(spark, tmp_path, "block")
    (hold,) = [r.hold_id for r in store.holds().collect()]
    store.discard(hold)  # without advance the batch is met again, and held again
    with pytest.raises(RuntimeError):
        stream.process(day(spark, 2, 2), 1)
    (again,) = [r.hold_id for r in store.holds().where("status = 'HELD'").collect()]
    store.release(again)
    stream.process(day(spark, 2, 2), 1)
    assert values(store) == BOTH


def test_two_writers(spark, tmp_path):
    """A decision made on a state that has been replaced is refused, and leaves nothing."""
    _, store = held(spark, tmp_path)
    n, state = store.ledger.latest()
    store.ledger.commit(n, state | {"cursor": "x"})
    with pytest.raises(ConflictError):
        store.ledger.commit(n, state | {"cursor": "y"})
    assert store.cursor() == "x"
    os.makedirs(f"{tmp_path}/h/log/at={n + 2}")  # a writer that died before its row was there
    assert store.ledger.commit(n + 1, state) == n + 2 and store.cursor() == "2026-01-01T00:00:00"


def test_stream_tries_again_without_repeating(spark, tmp_path):
    """A blocked batch that is tried again, and a diverted one that is replayed, leave their side rows once."""
    at = str(tmp_path)
    stream = HistoryStream(f"{at}/h", ["k"], ["v"], "ts", Thresholds(dispersion=2))
    stream.process(day(spark, 5, 1), 0)
    batch = day(spark, 6, 2).union(day(spark, 7, 9, "a")).union(day(spark, 1, 9, "b")).where("k != 'b' or v = 9")
    for _ in range(2):
        with pytest.raises(RuntimeError):
            stream.process(batch, 1)
    assert sinks.read_rows(spark, f"{at}/h/late").where("batch_id = '1'").count() == 1
    assert sinks.read_rows(spark, f"{at}/h/held").count() == 6
    stream.mode = "divert"
    for _ in range(2):
        stream.process(batch, 1)
    assert stream.store(spark).ledger.latest()[1]["seen"] == ["0", "1"]
    assert sinks.read_rows(spark, f"{at}/h/evidence").where("batch = '1'").count() == 1


def test_stream_by_timestamp(spark, tmp_path):
    stream = HistoryStream(f"{tmp_path}/h", ["k"], ["v"], "ts", Thresholds(enabled=False), grain="timestamp")
    for n in range(3):  # three changes on one day
        stream.process(spark.createDataFrame([("a", n, datetime.datetime(2026, 1, 1, 10 + n))], ROWS), n)
    rows = sorted((r.v, r.effective_from.hour, r.effective_to and r.effective_to.hour) for r in stream.store(spark).read().collect())
    assert rows == [(0, 10, 11), (1, 11, 12), (2, 12, None)]


def test_stream_takes_up_a_whole_history(spark, tmp_path):
    """A batch of a key writes a row or two, a history written as a whole is taken up, and all of it stays readable."""
    root = f"{tmp_path}/h"
    rows = spark.createDataFrame([(str(i), 1) for i in range(200)], "k string, v bigint")
    empty = spark.createDataFrame([], "k string, v bigint, effective_from date, effective_to date, is_current boolean")
    run_pipeline(rows, empty, root, datetime.date(2026, 1, 1), ["k"], ["v"])
    stream = HistoryStream(root, ["k"], ["v"], "ts", Thresholds(enabled=False), buckets=8)
    stream.process(day(spark, 3, 2, ["5"]), 0)
    stream.process(day(spark, 4, 3, ["5"]).union(day(spark, 4, 1, ["new"])), 1)
    state = stream.store(spark).ledger.latest()[1]["history"]
    assert len(state["live"]) == 8 and [spark.read.parquet(f"{root}/{f}").count() for f in state["deltas"]] == [1, 2]
    history = stream.store(spark).read()
    assert history.where("is_current").count() == 201 and sorted(r.v for r in history.where("k = '5'").collect()) == [1, 2, 3]
    assert set(history.columns) == {"k", "v", "effective_from", "effective_to", "is_current"}


def test_buckets_compaction_and_retention(spark, tmp_path):
    """Any number of buckets and deltas gives the same history; old folders and log rows go, events stay."""
    rng = random.Random(3)
    batches = [[(f"k{i}", rng.randint(0, 2)) for i in rng.sample(range(40), n)] for n in (20, 5, 1, 20, 5, 1)]
    plain, open_from = {}, {}
    for n, batch in enumerate(batches):
        for k, v in batch:
            if k in open_from and plain[k][-1][0] != v:
                plain[k][-1] = (*plain[k][-1][:2], n + 1)
            if k not in open_from or plain[k][-1][2] == n + 1:
                plain.setdefault(k, []).append((v, n + 1, None))
                open_from[k] = n
    want = sorted((k, v, a, b, b is None) for k, own in plain.items() for v, a, b in own)
    for name, sizes, compact_after in (("b", [4, 8, 8, 3, 3, 3], 100), ("c", [5] * 6, 2)):
        root = f"{tmp_path}/{name}"
        for n, (batch, buckets) in enumerate(zip(batches, sizes, strict=True)):
            stream = HistoryStream(root, ["k"], ["v"], "ts", Thresholds(enabled=False), buckets=buckets, compact_after=compact_after, keep=2)
            stream.process(spark.createDataFrame([(k, v, datetime.datetime(2026, 1, n + 1)) for k, v in batch], ROWS), n)
        store = stream.store(spark)
        assert values(store) == want
        assert passes(validate_history(store.read(), ["k"]))
        state = store.ledger.latest()[1]["history"]
        assert state["buckets"] == sizes[-1] and (name != "b" or len(state["deltas"]) == 2)
        if name == "c":
            named = {f.split("/")[1] for f in (*state["deltas"], *[g for _, g in state["garbage"]]) if f.startswith("delta")}
            assert set(os.listdir(f"{root}/delta")) == named and len(named) < 6
            assert len([x for x in os.listdir(f"{root}/log") if x.startswith("at=")]) <= 4 and store.runs().count() == 6


def test_a_fold_that_is_cut_short_keeps_every_event_once(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    for n in range(6):
        ledger.commit(n, {"n": n}, [event("run", str(n), "COMPLETED")])
    old = spark.read.parquet(f"{tmp_path}/log").where("at <= 3").selectExpr("at", "inline(events)")
    old.write.mode("append").parquet(f"{tmp_path}/events")  # the rows weren't deleted any more
    ledger.fold(2)
    assert sorted(r.id for r in ledger.events().collect()) == list("012345") and ledger.latest() == (6, {"n": 5})

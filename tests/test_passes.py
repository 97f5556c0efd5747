"""Judging a batch derives its inputs once."""

import datetime

import pytest

from dimtrail.operators import containment
from dimtrail.plans.pipeline import integrate_canonical
from dimtrail.queries import files

DAY = datetime.date(2020, 1, 1)
VERSIONS = "effective_from date, effective_to date, is_current boolean"


def test_judged_canonical_batch_is_a_result(spark):
    """The evidence that comes back is rows, not a plan that compares the batch again."""
    records = spark.createDataFrame([("a", "A", "B", "a@x.org", DAY, "ACTIVE", datetime.datetime(2024, 1, 1))], "customer_id string, first_name string, last_name string, email string, date_of_birth date, status string, created_at timestamp")
    history = spark.createDataFrame([], f"customer_id string, first_name string, last_name string, email string, date_of_birth date, status string, {VERSIONS}")
    _, staged, judged = integrate_canonical(records, history, DAY)
    assert "Join" not in judged._jdf.queryExecution().optimizedPlan().toString()
    assert (judged.first().new, judged.first().decision, staged.count()) == (1, "NORMAL", 1)


def test_forced_reprocessing_is_not_judged(spark, monkeypatch):
    monkeypatch.setattr(containment, "evidence", lambda *_: pytest.fail("judged"))
    events = spark.createDataFrame([("h", "HELD", 1)], "hold_id string, status string, at int")
    frozen = spark.createDataFrame([("a", "y", datetime.date(2024, 1, 1))], "k string, v string, at date")
    history = spark.createDataFrame([("a", "x", DAY, None, True)], f"k string, v string, {VERSIONS}")
    found = containment.reprocess(events, "h", frozen, history, ["k"], ["v"], "at", datetime.date(2024, 2, 1), force=True)
    assert found.status == "REPROCESSED" and found.history.count() == 2


def test_stream_batches_come_from_one_pass(spark, tiny, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "scratch", lambda _: str(tmp_path / "at"))
    monkeypatch.setattr(files.HistoryStream, "start", lambda self, *_: type("Query", (), {"awaitTermination": lambda self: None})())
    files._streamed(spark, tiny, late=False)
    assert sorted(p.name for p in (tmp_path / "at" / "days").glob("part=*")) == ["part=0", "part=1", "part=2"]

"""Held batches: fingerprint dedup, states, release, reprocessing, discarding."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dimtrail.operators.changes import classify_changes
from dimtrail.operators.guardrail import Thresholds, decide, evidence
from dimtrail.operators.history import apply_history
from dimtrail.operators.invariants import validate_history

HELD, CLOSING = "HELD", ("RELEASED", "REPROCESSED", "DISCARDED")


class HoldError(ValueError):
    """An action that a hold's state doesn't allow."""


def hold_states(events: DataFrame) -> DataFrame:
    """(hold_id, status, at) from status events: the first closing event ends a hold, later ones change nothing."""
    closing = F.col("status").isin(*CLOSING)
    ended = events.groupBy("hold_id").agg(F.min_by("status", F.when(closing, F.struct("at", "status"))).alias("end"), F.min(F.when(closing, F.col("at"))).alias("end_at"), F.min("at").alias("begin"), F.count_if(~closing).alias("holds"))
    return ended.where("holds > 0").select("hold_id", F.when(F.col("end_at").isNotNull(), F.col("end")).otherwise(HELD).alias("status"), F.coalesce("end_at", "begin").alias("at"))


def refused_moves(events: DataFrame) -> DataFrame:
    """Closing events of holds that an earlier event had closed otherwise, or that were never held; repeats of the same status are no error."""
    state = hold_states(events).select("hold_id", F.col("status").alias("state"))
    asked = events.where(F.col("status").isin(*CLOSING))
    return asked.join(state, "hold_id", "left").where(F.col("state").isNull() | (F.col("state") != F.col("status"))).select("hold_id", "status", "at")


def new_holds(suspicious: DataFrame, holds: DataFrame) -> DataFrame:
    """Batches to hold: those whose fingerprint no active hold has, one for each fingerprint."""
    fresh = suspicious.join(holds.where(F.col("status") == HELD).select("source", "fingerprint"), ["source", "fingerprint"], "left_anti")
    rest = [c for c in suspicious.columns if c not in ("source", "fingerprint")]
    return fresh.groupBy("source", "fingerprint").agg(F.min(F.struct(*rest)).alias("v")).select("source", "fingerprint", "v.*").select(suspicious.columns)


def hold_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("status").agg(F.count("*").alias("n"))


def filtered(rows: DataFrame, **wanted) -> DataFrame:
    """Rows that have all values asked for; None asks for nothing."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def newest(rows: DataFrame, at: str, ties: str, n: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(F.col(at).desc(), F.col(ties)).offset(offset).limit(n)


def page_with_total(rows: DataFrame, at: str, ties: str, n: int, offset: int = 0) -> DataFrame:
    """The rows of newest() with total, the number of all rows; no rows behind the last page."""
    return newest(rows, at, ties, n, offset).join(F.broadcast(rows.agg(F.count("*").alias("total"))))


def released_rows(frozen: DataFrame, history: DataFrame, key: list[str], at: Column) -> tuple[DataFrame, DataFrame]:
    """Frozen rows that may be replayed, and those older than the current version of their key, which may not."""
    begun = history.where("is_current").select(*key, F.col("effective_from").alias("__dt_begun"))
    both = frozen.join(begun, key, "left")
    late = F.coalesce(at.cast("date") < F.col("__dt_begun"), F.lit(False))
    return both.where(~late).select(frozen.columns), both.where(late).select(frozen.columns)


@dataclass
class Resolution:
    """What an action on a hold comes to: its new status, the next history (None where it stays as it is), rows too old to be replayed, and whether the source's cursor may pass the batch."""

    status: str
    history: DataFrame | None = None
    late: DataFrame | None = None
    advances: bool = False


def _require_held(events: DataFrame, hold: str) -> None:
    found = hold_states(events.where(F.col("hold_id") == hold)).first()
    if found is None or found.status != HELD:
        raise HoldError(f"hold {hold} is {'unknown' if found is None else found.status}")


def _replayed(frozen: DataFrame, history: DataFrame, key: Sequence[str], tracked: Sequence[str], at: str, when: datetime.date | datetime.datetime) -> tuple[DataFrame, DataFrame]:
    """The next history with the frozen rows in it, checked, and the rows too old for it."""
    fit, late = released_rows(frozen, history, list(key), F.col(at))
    staged = apply_history(fit.select(*key, *tracked), history, key, tracked, when, "incremental", "ignore")
    checked = staged.persist()
    try:
        broken = [r.rule for r in validate_history(checked, key).where("status = 'fail'").collect()]
    finally:
        checked.unpersist()
    if broken:
        raise HoldError(f"the replay breaks {broken}")
    return staged, late


def release(events: DataFrame, hold: str, frozen: DataFrame, history: DataFrame, key: Sequence[str], tracked: Sequence[str], at: str, when: datetime.date | datetime.datetime) -> Resolution:
    """A held batch is accepted as it is: its frozen rows are replayed against the history of today, except those older than their key's current version.

    Only a hold that is HELD may be released; a replay that breaks an invariant changes nothing and is an error."""
    _require_held(events, hold)
    staged, late = _replayed(frozen, history, key, tracked, at, when)
    return Resolution("RELEASED", staged, late, True)


def reprocess(events: DataFrame, hold: str, frozen: DataFrame, history: DataFrame, key: Sequence[str], tracked: Sequence[str], at: str, when: datetime.date | datetime.datetime, thresholds: Thresholds = Thresholds(), force: bool = False) -> Resolution:  # noqa: B008
    """A held batch is judged again against the history of today; still suspicious, it stays HELD, unless forced. Otherwise it is replayed."""
    _require_held(events, hold)
    if not force:
        fit, _ = released_rows(frozen, history, list(key), F.col(at))
        fit = fit.persist()  # no more rows than the batch has
        changes = classify_changes(fit.select(*key, *tracked), history, key, tracked, "incremental", "ignore").withColumn("batch", F.lit(hold)).join(fit.select(*key, at), list(key), "left").persist()
        try:
            judged = decide(evidence(changes, "batch", key, at), thresholds).first()
        finally:
            changes.unpersist()
            fit.unpersist()
        if judged is not None and judged.decision != "NORMAL":
            return Resolution(HELD)
    staged, late = _replayed(frozen, history, key, tracked, at, when)
    return Resolution("REPROCESSED", staged, late, True)


def discard(events: DataFrame, hold: str, advance: bool = False) -> Resolution:
    """A held batch is given up: the history stays; with advance the source's cursor passes the batch, else its rows come again."""
    _require_held(events, hold)
    return Resolution("DISCARDED", advances=advance)

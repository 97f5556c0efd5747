"""A stored history with its cursor, runs and holds: batches are judged against it, then committed or held; holds are released, reprocessed or discarded.

All that belongs to one decision is one commit of the ledger: the history's delta, the cursor, open holds, and the events of runs and
holds. A decision made on a state that another writer has replaced is an error, and nothing of it is visible."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimtrail.operators.changes import CURRENT, FROM, TO, joined
from dimtrail.operators.containment import CLOSING, HELD, HoldError, hold_states
from dimtrail.operators.fingerprint import batch_fingerprints
from dimtrail.operators.guardrail import Thresholds, decide, evidence
from dimtrail.operators.invariants import passes, validate_history
from dimtrail.operators.keys import latest_per_key
from dimtrail.sources import sinks
from dimtrail.sources.keyed import ENDS, KeyedHistory
from dimtrail.sources.ledger import Ledger, event

#: Batches and closed holds that a state names; older ones are in the events alone.
REMEMBERED = 500


@dataclass
class Judged:
    """A batch against a history: its delta (None if all its rows are late), the history it belongs to, its last time, what the guardrail says, and counts."""

    history: dict
    folder: str | None
    last: datetime.datetime | None
    decision: str = "NORMAL"
    severity: str = "LOW"
    rules: tuple = ()
    valid: bool = True
    changed: int = 0
    seen: int = 0
    late: int = 0


class HistoryStore:
    """key, tracked, at (time column): of the rows; grain: date or timestamp; buckets, compact_after, keep: of KeyedHistory."""

    def __init__(self, spark: SparkSession, root: str, key: Sequence[str], tracked: Sequence[str], at: str, thresholds: Thresholds = Thresholds(), grain: str = "date", buckets: int = 16, compact_after: int = 24, keep: int = 8):  # noqa: B008
        self.spark, self.root, self.key, self.tracked, self.at, self.thresholds, self.grain = spark, root, list(key), list(tracked), at, thresholds, grain
        self.keyed, self.ledger = KeyedHistory(spark, root, key, tracked, grain, buckets, compact_after, keep), Ledger(spark, root)

    # --- reading

    def read(self) -> DataFrame | None:
        """The history of the last commit, None before the first."""
        history = self.ledger.latest()[1].get("history")
        return None if history is None else self.keyed.read(history)

    def cursor(self) -> str | None:
        return self.ledger.latest()[1].get("cursor")

    def runs(self) -> DataFrame:
        """run_id, status, seen, changed, held, late, started, ended of every batch, in the order of its commits."""
        detail = F.from_json("detail", "seen long, changed long, held long, late long, started string")
        return self.ledger.events().where("kind = 'run'").select("at", F.col("id").alias("run_id"), "status", detail.alias("d"), F.col("time").alias("ended")).select("at", "run_id", "status", "d.*", "ended")

    def holds(self) -> DataFrame:
        """(hold_id, status, at) of every hold."""
        return hold_states(self.ledger.events().where("kind = 'hold'").select(F.col("id").alias("hold_id"), "status", F.col("time").alias("at")))

    def frozen(self, hold: str) -> DataFrame:
        """The rows of a hold as they were when it was made."""
        return self.spark.read.parquet(f"{self.root}/held/of={hold}").drop("batch_id")

    # --- batches

    def _state(self) -> tuple[int, dict]:
        """The last commit. A whole history that the batch pipeline wrote here is taken up first."""
        n, state = self.ledger.latest()
        if n == 0 and (whole := sinks.read_history(self.spark, self.root)) is not None:
            state = {"history": self.keyed.adopted(whole, 1)}
            n = self.ledger.commit(0, state, [event("run", "adopted", "COMPLETED")])
        return n, state

    def judge(self, rows: DataFrame, state: dict, name: str, late_to: str | None = None) -> Judged:
        """What a batch of unique keys comes to: its delta is written, not yet named by any state. Rows older than their key's current version are late and left out."""
        history = state.get("history") or self.keyed.begun(rows)
        current = self.keyed.current(history, rows).persist()  # no more rows than the batch has
        try:
            return self._judged(rows, current, history, name, late_to)
        finally:
            current.unpersist()

    def _judged(self, rows: DataFrame, current: DataFrame, history: dict, name: str, late_to: str | None) -> Judged:
        first = not history["live"] and not history["deltas"]
        both = rows.join(current.select(*self.key, F.col(FROM).alias("__dt_begun")), self.key, "left")
        late = F.coalesce(F.col(self.at).cast(self.grain) < F.col("__dt_begun"), F.lit(False))
        found = both.agg(F.count("*").alias("seen"), F.count_if(late).alias("late"), F.max(F.when(~late, F.col(self.at).cast("timestamp"))).alias("last")).first()
        if late_to is not None and found.late:
            sinks.put_rows(both.where(late).select(*rows.columns, F.lit(name).alias("batch_id")), late_to, name)
        timely, last, counts = both.where(~late).select(rows.columns), found.last, {"seen": found.seen, "late": found.late}
        if last is None:
            return Judged(history, None, None, **counts)
        day = F.lit(last if self.grain == "timestamp" else last.date()).cast(self.grain)
        pairs = joined(timely.select(*self.key, *self.tracked), current, self.key, self.tracked, "incremental", "ignore").where("change_type != 'ABSENT'").persist()
        try:
            ends = F.when(F.col("change_type") == "CHANGED", day)
            values = [*self.key, *self.tracked]
            moved = pairs.where("change_type in ('NEW', 'CHANGED')").select(*[F.col(f"s.{c}").alias(c) for c in values], day.alias(FROM), ends.alias(ENDS))
            folder = self.keyed.stage(moved, name)
            before = pairs.where("t is not null").select(*[F.col(f"t.{c}").alias(c) for c in values], F.col(f"t.{FROM}").alias(FROM), ends.alias(TO), ends.isNull().alias(CURRENT))
            after = moved.drop(ENDS).withColumn(TO, F.lit(None).cast(self.grain)).withColumn(CURRENT, F.lit(True))
            valid = passes(validate_history(before.unionByName(after.select(before.columns)), self.key))
            changes = pairs.select(*[F.coalesce(f"s.{k}", f"t.{k}").alias(k) for k in self.key], "change_type", "field_changes").withColumn("batch", F.lit(name)).join(rows.select(*self.key, self.at), self.key, "left").persist()
            checked = self.spark.createDataFrame([(name, valid)], "batch string, valid boolean")
            judged = decide(evidence(changes, "batch", self.key, self.at, F.lit(first), valid=checked), self.thresholds)
            try:
                sinks.put_rows(judged, f"{self.root}/evidence", name)
            finally:
                changes.unpersist()
            told = sinks.read_rows(self.spark, f"{self.root}/evidence/of={name}").first()
            return Judged(history, folder, last, told.decision, told.severity, tuple(told.rules), valid, moved.count(), **counts)
        finally:
            pairs.unpersist()

    def _with_batch(self, state: dict, judged: Judged, n: int, name: str | None) -> dict:
        """The state after a batch: its delta, its cursor, and the batch as seen."""
        history = self.keyed.added(judged.history, judged.folder, n) if judged.folder else state.get("history")
        if history is not None:
            history = self.keyed.cleaned(history, n)
        cursor = max(filter(None, [state.get("cursor"), judged.last and judged.last.isoformat()]), default=None)
        seen = state.get("seen", []) + ([name] if name else [])
        return state | {"cursor": cursor, "seen": seen[-REMEMBERED:]} | ({"history": history} if history is not None else {})

    def take(self, batch: DataFrame, name: str, hold: str = "divert") -> str:
        """Takes a batch in: COMPLETED, HELD, or SEEN if it was taken before. hold: divert (the batch is done with) or block (it comes again until its hold is closed).

        A batch with the fingerprint of an open hold makes no second one."""
        n, state = self._state()
        if name in state.get("seen", ()):
            return "SEEN"
        started = datetime.datetime.now(datetime.UTC).isoformat()
        rows = latest_per_key(batch, self.key, self.at, self.tracked).persist()
        try:
            judged = self.judge(rows, state, name, f"{self.root}/late")
            seen, late = judged.seen, judged.late
            counts = {"seen": seen, "late": late, "started": started}
            if judged.decision == "NORMAL":
                state = self._with_batch(state, judged, n + 1, name)
                self._commit(n, state, [event("run", name, "COMPLETED", changed=judged.changed, held=0, **counts)])
                return "COMPLETED"
            mark = batch_fingerprints(rows.withColumn("__dt_b", F.lit(0)), "__dt_b", self.key, self.at, self.root.rsplit("/", 1)[-1]).first().fingerprint
            open_holds, events = state.get("holds", {}), []
            if all(h["fingerprint"] != mark for h in open_holds.values()):
                new = f"{name}-{n + 1}"
                sinks.put_rows(rows.withColumn("batch_id", F.lit(name)), f"{self.root}/held", new)
                told = {"fingerprint": mark, "batch": name, "severity": judged.severity, "rules": judged.rules, "rows": seen}
                open_holds = open_holds | {new: told}
                events = [event("hold", new, HELD, **told), event("run", name, HELD, changed=0, held=seen - late, **counts)]
            elif hold == "divert":
                events = [event("run", name, HELD, changed=0, held=seen - late, **counts)]
            state = state | {"holds": open_holds}
            if hold == "divert":
                state = state | {"seen": [*state.get("seen", []), name][-REMEMBERED:]}
            if events:
                self._commit(n, state, events)
            return HELD
        finally:
            rows.unpersist()

    def _commit(self, n: int, state: dict, events: Sequence[tuple]) -> None:
        at = self.ledger.commit(n, state, events)
        if at % self.keyed.compact_after == 0:
            self.ledger.fold(self.keyed.keep)

    # --- holds

    def _open(self, hold: str, target: str) -> tuple[int, dict, dict | None]:
        """Number, state and the hold; None for it if it has been closed so before. Any other state of the hold is an error."""
        n, state = self._state()
        if hold in state.get("holds", {}):
            return n, state, state["holds"][hold]
        status = state.get("closed", {}).get(hold)
        if status is None:
            row = self.holds().where(F.col("hold_id") == hold).first()
            status = row.status if row is not None else None
        if status != target:
            raise HoldError(f"hold {hold} is {'unknown' if status is None else status}")
        return n, state, None

    def _close(self, n: int, state: dict, hold: str, status: str, counts: dict) -> None:
        told = state["holds"][hold]
        holds = {h: v for h, v in state["holds"].items() if h != hold}
        closed = dict([*state.get("closed", {}).items(), (hold, status)][-REMEMBERED:])
        seen = state.get("seen", [])
        seen = seen if told["batch"] in seen else [*seen, told["batch"]][-REMEMBERED:]
        state = state | {"holds": holds, "closed": closed} | ({} if counts.get("again") else {"seen": seen})
        self._commit(n, state, [event("hold", hold, status, **counts), event("run", told["batch"], status, held=0, seen=told["rows"], **counts)])

    def _replay(self, hold: str, status: str, force: bool) -> str:
        n, state, told = self._open(hold, status)
        if told is None:
            return status
        judged = self.judge(self.frozen(hold), state, f"{hold}-{n + 1}", None)
        if not judged.valid:
            raise HoldError(f"the replay of {hold} breaks an invariant")
        if judged.decision != "NORMAL" and not force:
            return HELD
        self._close(n, self._with_batch(state, judged, n + 1, None), hold, status, {"changed": judged.changed})
        return status

    def release(self, hold: str) -> str:
        """Accepts a held batch as it is: its frozen rows go into the history of today, but for those that are late by now. Releasing it twice changes nothing; a hold closed otherwise, and a replay that breaks an invariant, are errors."""
        return self._replay(hold, CLOSING[0], force=True)

    def reprocess(self, hold: str, force: bool = False) -> str:
        """Judges a held batch again; still suspicious it stays HELD, unless forced."""
        return self._replay(hold, CLOSING[1], force)

    def discard(self, hold: str, advance: bool = False) -> str:
        """Gives a held batch up. With advance the cursor passes it; without, a blocked stream meets it again."""
        n, state, told = self._open(hold, CLOSING[2])
        if told is None:
            return CLOSING[2]
        if advance:
            last = self.frozen(hold).agg(F.max(F.col(self.at).cast("timestamp"))).first()[0]
            state = state | {"cursor": max(filter(None, [state.get("cursor"), last and last.isoformat()]), default=None)}
        self._close(n, state, hold, CLOSING[2], {"changed": 0} if advance else {"changed": 0, "again": True})
        return CLOSING[2]

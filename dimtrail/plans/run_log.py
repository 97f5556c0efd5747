"""The life of onboarding runs: an append-only log of events, folded through the allowed moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimtrail.sources.ledger import ConflictError, Ledger, event

START = "CREATED"
# The states of a run and where each may lead.
RUN_MOVES = {
    "CREATED": ("PROFILING", "TRANSFORMING", "FAILED", "CANCELLED"),
    "PROFILING": ("MAPPING_PENDING", "APPROVAL_PENDING", "TRANSFORMING", "FAILED", "CANCELLED"),
    "MAPPING_PENDING": ("APPROVAL_PENDING", "TRANSFORMING", "FAILED", "CANCELLED"),
    "APPROVAL_PENDING": ("TRANSFORMING", "FAILED", "CANCELLED"),
    "TRANSFORMING": ("VALIDATING", "FAILED", "CANCELLED"),
    "VALIDATING": ("COMPLETED", "PARTIAL", "FAILED", "CANCELLED"),
    "COMPLETED": (),
    "PARTIAL": (),
    "CANCELLED": (),
    "FAILED": ("CREATED",),
}


class MoveError(ValueError):
    """A move that a run's state doesn't allow, or a key that stands for another request."""


def run_states(events: DataFrame, id_column: str = "run_id", at: str = "at", tie: str | None = None) -> DataFrame:
    """(id, status, refused, moves, retries): each run's events in time order folded from CREATED through the allowed moves.

    Events that don't fit are refused and counted; CREATED after FAILED is a retry. Events of one time go by `tie`, then by status. A run has few events,
    which fold in one expression; runs are spread by id."""
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, then in RUN_MOVES.items() for b in then])
    order = F.struct(at, *([tie] if tie else []), "status")
    told = events.where(F.col(id_column).isNotNull() & F.col("status").isNotNull()).groupBy(id_column).agg(F.transform(F.array_sort(F.collect_list(order)), lambda e: e.status).alias("v"))
    count = lambda c: c.cast("bigint")
    start = F.struct(F.lit(START).alias("status"), *[count(F.lit(0)).alias(c) for c in ("refused", "moves", "retries")])

    def move(s, status):
        fine = F.array_contains(allowed, F.concat(s.status, F.lit(">"), status))
        one = lambda c: count(F.when(c, 1).otherwise(0))
        return F.struct(F.when(fine, status).otherwise(s.status).alias("status"), (s.refused + one(~fine)).alias("refused"), (s.moves + one(fine)).alias("moves"), (s.retries + one(fine & (status == START))).alias("retries"))

    return told.select(id_column, F.aggregate("v", start, move).alias("s")).select(id_column, "s.*")


class RunLog:
    """Stored runs. An event is appended only after the state that it was checked against, so two writers can't both move a run."""

    KIND = "onboarding"

    def __init__(self, spark: SparkSession, root: str, tries: int = 5):
        self.ledger, self.tries = Ledger(spark, root), tries

    def events(self) -> DataFrame:
        """at, run_id, status, time, detail."""
        return self.ledger.events().where(F.col("kind") == self.KIND).select("at", F.col("id").alias("run_id"), "status", "time", "detail")

    def states(self) -> DataFrame:
        """run_states of all runs, those that have only begun among them."""
        moved = run_states(self.events().where("get_json_object(detail, '$.first') is null"))
        begun = self.events().select("run_id").distinct().join(moved, "run_id", "left")
        return begun.na.fill(0, ["refused", "moves", "retries"]).na.fill(START, ["status"])

    def status(self, run: str) -> str | None:
        """The run's state, None if there is no such run."""
        mine = self.events().where(F.col("run_id") == run)
        if mine.isEmpty():
            return None
        state = run_states(mine.where("get_json_object(detail, '$.first') is null")).first()
        return START if state is None else state.status

    def create(self, run: str, key: str, fingerprint: str) -> str:
        """Begins a run and returns its id; a key that has been used for the same request returns that run, for another one is an error."""
        for _ in range(self.tries):
            n, _ = self.ledger.latest()
            same = self.events().where(F.get_json_object("detail", "$.key") == key).select("run_id", F.get_json_object("detail", "$.fingerprint").alias("f")).first()
            if same is not None:
                if same.f != fingerprint:
                    raise MoveError(f"key {key} stands for another request")
                return same.run_id
            if self.status(run) is not None:
                raise MoveError(f"run {run} exists")
            try:
                self.ledger.commit(n, {}, [event(self.KIND, run, START, key=key, fingerprint=fingerprint, first=True)])
                return run
            except ConflictError:
                continue
        raise ConflictError(f"run {run} could not be written")

    def move(self, run: str, status: str, **detail) -> str:
        """Moves a run on; an unknown run and a move that isn't allowed are errors and leave no event."""
        for _ in range(self.tries):
            n, _ = self.ledger.latest()
            now = self.status(run)
            if now is None or status not in RUN_MOVES[now]:
                raise MoveError(f"run {run} can't go from {now} to {status}; it may go to {list(RUN_MOVES.get(now, ()))}")
            try:
                self.ledger.commit(n, {}, [event(self.KIND, run, status, **detail)])
                return status
            except ConflictError:
                continue
        raise ConflictError(f"run {run} could not be written")

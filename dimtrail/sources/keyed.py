"""A keyed Type-2 history that takes small batches: deltas merged on read, and compaction.

A batch writes one delta: for each key that changes, when its current version ends and the version that begins. Current versions are
kept in buckets of keys, ended ones are never written again. Reading puts current versions and deltas of a key in order of
their commits; a version ends where a later delta says so. Compaction applies the deltas to the buckets that they touch and appends
what has ended; with another number of buckets it deals all current versions anew. What the tables consist of is the `history` part of a
ledger state, so a batch, its cursor, holds and events become visible with one commit. Folders that no recent commit names are deleted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dimtrail.operators.changes import CURRENT, FROM, TO, HistoryError
from dimtrail.operators.invariants import passes, validate_history
from dimtrail.sources.ledger import delete

BUCKET, ENDS, ORDER = "__dt_bucket", "__dt_ends", "__dt_order"
#: Folders of ended versions before they are put into one.
MOST_ENDED = 64


class KeyedHistory:
    """buckets: into which current versions are dealt; compact_after: deltas; keep: commits whose folders stay for readers."""

    def __init__(self, spark: SparkSession, root: str, key: Sequence[str], tracked: Sequence[str], grain: str = "date", buckets: int = 16, compact_after: int = 24, keep: int = 8):
        self.spark, self.root, self.key, self.tracked, self.grain = spark, root, list(key), list(tracked), grain
        self.buckets, self.compact_after, self.keep = buckets, compact_after, keep

    def begun(self, rows: DataFrame) -> dict:
        """The history part of a state before the first batch, with the types of its rows."""
        types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (*self.key, *self.tracked))
        return {"buckets": self.buckets, "live": {}, "ended": [], "deltas": [], "types": types}

    def _columns(self) -> list[str]:
        return [*self.key, *self.tracked, FROM, TO, CURRENT]

    def _read(self, folders: Sequence[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(n)).cast("int")

    def _merged(self, state: dict, live: Sequence[str], keys: DataFrame | None = None) -> DataFrame:
        """Versions that are current, or were when they were last compacted, with what the deltas did to them."""
        types = state["types"]
        begun = self._read(live, f"{types}, {FROM} {self.grain}").select("*", F.lit(None).cast(self.grain).alias(ENDS), F.lit(0).alias(ORDER))
        parts = [begun]
        for k, folder in enumerate(state["deltas"]):
            parts.append(self._read([folder], f"{types}, {FROM} {self.grain}, {ENDS} {self.grain}").withColumn(ORDER, F.lit(k + 1)))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        if keys is not None:
            rows = rows.join(keys.select(*self.key).distinct(), self.key, "left_semi")
        if state["deltas"]:
            later = f"first({ENDS}, true) OVER (PARTITION BY {', '.join(f'`{k}`' for k in self.key)} ORDER BY {ORDER} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
            rows = rows.withColumn(TO, F.expr(later))
        else:
            rows = rows.withColumn(TO, F.col(ENDS))
        return rows.where(F.col(FROM).isNotNull()).withColumn(CURRENT, F.col(TO).isNull()).select(self._columns())

    def read(self, state: dict) -> DataFrame:
        """The whole history of a state."""
        ended = self._read(state["ended"], f"{state['types']}, {FROM} {self.grain}, {TO} {self.grain}").withColumn(CURRENT, F.lit(False))
        return self._merged(state, self._folders(state, range(state["buckets"]))).unionByName(ended.select(self._columns()))

    def _folders(self, state: dict, buckets) -> list[str]:
        return [f"{state['live'][str(b)]}/{BUCKET}={b}" for b in buckets if str(b) in state["live"]]

    def current(self, state: dict, keys: DataFrame) -> DataFrame:
        """Current versions of some keys, read from their buckets and the deltas alone."""
        mine = [r[0] for r in keys.select(self._bucket(state["buckets"])).distinct().collect()]  # at most so many as there are buckets
        return self._merged(state, self._folders(state, sorted(mine)), keys).where(CURRENT)

    def stage(self, changes: DataFrame, name: str) -> str:
        """Writes a delta, which no state names yet; changes: key, tracked, effective_from (null: no new version) and ENDS (null: none ends). The same name is written over."""
        folder = f"delta/of={name}"
        changes.select(*self.key, *self.tracked, FROM, ENDS).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{folder}")
        return folder

    def adopted(self, whole: DataFrame, at: int) -> dict:
        """The history part of a state made from a whole history table."""
        state = self.begun(whole)
        live, ended = f"live/at={at}", f"ended/at={at}"
        rows = whole.select(*self.key, *self.tracked, F.col(FROM).cast(self.grain), F.col(TO).cast(self.grain), CURRENT)
        self._write_live(rows.where(CURRENT), live)
        rows.where(~F.col(CURRENT)).drop(CURRENT).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{ended}")
        return state | {"live": self._buckets_of(live, state), "ended": [ended]}

    def _write_live(self, rows: DataFrame, folder: str) -> None:
        dealt = rows.withColumn(BUCKET, self._bucket(self.buckets)).repartitionByRange(BUCKET, *self.key)
        dealt.drop(TO, CURRENT).write.mode("overwrite").option("compression", "zstd").partitionBy(BUCKET).parquet(f"{self.root}/{folder}")

    def _buckets_of(self, folder: str, state: dict) -> dict[str, str]:
        written = self._read([folder], f"{state['types']}, {FROM} {self.grain}, {BUCKET} int")
        return {str(r[0]): folder for r in written.select(BUCKET).distinct().collect()}  # at most so many as there are buckets

    def added(self, state: dict, folder: str, at: int) -> dict:
        """The state with one more delta, compacted where that is due or the number of buckets is another one."""
        state = state | {"deltas": [*state["deltas"], folder]}
        return self.compacted(state, at) if len(state["deltas"]) >= self.compact_after or state["buckets"] != self.buckets else state

    def compacted(self, state: dict, at: int) -> dict:
        """The state with all deltas applied. Writes the touched buckets (all of them if their number changes) and what has ended; a history that breaks an invariant is an error."""
        anew = state["buckets"] != self.buckets
        if not state["deltas"] and not anew:
            return state
        types = f"{state['types']}, {FROM} {self.grain}"
        if anew:
            touched = range(state["buckets"])
        else:
            keys = self._read(state["deltas"], f"{types}, {ENDS} {self.grain}")
            touched = sorted(r[0] for r in keys.select(self._bucket(state["buckets"])).distinct().collect())
        rows = self._merged(state, self._folders(state, touched))
        live, ended = f"live/at={at}", f"ended/at={at}"
        self._write_live(rows.where(CURRENT), live)
        rows.where(~F.col(CURRENT)).drop(CURRENT).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{ended}")
        written = self._read([live], f"{types}, {BUCKET} int")
        made = self._buckets_of(live, state)
        ends = self._read([ended], f"{types}, {TO} {self.grain}")
        both = written.select(*self.key, *self.tracked, FROM, F.lit(None).cast(self.grain).alias(TO), F.lit(True).alias(CURRENT)).unionByName(ends.withColumn(CURRENT, F.lit(False)))
        report = validate_history(both, self.key)
        if not passes(report):
            raise HistoryError(f"compaction breaks {[r.rule for r in report.where('status = ' + repr('fail')).collect()]}")
        kept = {} if anew else {b: f for b, f in state["live"].items() if int(b) not in touched}
        all_ended, gone = [*state["ended"], ended], [*state["deltas"], *[f"{f}/{BUCKET}={b}" for b, f in state["live"].items() if b not in kept]]
        if len(all_ended) > MOST_ENDED:
            one = f"ended/to={at}"
            self._read(all_ended, f"{types}, {TO} {self.grain}").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{one}")
            gone, all_ended = gone + all_ended, [one]
        garbage = [*state.get("garbage", []), *[[at, f] for f in gone]]
        return {"buckets": self.buckets, "live": kept | made, "ended": all_ended, "deltas": [], "types": state["types"], "garbage": garbage}

    def cleaned(self, state: dict, at: int) -> dict:
        """Deletes the folders that the last `keep` commits don't name any more."""
        old = [f for n, f in state.get("garbage", []) if n <= at - self.keep]
        for folder in old:
            delete(self.spark, f"{self.root}/{folder}")
        return state | {"garbage": [g for g in state.get("garbage", []) if g[1] not in old]}

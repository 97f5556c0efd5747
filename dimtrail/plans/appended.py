"""Histories that only grow: rows are checked while they are written, and count from one commit on.

A part is written in one job. The same job counts what no history may have (`history.APPEND_FAULTS`), so there is no pass before the
write and none after it; the counts decide whether the part is named by the next commit of the ledger or deleted. The counts are
taken in the job's last stage, where a task that is run again counts once."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimtrail.functions.text import any_null
from dimtrail.operators.changes import FROM, TO
from dimtrail.operators.history import APPEND_FAULTS, HistoryError
from dimtrail.sources.ledger import Ledger, delete, event

COUNTS = ("rows", "null_keys", *APPEND_FAULTS)
#: Names that the state holds; older ones are looked up in the events.
REMEMBERED = 500


class AppendedHistory:
    """key: columns that no row may lack. fan_in: so many parts of one level are merged into one of the next, so a row is written again
    log(parts) / log(fan_in) times and the state names at most fan_in parts a level."""

    def __init__(self, spark: SparkSession, root: str, key: Sequence[str], fan_in: int = 32):
        self.spark, self.root, self.key, self.fan_in = spark, root, list(key), fan_in
        self.ledger = Ledger(spark, root)

    def read(self) -> DataFrame | None:
        """All appended rows, None before the first part."""
        state = self.ledger.latest()[1]
        return self._read(state, [folder for level in state["parts"] for folder in level]) if state.get("parts") else None

    def _read(self, state: dict, folders: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(state["schema"])).parquet(*[f"{self.root}/{f}" for f in folders])

    def log(self) -> DataFrame:
        """at, name, status (APPENDED or REFUSED), the counts of COUNTS, first and last (dates that parts begin and end at), time: one row an attempt."""
        detail = F.from_json("detail", ", ".join(f"{c} long" for c in COUNTS) + ", first string, last string")
        rows = self.ledger.events().where("kind = 'append'").select("at", F.col("id").alias("name"), "status", detail.alias("d"), F.col("time").cast("timestamp").alias("time"))
        return rows.select("at", "name", "status", "d.*", "time")

    def _known(self, state: dict, name: str) -> bool:
        return name in state.get("names", ()) or (state.get("forgotten", False) and not self.log().where((F.col("name") == name) & (F.col("status") == "APPENDED")).isEmpty())

    def append(self, rows: DataFrame, name: str) -> str:
        """APPENDED, or SEEN if a part of this name was appended before. No rows are a part, too.

        Rows with another schema than the first part's (nullability aside), or with any of the faults, are an error: the part is deleted, the
        attempt stays in the log. Whether keys have one current row each is a matter of the whole history; validate_history says so."""
        n, state = self.ledger.latest()
        if self._known(state, name):
            return "SEEN"
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
        if state.get("schema", schema.jsonValue()) != schema.jsonValue():
            raise HistoryError(f"columns differ: {schema.simpleString()} for {T.StructType.fromJson(state['schema']).simpleString()}")
        seen = Observation()
        counts = [F.count(F.lit(1)).alias("rows"), F.count_if(any_null(self.key)).alias("null_keys"), *[F.expr(c).alias(k) for k, c in APPEND_FAULTS.items()]]
        dates = [F.min(FROM).cast("string").alias("first"), F.max(F.coalesce(TO, FROM)).cast("string").alias("last")]
        folder = f"parts/{n + 1}-{datetime.datetime.now(datetime.UTC):%Y%m%d%H%M%S%f}"
        rows.observe(seen, *counts, *dates).write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        told = seen.get
        faults = {k: told[k] for k in COUNTS[1:] if told[k]}
        if faults:
            delete(self.spark, f"{self.root}/{folder}")
            self.ledger.commit(n, state, [event("append", name, "REFUSED", **told)])
            raise HistoryError(f"rows refused: {faults}")
        parts = state.get("parts") or [[]]
        names = [*state.get("names", []), name]
        state = {"schema": schema.jsonValue(), "parts": [[*parts[0], folder], *parts[1:]], "names": names[-REMEMBERED:], "forgotten": state.get("forgotten", False) or len(names) > REMEMBERED}
        n = self.ledger.commit(n, state, [event("append", name, "APPENDED", **told)])
        self._merge(n, state)
        return "APPENDED"

    def _merge(self, n: int, state: dict) -> None:
        """Merges full levels. Folders that are no longer named stay until the next merge of their level, for readers that began before."""
        for level in range(len(state["parts"])):
            full = state["parts"][level]
            if len(full) < self.fan_in:
                break
            folder = f"parts/{n + 1}-merged-{level + 1}"
            self._read(state, full).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{folder}")
            above = state["parts"][level + 1] if level + 1 < len(state["parts"]) else []
            left = state.get("left", {})
            state = state | {"parts": [*state["parts"][:level], [], [*above, folder], *state["parts"][level + 2 :]], "left": left | {str(level): full}}
            n = self.ledger.commit(n, state, [])
            for old in left.get(str(level), ()):
                delete(self.spark, f"{self.root}/{old}")
        if n % self.fan_in == 0:
            self.ledger.fold(self.fan_in)

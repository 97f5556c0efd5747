"""Incremental history as a Structured Streaming query: read, compare, judge, then commit or hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from dimtrail.operators.containment import HELD
from dimtrail.operators.guardrail import Thresholds
from dimtrail.plans.held import HistoryStore


class HeldBatchError(RuntimeError):
    """A batch was held and the stream is to stop before it (hold mode block)."""


class HistoryStream:
    """Writes a stream of keyed rows into a stored history.

    A batch keeps the latest row of each key (by time, then by all values); rows older than their key's current version go
    to `late`; a batch that the guardrail finds suspicious is held. In mode block the query then fails, so that a
    restart meets the same offsets, until the hold is released or discarded; in mode divert it goes on. A batch that was committed or diverted
    is a no-op when it is replayed, and late, held and evidence rows of a batch are written over, not added to, when it is tried again. With
    grain timestamp versions begin and end at the last time of their batch, else at its date.

    A batch reads the current versions in the buckets of its keys and writes a delta of the keys that change; after compact_after
    deltas they are applied. The number of buckets is part of the stored state: with another one the next batch deals the current
    versions anew."""

    def __init__(self, root: str, key: Sequence[str], tracked: Sequence[str], at: str, thresholds: Thresholds = Thresholds(), mode: str = "block", grain: str = "date", buckets: int = 16, compact_after: int = 24, keep: int = 8):  # noqa: B008
        self.root, self.mode = root, mode
        self._store = lambda spark: HistoryStore(spark, root, key, tracked, at, thresholds, grain, buckets, compact_after, keep)

    def store(self, spark: SparkSession) -> HistoryStore:
        """The stored history: to be read, and to close holds."""
        return self._store(spark)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        if self.store(batch.sparkSession).take(batch, str(batch_id), self.mode) == HELD and self.mode == "block":
            raise HeldBatchError(f"batch {batch_id} is held")

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True, interval: str = "15 seconds") -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = 1) -> DataFrame:
    """Files as they come, so many in a batch; None takes all that are new."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(path)

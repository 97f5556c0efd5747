"""Streams as they come in, with the statistics of every micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dimtrail.functions.text import any_null, null_or_blank
from dimtrail.sources import sinks


class Landing:
    """Stores a stream's rows and, for every micro-batch, what was counted while they were written: one job for both.

    rows, null_keys, blanks (of each tracked column), first and last time, and the span in seconds. Rows and statistics of a batch lie in folders
    of its number, so a batch that is tried again is written over."""

    def __init__(self, root: str, key: Sequence[str], tracked: Sequence[str], at: str):
        self.root, self.key, self.tracked, self.at = root, list(key), list(tracked), at

    def process(self, batch: DataFrame, batch_id: int) -> None:
        seen, moment = Observation(), F.col(self.at).cast("timestamp")
        counts = [F.count(F.lit(1)).alias("rows"), F.count_if(any_null(self.key)).alias("null_keys"), F.unix_micros(F.min(moment)).alias("first"), F.unix_micros(F.max(moment)).alias("last")]
        counts += [F.count_if(null_or_blank(c)).alias(f"blank {c}") for c in self.tracked]
        sinks.put_rows(batch.observe(seen, *counts), f"{self.root}/rows", str(batch_id))
        told = seen.get
        blanks = [(c, told[f"blank {c}"]) for c in self.tracked]
        row = [(batch_id, told["rows"], told["null_keys"], told["first"], told["last"], blanks)]
        stats = batch.sparkSession.createDataFrame(row, "batch long, rows long, null_keys long, first long, last long, blanks array<struct<column:string,n:long>>")
        micros = [F.timestamp_micros(c).alias(c) for c in ("first", "last")]
        sinks.put_rows(stats.select("batch", "rows", "null_keys", *micros, "blanks").coalesce(1), f"{self.root}/statistics", str(batch_id))

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True, interval: str = "15 seconds") -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()

    def statistics(self, spark: SparkSession, before: int = 5) -> DataFrame:
        """batch, rows, null_keys, first, last, blanks, and beside them per_second, the mean rows of up to `before` earlier batches (usual), and whether the batch begins before the last time of an earlier one (overlapping).

        One row a batch; batches are few against their rows."""
        order = Window.orderBy("batch")
        earlier = order.rowsBetween(Window.unboundedPreceding, -1)
        span = (F.unix_micros("last") - F.unix_micros("first")) / 1e6
        rows = sinks.read_rows(spark, f"{self.root}/statistics")
        return rows.withColumn("per_second", F.col("rows") / F.greatest(span, F.lit(1.0))).withColumn("usual", F.avg("rows").over(order.rowsBetween(-before, -1))).withColumn("overlapping", F.coalesce(F.col("first") < F.max("last").over(earlier), F.lit(False)))

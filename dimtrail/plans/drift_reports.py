"""Stored drift reports: two versions of a schema against a mapping, listed by page, and the gate that the newest one is."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimtrail.operators import drift
from dimtrail.operators.containment import filtered, page_with_total
from dimtrail.operators.fingerprint import schema_fingerprints
from dimtrail.sources import sinks
from dimtrail.sources.ledger import exists

REPORT = "source string, overall string, needs_review boolean, summary string, report string, prior_version int, current_version int, prior_fingerprint string, current_fingerprint string, mapping string, time timestamp"


class DriftReports:
    """Reports lie in folders named by what they compare, so the same comparison again is the same report."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def add(self, prior: DataFrame, current: DataFrame, mapping: DataFrame, name: str) -> str:
        """Compares two registry versions of one source under a mapping (of drift.mapping_impact) called `name`; its events, the impact on each mapped column with
        possible replacements, and the report are stored. Returns the report's id."""
        ends = [r.first() for r in (schema_fingerprints(prior), schema_fingerprints(current))]
        if any(e is None for e in ends) or ends[0].source != ends[1].source:
            raise ValueError("a report needs two versions of one source")
        told = [e[c] for c in ("source", "version", "fingerprint") for e in ends] + [name]
        report = hashlib.sha256("\x1f".join(map(str, told)).encode()).hexdigest()
        events = drift.diff_schema(prior, current).persist()  # a few rows a column
        try:
            impact = drift.mapping_impact(events, mapping, drift.possible_renames(events))
            sinks.put_rows(events, f"{self.root}/events", report)
            sinks.put_rows(impact, f"{self.root}/impact", report)
            row = drift.drift_report(events, impact).where(F.col("source") == ends[0].source)
            added = {"report": report, "prior_version": ends[0].version, "current_version": ends[1].version, "prior_fingerprint": ends[0].fingerprint, "current_fingerprint": ends[1].fingerprint, "mapping": name}
            sinks.put_rows(row.select("*", *[F.lit(v).alias(k) for k, v in added.items()], F.current_timestamp().alias("time")).coalesce(1), f"{self.root}/reports", report)
        finally:
            events.unpersist()
        return report

    def reports(self) -> DataFrame:
        """All reports, none before the first."""
        at = f"{self.root}/reports"
        return self.spark.read.schema(REPORT).parquet(at).drop("of") if exists(self.spark, at) else self.spark.createDataFrame([], REPORT)

    def events(self, report: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/events/of={report}")

    def impact(self, report: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/impact/of={report}")

    def page(self, n: int, offset: int = 0, **wanted) -> DataFrame:
        """The newest reports that have the values asked for (source=, overall=, needs_review=, mapping=), with the number of all such."""
        return page_with_total(filtered(self.reports(), **wanted), "time", "report", n, offset)

    def require_unbroken(self, source: str, mapping: str) -> None:
        """The gate before a source's rows go through a mapping: an error if its newest report says BROKEN."""
        newest = filtered(self.reports(), source=source, mapping=mapping).orderBy(F.col("current_version").desc(), F.col("time").desc()).limit(1)
        drift.require_unbroken(newest)

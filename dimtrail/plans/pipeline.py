"""The batch pipeline: contract, reuse, change detection, staged history, invariants, promotion."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimtrail.operators import contracts
from dimtrail.operators.changes import change_summary, classify_changes
from dimtrail.operators.drift import require_unbroken
from dimtrail.operators.fingerprint import execution_fingerprint
from dimtrail.operators.guardrail import Thresholds, decide, evidence
from dimtrail.operators.history import apply_history
from dimtrail.operators.invariants import passes, validate_history
from dimtrail.operators.keys import detect_keys
from dimtrail.operators.onboarding import TRACKED_FIELDS, canonical_batch
from dimtrail.sources import sinks


@dataclass
class RunResult:
    status: str  # promoted, reused, rejected or invalid
    fingerprint: str
    version: int | None = None
    summary: dict | None = None
    report: DataFrame | None = None
    findings: DataFrame | None = None


def run_pipeline(source: DataFrame, target: DataFrame, root: str, date: datetime.date, key: Sequence[str] | None = None, tracked: Sequence[str] | None = None, mode: str = "full", policy: str = "soft_delete", contract: contracts.Contract | None = None) -> RunResult:
    """Runs a snapshot into the history under `root`.

    A rejected contract leaves a quarantine table; equal inputs and parameters give the earlier result; a history that breaks
    an invariant is reported and not promoted. Every run but a reused one leaves a row in the runs table."""
    spark = source.sparkSession
    if key is None:
        key, tracked = detect_keys(source, target)
    tracked = list(tracked or [c for c in source.columns if c not in key])
    settings = {"date": date.isoformat(), "mode": mode, "policy": policy, "key": ",".join(key), "tracked": ",".join(tracked)}
    if contract is not None:
        findings = contracts.contract_findings(source, contract)
        if contracts.outcome(findings).first().outcome == contracts.REJECTED:
            sinks.append_rows(contracts.quarantine_rows(findings, root.rsplit("/", 1)[-1]), f"{root}/quarantine")
            sinks.write_run(spark, root, f"rejected-{uuid.uuid4().hex}", "rejected", None, None, {}, settings)
            return RunResult("rejected", "", findings=findings)
    mark = execution_fingerprint(source, target, date.isoformat(), mode, policy, key, tracked).first().fingerprint
    if sinks.committed_batch(spark, root, mark):
        return RunResult("reused", mark, version=sinks.current_version(spark, root)["version"])
    changes = classify_changes(source, target, key, tracked, mode, policy)
    sinks.write_change_log(changes.where("change_type != 'UNCHANGED'"), f"{root}/changes/{mark}")
    version, staged, rows = sinks.stage_version(apply_history(source, target, key, tracked, date, mode, policy, check=False), root)
    report = validate_history(staged, key)
    sinks.write_report(report, f"{root}/validation/{mark}")
    summary = change_summary(changes).first().asDict()
    if not passes(report):
        sinks.write_run(spark, root, mark, "invalid", None, rows, summary, settings)
        return RunResult("invalid", mark, report=report)
    sinks.promote(spark, root, version, mark, rows)
    sinks.write_run(spark, root, mark, "promoted", version, rows, summary, settings)
    return RunResult("promoted", mark, version, summary, report)


def integrate_batch(rows: DataFrame, history: DataFrame, key: Sequence[str], tracked: Sequence[str], date: datetime.date | datetime.datetime) -> tuple[DataFrame, DataFrame]:
    """Changes of an incremental batch, and the whole next history: keys the batch doesn't name pass through untouched."""
    touched = rows.select(*key).distinct().withColumn("__dt_touched", F.lit(True))
    marked = history.join(touched, list(key), "left").select(*history.columns, "__dt_touched")
    mine, others = marked.where("__dt_touched").select(history.columns), marked.where("__dt_touched is null").select(history.columns)
    changes = classify_changes(rows, mine, key, tracked, "incremental", "ignore")
    return changes, others.unionByName(apply_history(rows, mine, key, tracked, date, "incremental", "ignore", check=False).select(*[F.col(c).cast(history.schema[c].dataType).alias(c) for c in history.columns]))


def integrate_canonical(records: DataFrame, history: DataFrame, date: datetime.date | datetime.datetime, report: DataFrame | None = None, thresholds: Thresholds = Thresholds()) -> tuple[DataFrame, DataFrame | None, DataFrame]:  # noqa: B008
    """Valid canonical records on their way into the customer history: changes, the next history (None if the batch is suspicious or breaks an invariant) and the judged evidence.

    A drift report that breaks the mapping stops the batch. The gate stands before anything is written."""
    if report is not None:
        require_unbroken(report)
    key, tracked = ["customer_id"], list(TRACKED_FIELDS)
    rows = canonical_batch(records)
    changes, staged = integrate_batch(rows.select(*key, *tracked), history, key, tracked, date)
    marked = changes.withColumn("batch", F.lit("canonical")).join(rows.select(*key, "created_at"), key, "left").persist()  # no more rows than the batch has
    checked = staged.persist()
    try:
        fine = passes(validate_history(checked, key))
        valid = records.sparkSession.createDataFrame([("canonical", fine)], "batch string, valid boolean")
        judged = decide(evidence(marked, "batch", key, "created_at", valid=valid), thresholds)
        told = judged.collect()  # a row, or none for an empty batch
    finally:
        checked.unpersist()
        marked.unpersist()
    return changes, staged if not told or told[0].decision == "NORMAL" else None, records.sparkSession.createDataFrame(told, judged.schema)

"""Deterministic guardrail: evidence of many change batches in grouped aggregates, seven rules, one decision for each batch."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dimtrail.functions.text import NUMBER, norm_text, relative_delta

PREFERRED_DISPERSION = "warehouse_id"
# What a status change to one of these counts as.
INACTIVE = ("INACTIVE", "DISCONTINUED", "DECOMMISSIONED", "CANCELLED", "CLOSED")


@dataclass(frozen=True)
class Thresholds:
    changed: int = 25
    ratio: float = 0.80
    ratio_rows: int = 10
    relative: float = 3.0
    absolute: float = 50
    deactivations: int = 5
    velocity: float = 50.0
    velocity_rows: int = 10
    dispersion: int = 5
    enabled: bool = True


def _number(c: Column) -> Column:
    text = norm_text(c)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def batch_counts(changes: DataFrame, batch: str, first_batch: Column | None = None) -> DataFrame:
    """(batch, evaluated, changed, new, unchanged, mutated, ratio): what an evaluation saw, ratio to 4 places. Deleted keys are no rows of the batch; in a first batch new rows are no mutation."""
    count = lambda k: F.count_if(F.col("change_type") == k)
    out = changes.groupBy(batch).agg(F.count_if(F.col("change_type") != "DELETED").alias("evaluated"), count("CHANGED").alias("changed"), count("NEW").alias("new"), count("UNCHANGED").alias("unchanged"), count("DELETED").alias("deleted"))
    start = (F.lit(False) if first_batch is None else first_batch) & (F.col("changed") == 0)
    mutated = F.col("changed") + F.when(start, 0).otherwise(F.col("new"))
    return out.withColumn("bootstrap", start).withColumn("mutated", mutated).withColumn("ratio", F.bround(F.col("mutated") / F.greatest("evaluated", F.lit(1)), 4))


def key_dispersion(changes: DataFrame, batch: str, key: Sequence[str], dispersion_key: str | None = None) -> DataFrame:
    """(batch, dispersion): distinct values among changed and new rows, of the given or preferred key column, else of the widest."""
    named = dispersion_key or (PREFERRED_DISPERSION if PREFERRED_DISPERSION in key else None)
    touched = F.col("change_type").isin("CHANGED", "NEW")
    counts = [F.count_distinct(F.when(touched, F.col(k))) for k in ([named] if named else key)]
    return changes.groupBy(batch).agg((F.greatest(*counts) if len(counts) > 1 else counts[0]).alias("dispersion"))


def _word_change(numeric: Column) -> Column:
    return ~numeric & F.col("old_value").isNotNull() & F.col("new_value").isNotNull() & (F.upper("old_value") != F.upper("new_value"))


def column_transitions(diffs: DataFrame, batch: str) -> DataFrame:
    """(batch, column, n): changes of a category to another one, whatever its case, by column; columns without any have no row."""
    numeric = _number(F.col("old_value")).isNotNull() & _number(F.col("new_value")).isNotNull()
    return diffs.where(_word_change(numeric)).groupBy(batch, "column").agg(F.count("*").alias("n"))


def field_evidence(diffs: DataFrame, batch: str) -> DataFrame:
    """(batch, largest relative and absolute swing, total absolute swing, worst column, categorical transitions, deactivations) from one row per changed field.

    Values that aren't finite numbers are categories."""
    old, new = _number(F.col("old_value")), _number(F.col("new_value"))
    numeric = old.isNotNull() & new.isNotNull()
    rel, size = F.when(numeric, relative_delta(old, new)), F.when(numeric, F.floor(F.abs(new - old)))
    words = _word_change(numeric)
    stopped = (F.lower("column") == "status") & (F.upper("old_value") == "ACTIVE") & F.upper("new_value").isin(*INACTIVE)
    return diffs.groupBy(batch).agg(
        F.coalesce(F.max(rel), F.lit(0.0)).alias("max_relative"),
        F.coalesce(F.max(size), F.lit(0)).alias("max_absolute"),
        F.coalesce(F.sum(size), F.lit(0)).alias("total_absolute"),
        F.max_by(F.when(numeric, F.col("column")), F.when(numeric, F.struct(rel, F.col("column")))).alias("worst_column"),
        F.count_if(words).alias("transitions"),
        F.count_if(stopped).alias("deactivations"),
    )


def per_column_changes(diffs: DataFrame, batch: str) -> DataFrame:
    return diffs.groupBy(batch, "column").agg(F.count("*").alias("n"))


def velocity(times: DataFrame, batch: str, at: str) -> DataFrame:
    """(batch, window_seconds) between a batch's first and last time."""
    return times.groupBy(batch).agg((F.unix_micros(F.max(F.col(at).cast("timestamp"))) - F.unix_micros(F.min(F.col(at).cast("timestamp")))).alias("us")).select(batch, (F.col("us") / 1e6).alias("window_seconds"))


def evidence(changes: DataFrame, batch: str, key: Sequence[str], at: str | None = None, first_batch: Column | None = None, dispersion_key: str | None = None, valid: DataFrame | None = None) -> DataFrame:
    """One row a batch with all that the rules look at; changes has batch, key, change_type, field_changes and perhaps times. valid: (batch, valid)."""
    out = batch_counts(changes, batch, first_batch).join(key_dispersion(changes, batch, key, dispersion_key), batch, "left")
    diffs = changes.where(F.size("field_changes") > 0).select(batch, F.inline("field_changes"))
    out = out.join(field_evidence(diffs, batch), batch, "left")
    out = out.join(velocity(changes, batch, at), batch, "left") if at else out.withColumn("window_seconds", F.lit(0.0))
    out = out.join(valid, batch, "left") if valid is not None else out.withColumn("valid", F.lit(True))
    out = out.fillna(0, ["max_relative", "max_absolute", "total_absolute", "transitions", "deactivations"]).withColumn("valid", F.coalesce("valid", F.lit(True)))
    out = out.withColumn("dispersion", F.when(F.col("bootstrap"), 0).otherwise(F.coalesce("dispersion", F.lit(0))))
    return out.withColumn("changes_per_second", F.bround(F.col("changed") / F.greatest(F.coalesce("window_seconds", F.lit(0.0)), F.lit(1.0)), 2))


def decide(rows: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:  # noqa: B008
    """Adds rules (triggered, by name), severity and decision. Thresholds come from columns limit_<name> where rows has them, for several monitors at once."""
    limit = {f.name: F.col(f"limit_{f.name}") if f"limit_{f.name}" in rows.columns else F.lit(getattr(thresholds, f.name)) for f in fields(Thresholds)}
    rules = {
        "HIGH_CHANGE_VELOCITY": (F.col("changed") >= limit["velocity_rows"]) & (F.col("changes_per_second") > limit["velocity"]),
        "HIGH_CHANGE_VOLUME": F.col("changed") > limit["changed"],
        "HIGH_POPULATION_IMPACT": (F.col("evaluated") >= limit["ratio_rows"]) & (F.col("ratio") > limit["ratio"]),
        "LARGE_QUANTITY_SWING": (F.col("max_relative") > limit["relative"]) & (F.col("max_absolute") >= limit["absolute"]),
        "MASS_DEACTIVATION": F.col("deactivations") > limit["deactivations"],
        "SCD2_VALIDATION_FAILURE": ~F.col("valid"),
        "WIDE_GEOGRAPHIC_IMPACT": F.col("dispersion") > limit["dispersion"],
    }
    fired = F.array_compact(F.array(*[F.when(limit["enabled"] & cond, F.lit(name)) for name, cond in rules.items()]))
    has = lambda name: F.array_contains("rules", name)
    severity = F.when(has("SCD2_VALIDATION_FAILURE"), "CRITICAL").when((F.size("rules") >= 2) | has("MASS_DEACTIVATION"), "HIGH").when(F.size("rules") == 1, "MEDIUM").otherwise("LOW")
    return rows.withColumn("rules", fired).withColumn("severity", severity).withColumn("decision", F.when(F.size("rules") > 0, "SUSPICIOUS").otherwise("NORMAL"))


def rule_triggers(decided: DataFrame) -> DataFrame:
    return decided.select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def classification_metrics(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """One row: confusion counts and, in parts of 10,000, the usual ratios; null where a ratio has no base."""
    e, p = F.col(expected), F.col(predicted)
    counted = rows.agg(F.count_if(e & p).alias("tp"), F.count_if(~e & ~p).alias("tn"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"))
    part = lambda a, b: F.when(b > 0, F.floor(a * 10000 / b)).cast("bigint")
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counted.select("*", part(tp + tn, tp + tn + fp + fn).alias("accuracy"), part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(tn, tn + fp).alias("specificity"), part(2 * tp, 2 * tp + fp + fn).alias("f1"), part(fp, fp + tn).alias("fpr"), part(fn, fn + tp).alias("fnr"))


SLICES = 256


def latency_percentiles(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Count, mean, extremes and the values at index int(n * q) of the ordered values, for q of 0.5, 0.95 and 0.99. Null values don't count; a null group is one.

    Values are counted first. A group's values are then cut into SLICES by quantiles of a mergeable sketch, and each slice is ordered for itself behind
    the sum of those before it, so no task orders a whole group; the sketch decides on the cuts alone, results are exact."""
    marks = [f"__dt_g{k}" for k in range(len(group))]
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(m)) for g, m in zip(group, marks, strict=True)], F.lit(True))
    named = [F.col(g).alias(m) for g, m in zip(group, marks, strict=True)]
    counted = rows.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("__dt_value")).agg(F.count("*").alias("__dt_n"))
    cuts = counted.groupBy(*group).agg(F.array_distinct(F.percentile_approx("__dt_value", [k / SLICES for k in range(1, SLICES)], 10000)).alias("__dt_cuts")).select(*named, "__dt_cuts")
    v, n = F.col("__dt_value"), F.col("__dt_n")
    sliced = counted.join(cuts, same).withColumn("__dt_slice", F.size(F.filter("__dt_cuts", lambda c: c <= v))).select(*group, "__dt_value", "__dt_n", "__dt_slice")
    sums = sliced.groupBy(*group, "__dt_slice").agg(F.sum(n).alias("__dt_own"))
    whole = Window.partitionBy(*group)
    sums = sums.withColumn("upto", F.sum("__dt_own").over(whole.orderBy("__dt_slice"))).withColumn("total", F.sum("__dt_own").over(whole))
    sums = sums.select(*named, F.col("__dt_slice").alias("__dt_s"), (F.col("upto") - F.col("__dt_own")).alias("__dt_before"), "total")
    w = Window.partitionBy(*group, "__dt_slice").orderBy("__dt_value")
    placed = sliced.join(sums, same & (F.col("__dt_slice") == F.col("__dt_s"))).withColumn("upto", F.col("__dt_before") + F.sum("__dt_n").over(w))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("total") * q), v))
    return placed.groupBy(*group).agg(F.sum(n).alias("n"), (F.sum(v * n) / F.sum(n)).alias("mean"), F.min(v).alias("min"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max(v).alias("max"))

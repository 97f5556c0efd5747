"""Fixed-text narratives and explanations of changes and batches, and checks of stored explanations against evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def change_narratives(changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., narrative) of new, changed and deleted keys."""
    name = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("NULL"))) for k in key])
    parts = F.transform("field_changes", lambda c: F.concat(c.column, F.lit(" from '"), F.coalesce(c.old_value, F.lit("NULL")), F.lit("' to '"), F.coalesce(c.new_value, F.lit("NULL")), F.lit("'")))
    text = F.when(F.col("change_type") == "NEW", F.concat(F.lit("Record "), name, F.lit(" is new."))).when(F.col("change_type") == "DELETED", F.concat(F.lit("Record "), name, F.lit(" is gone from the source."))).otherwise(F.concat(F.lit("Record "), name, F.lit(" changed: "), F.array_join(parts, "; "), F.lit(".")))
    return changes.where("change_type != 'UNCHANGED'").select(*key, text.alias("narrative"))


def batch_narratives(decided: DataFrame, batch: str) -> DataFrame:
    """(batch, narrative) of decided evidence rows."""
    seen = F.concat(F.lit("Of "), F.col("evaluated").cast("string"), F.lit(" rows "), F.col("changed").cast("string"), F.lit(" changed and "), F.col("new").cast("string"), F.lit(" are new."))
    why = F.when(F.size("rules") > 0, F.concat(F.lit(" Held for "), F.array_join("rules", ", "), F.lit(" at severity "), "severity", F.lit("."))).otherwise(" No rule was triggered.")
    return decided.select(batch, F.concat(seen, why).alias("narrative"))


def grounding_flags(explained: DataFrame, rules: Sequence[str], text: str = "narrative") -> DataFrame:
    """Adds flags where a text contradicts its row: a rule named that wasn't triggered, another severity, normal called held or held called normal."""
    c = F.col(text)
    named = F.array_compact(F.array(*[F.when(c.contains(r), F.lit(r)) for r in rules]))
    levels = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
    said = [c.rlike(rf"\bseverity {level}\b") & (F.col("severity") != level) for level in levels]
    wrong: Column = said[0]
    for s in said[1:]:
        wrong = wrong | s
    return explained.withColumn("names_untriggered_rule", F.size(F.array_except(named, "rules")) > 0).withColumn("wrong_severity", wrong).withColumn("wrong_decision", (c.rlike(r"\bHeld\b") & (F.col("decision") == "NORMAL")) | (c.contains("No rule was triggered") & (F.col("decision") != "NORMAL")))


def batch_explanations(decided: DataFrame, batch: str, source: str, per_column: DataFrame | None = None) -> DataFrame:
    """(batch, summary, what_changed, why_flagged, points, validation, containment, decision, severity) of decided evidence rows, each from its row alone.

    A suspicious batch is told as held, another one as committed. points are short facts; those that are zero are left out. per_column: (batch, column, n)
    of changes, told in the order of the columns. A column `failures` (array of text) names broken invariants, if there is one."""
    text = lambda c: c.cast("string")
    share = F.concat(text(F.bround(F.col("ratio") * 100, 1).cast("decimal(38,1)")), F.lit("%"))
    rows = decided
    if per_column is not None:
        named = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", "n"))), lambda p: F.concat(p.column, F.lit(": "), text(p.n))), ", ")
        rows = rows.join(per_column.groupBy(batch).agg(named.alias("__dt_columns")), batch, "left")  # a batch has as many as it has columns
    else:
        rows = rows.withColumn("__dt_columns", F.lit(None).cast("string"))
    held = F.col("decision") != "NORMAL"
    who = F.concat(F.lit("Batch "), text(F.col(batch)), F.lit(f" of {source} is "))
    summary = F.when(held, F.concat(who, F.lit("held at severity "), "severity", F.lit(" because of "), F.array_join("rules", ", "), F.lit("."))).otherwise(F.concat(who, F.lit("committed.")))
    still = F.col("evaluated") - F.col("changed") - F.col("new")
    changed = F.concat(text(F.col("evaluated")), F.lit(" rows: "), text(F.col("changed")), F.lit(" changed, "), text(F.col("new")), F.lit(" new, "), text(still), F.lit(" as before; "), share, F.lit(" moved, over "), text(F.col("dispersion")), F.lit(" keys."))
    why = F.when(held, F.concat(F.lit("Triggered: "), F.array_join("rules", ", "), F.lit("."))).otherwise("Everything is within its limits.")
    point = lambda cond, *parts: F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    points = F.array_compact(
        F.array(
            point(F.lit(True), "evaluated: ", text(F.col("evaluated"))),
            point(F.lit(True), "share moved: ", share),
            point(F.col("deactivations") > 0, "deactivations: ", text(F.col("deactivations"))),
            point(F.col("max_absolute") > 0, "largest relative change: ", text(F.bround(F.col("max_relative") * 100, 1).cast("decimal(38,1)")), "%"),
            point(F.col("__dt_columns").isNotNull(), "by column: ", F.col("__dt_columns")),
            point(F.col("window_seconds") > 0, "window: ", text(F.floor("window_seconds")), " s"),
        )
    )
    broken = F.array_join("failures", "; ") if "failures" in decided.columns else F.lit("")
    validation = F.when(F.col("valid"), "All invariants of the history hold.").otherwise(F.concat_ws(": ", F.lit("Invariants of the history are broken"), F.nullif(broken, F.lit(""))))
    containment = F.when(held, "Its rows are kept frozen; history and cursor are as they were.").otherwise("Its rows are in the history; the cursor is at its last time.")
    return rows.select(batch, summary.alias("summary"), changed.alias("what_changed"), why.alias("why_flagged"), points.alias("points"), validation.alias("validation"), containment.alias("containment"), "decision", "severity")


# Words beside a rule's name that claim it was triggered, and phrases that say how a check or a batch ended.
CLAIMS_AFTER = ("TRIGGERED", "EXCEEDED", "BREACHED", "FLAGGED", "DETECTED", "CAUSED")
CLAIMS_BEFORE = ("TRIGGERED", "EXCEEDED", "BREACHED", "FLAGGED", "DETECTED", "DUE TO", "BECAUSE OF")
SAYS_FAILED = ("validation failed", "invariants failed", "invariants were violated")
SAYS_PASSED = ("validation passed", "invariants passed")
SAYS_COMMITTED = ("committed to history", "committed to inventory_history")


def grounding_violations(explained: DataFrame, evidence: DataFrame, batch: str, rules: Sequence[str]) -> DataFrame:
    """(batch, violation, claimed, expected): where a stored explanation says other things than the evidence of its batch; none for a sound one.

    explained: as batch_explanations gives it, whoever wrote it; evidence: batch, decision, severity, rules, valid. Missing texts claim nothing, a missing
    decision or severity is another one. An explanation without evidence, and evidence without an explanation, have no row."""
    facts = evidence.select(batch, F.col("decision").alias("__dt_decision"), F.col("severity").alias("__dt_severity"), F.col("rules").alias("__dt_rules"), F.col("valid").alias("__dt_valid"))
    both = explained.join(facts, batch)
    said = lambda *parts: F.concat_ws(" ", *parts)
    claims, checks, ends = F.upper(said("why_flagged", F.array_join("points", " "), "summary")), F.lower(said("validation", "summary")), F.lower(said("containment", "summary"))
    has = lambda c, words: F.greatest(*[c.contains(w) for w in words])
    row = lambda cond, name, claimed, expected: F.when(cond, F.struct(F.lit(name).alias("violation"), claimed.alias("claimed"), expected.alias("expected")))
    found = [row(~F.upper(c).eqNullSafe(F.upper(f"__dt_{c}")), f"{c.upper()}_IMMUTABILITY", F.col(c), F.col(f"__dt_{c}")) for c in ("decision", "severity")]
    for rule in rules:
        claimed = claims.rlike(rf"\b{rule}\b.*\b({'|'.join(CLAIMS_AFTER)})\b") | claims.rlike(rf"\b({'|'.join(CLAIMS_BEFORE)})\b.*\b{rule}\b")
        found.append(row(~F.array_contains("__dt_rules", rule) & claimed, "UNTRIGGERED_RULE_CLAIMED", F.lit(rule), F.array_join(F.array_sort("__dt_rules"), ",")))
    found.append(row(F.col("__dt_valid") & has(checks, SAYS_FAILED), "CONTRADICTED_VALIDATION_STATUS", F.lit("failed"), F.lit("passed")))
    found.append(row(~F.col("__dt_valid") & has(checks, SAYS_PASSED), "CONTRADICTED_VALIDATION_STATUS", F.lit("passed"), F.lit("failed")))
    found.append(row((F.col("__dt_decision") != "NORMAL") & has(ends, SAYS_COMMITTED), "CONTRADICTED_CONTAINMENT_STATUS", F.lit("committed"), F.lit("held")))
    return both.select(batch, F.inline(F.array_compact(F.array(*found))))

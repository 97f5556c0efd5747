"""Approval of mappings: reviewed proposals become a frozen version, known by its digest and bound to a schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dimtrail.operators.onboarding import CUSTOMER_V1, CanonicalField, FieldMapping, apply_mapping

# What a reviewer may decide.
DECISIONS = ("APPROVE", "OVERRIDE", "REJECT")


class ApprovalError(ValueError):
    """A mapping that may not be frozen, or a frozen one that doesn't fit."""


def reviewed(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """source_field, decision, target, score, ambiguous of every proposal: APPROVE takes its target, OVERRIDE another one with score 1, REJECT none.

    decisions: source_field, decision, target, at; the last of a field counts. Decisions on fields without a proposal are left out."""
    last = decisions.where(F.col("decision").isin(*DECISIONS)).groupBy("source_field").agg(F.max_by(F.struct("decision", F.col("target").alias("chosen")), F.struct("at", "decision")).alias("d")).select("source_field", "d.*")
    both = proposals.join(last, "source_field", "left")
    named = F.when(F.col("target") != "UNMAPPED", F.col("target"))
    target = F.when(F.col("decision") == "OVERRIDE", F.col("chosen")).when(F.col("decision") == "APPROVE", named)
    return both.select("source_field", "decision", target.alias("target"), F.when(F.col("decision") == "OVERRIDE", 1.0).otherwise(F.col("score")).alias("score"), "ambiguous")


def approval_findings(review: DataFrame, canonical: Sequence[CanonicalField] = CUSTOMER_V1, incomplete: bool = False) -> DataFrame:
    """(finding, field) that keep a review from being frozen: fields not reviewed, ambiguous ones approved as they are, unknown and repeated targets, and, unless incomplete, required fields without a source."""
    spark = review.sparkSession
    fields = spark.createDataFrame([(f.name, f.required) for f in canonical], "target string, required boolean")
    used = review.where("target is not null").groupBy("target").agg(F.count("*").alias("n"))
    named = lambda df, finding, column: df.select(F.lit(finding).alias("finding"), F.col(column).alias("field"))
    out = named(review.where("decision is null"), "unreviewed", "source_field")
    out = out.unionByName(named(review.where("ambiguous and decision = 'APPROVE'"), "unresolved_ambiguity", "source_field"))
    out = out.unionByName(named(used.join(fields, "target", "left_anti"), "unknown_target", "target"))
    out = out.unionByName(named(used.where("n > 1"), "duplicate_target", "target"))
    if not incomplete:
        out = out.unionByName(named(fields.where("required").join(used, "target", "left_anti"), "unmapped_required", "target"))
    return out


def _digest(rows: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(rows), "\n"), 256)


def frozen(review: DataFrame, steps: DataFrame, schema_fingerprint: str, canonical: Sequence[CanonicalField] = CUSTOMER_V1, incomplete: bool = False) -> DataFrame:
    """The version of a review: source_field, target, operations (JSON), score, schema_fingerprint, digest; an error names what keeps it from being frozen.

    steps: source_field, operations. The digest is over all rows and the fingerprint, so a version that was altered is known."""
    found = approval_findings(review, canonical, incomplete).limit(20).collect()
    if found:
        raise ApprovalError(f"not to be approved: {sorted(f'{r.finding}: {r.field}' for r in found)}")
    rows = review.where("target is not null").join(steps, "source_field", "left").select("source_field", "target", F.coalesce("operations", F.lit("[]")).alias("operations"), "score", F.lit(schema_fingerprint).alias("schema_fingerprint"))
    return rows.join(F.broadcast(rows.agg(_digest(F.collect_list(_row())).alias("digest"))))  # as many rows as a feed has columns


def _row() -> Column:
    return F.concat_ws("|", "source_field", "target", "operations", F.col("score").cast("string"), "schema_fingerprint")


def require_unaltered(version: DataFrame, schema_fingerprint: str) -> None:
    """Raises if a frozen version's rows aren't those that its digest is of, or if it is bound to another schema than the feed's."""
    row = version.agg(_digest(F.collect_list(_row())).alias("now"), F.min("digest").alias("then"), F.max("digest").alias("last"), F.min("schema_fingerprint").alias("a"), F.max("schema_fingerprint").alias("b")).first()
    if row.then is None or not row.now == row.then == row.last:
        raise ApprovalError("the version was altered after it was approved")
    if not row.a == row.b == schema_fingerprint:
        raise ApprovalError(f"the version is for schema {row.a}, the feed has {schema_fingerprint}")


def apply_version(feed: DataFrame, version: DataFrame, schema_fingerprint: str, ordinal: str) -> DataFrame:
    """apply_mapping with a frozen version, after its digest and its schema have been checked; operations are JSON pairs of name and argument."""
    import json

    require_unaltered(version, schema_fingerprint)
    rows = sorted(version.select("source_field", "target", "operations").collect())  # as many as a feed has columns
    mapping = [FieldMapping(r.target, (r.source_field,), tuple((name, argument) for name, argument in json.loads(r.operations))) for r in rows]
    return apply_mapping(feed, mapping, ordinal)

"""Schema registry rows, drift between versions, and its impact on mappings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dimtrail.functions.text import logical_type, null_or_blank, slug, token_similarity, type_compatible
from dimtrail.operators.onboarding import ALIASES

REGISTRY = "source string, version int, name string, type_name string, nullable boolean, ordinal int"
RANKS = {"COMPATIBLE": 0, "REVIEW": 1, "BROKEN": 2}


def snapshot_schema(df: DataFrame, source: str, version: int) -> DataFrame:
    """(source, version, name, slug, type, nullable, ordinal): nullable as observed, in one aggregate."""
    empty = df.agg(*[F.count_if(null_or_blank(c)).alias(c) for c in df.columns]).first() if df.columns else {}
    rows = [(source, version, f.name, f.dataType.simpleString(), bool(empty[f.name]), i) for i, f in enumerate(df.schema.fields)]
    return registry(df.sparkSession.createDataFrame(rows, REGISTRY))


def registry(rows: DataFrame) -> DataFrame:
    return rows.select("source", "version", "name", slug("name").alias("slug"), logical_type("type_name").alias("type"), "nullable", "ordinal")


def diff_schema(prior: DataFrame, current: DataFrame) -> DataFrame:
    """(source, slug, event, old, new): ADDED, REMOVED, TYPE_CHANGED, NULLABILITY_CHANGED; a column may have the last two at once."""
    a = prior.select("source", "slug", F.struct("type", "nullable").alias("a"))
    b = current.select("source", "slug", F.struct("type", "nullable").alias("b"))
    both = a.join(b, ["source", "slug"], "full_outer")

    def event(cond: Column, name: str, old: Column, new: Column) -> Column:
        return F.when(cond, F.struct(F.lit(name).alias("event"), old.cast("string").alias("old"), new.cast("string").alias("new")))

    there = F.col("a").isNotNull() & F.col("b").isNotNull()
    events = F.array_compact(F.array(event(F.col("a").isNull(), "ADDED", F.lit(None), F.col("b.type")), event(F.col("b").isNull(), "REMOVED", F.col("a.type"), F.lit(None)), event(there & (F.col("a.type") != F.col("b.type")), "TYPE_CHANGED", F.col("a.type"), F.col("b.type")), event(there & (F.col("a.nullable") != F.col("b.nullable")), "NULLABILITY_CHANGED", F.col("a.nullable"), F.col("b.nullable"))))
    return both.select("source", "slug", F.inline(events))


def possible_renames(events: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES, least: float = 0.6) -> DataFrame:
    """(source, removed, added, score): each removed column's best added one by name similarity; two names of one field count 0.88, types that don't fit cost 0.25. A source has as many pairs as its changed columns."""
    gone = events.where("event = 'REMOVED'").select("source", F.col("slug").alias("removed"), F.col("old").alias("t1"))
    come = events.where("event = 'ADDED'").select("source", F.col("slug").alias("added"), F.col("new").alias("t2"))
    known = F.lit(False)
    for target, others in aliases.items():
        known = known | (F.col("removed").isin(target, *others) & F.col("added").isin(target, *others))
    likeness = token_similarity("removed", "added")
    score = F.bround(F.when(known, F.greatest(likeness, F.lit(0.88))).otherwise(likeness) - F.when(type_compatible(F.col("t2"), F.col("t1")), 0.0).otherwise(0.25), 4)
    scored = gone.join(come, "source").withColumn("score", score).where(F.col("score") >= least)
    best = Window.partitionBy("source", "removed").orderBy(F.col("score").desc(), "added")
    return scored.withColumn("r", F.row_number().over(best)).where("r = 1").select("source", "removed", "added", "score")


def mapping_impact(events: DataFrame, mapping: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """(source, slug, target, impact): what drift does to mapped columns; the worst event of a column counts. mapping: source, slug, target, wanted (the canonical type), required.

    A removed column breaks its mapping, also that of an optional field; another type is to be reviewed if it can fill the field and breaks it if not.
    With renames (possible_renames of the events) also replacement and confidence: the added column that a removed one may have become, null if none."""
    rank = F.when(F.col("event") == "REMOVED", 2).when(F.col("event") == "TYPE_CHANGED", F.when(type_compatible(F.col("new"), F.col("wanted")), 1).otherwise(2)).when(F.col("event") == "NULLABILITY_CHANGED", F.when(F.col("required") & (F.col("new") == "true"), 1).otherwise(0)).otherwise(0)
    both = mapping.join(events, ["source", "slug"], "left").withColumn("rank", F.coalesce(rank, F.lit(0)))
    told = both.groupBy("source", "slug", "target").agg(F.max("rank").alias("rank")).select("source", "slug", "target", _rank_name(F.col("rank")).alias("impact"))
    if renames is None:
        return told
    return told.join(renames.select("source", F.col("removed").alias("slug"), F.col("added").alias("replacement"), F.col("score").alias("confidence")), ["source", "slug"], "left")


def _rank_name(rank: Column) -> Column:
    return F.when(rank == 2, "BROKEN").when(rank == 1, "REVIEW").otherwise("COMPATIBLE")


def drift_report(events: DataFrame, impact: DataFrame) -> DataFrame:
    """(source, overall, needs_review, summary): the worst impact and the counts of events."""
    counted = events.groupBy("source").agg(*[F.count_if(F.col("event") == e).alias(e) for e in ("ADDED", "REMOVED", "TYPE_CHANGED", "NULLABILITY_CHANGED")])
    worst = impact.groupBy("source").agg(F.max(F.when(F.col("impact") == "BROKEN", 2).when(F.col("impact") == "REVIEW", 1).otherwise(0)).alias("rank"))
    both = worst.join(counted, "source", "full_outer").fillna(0)
    summary = F.concat_ws(", ", *[F.concat(F.col(e).cast("string"), F.lit(f" {e.lower()}")) for e in ("ADDED", "REMOVED", "TYPE_CHANGED", "NULLABILITY_CHANGED")])
    return both.select("source", _rank_name(F.col("rank")).alias("overall"), (F.col("rank") > 0).alias("needs_review"), summary.alias("summary"))


def require_unbroken(report: DataFrame) -> None:
    """The gate before history: BROKEN drift stops a batch."""
    broken = [r.source for r in report.where("overall = 'BROKEN'").select("source").orderBy("source").limit(5).collect()]
    if broken:
        raise ValueError(f"schema drift breaks the mapping of {broken}")

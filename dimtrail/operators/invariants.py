"""The invariants of a Type-2 history, each as one row: rule, status (pass, fail, warn), issues, message."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimtrail.functions.text import any_null, no_null, null_or_blank
from dimtrail.operators.changes import CURRENT, FROM, TO, current_rows, duplicate_keys

RULES = ("schema_completeness", "one_current_per_key", "no_null_keys", "no_overlapping_dates", "date_consistency")


def reversed_dates() -> Column:
    """Closed rows that don't end after they began."""
    return ~F.col(CURRENT) & F.col(TO).isNotNull() & (F.col(FROM) >= F.col(TO))


def active_with_end() -> Column:
    return F.col(CURRENT) & F.col(TO).isNotNull()


def closed_without_end() -> Column:
    return ~F.col(CURRENT) & F.col(TO).isNull()


def neighbours(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Each row with the interval of the key's row before it, by begin and end, nulls last; rows with a null key part are left out."""
    order = Window.partitionBy(*key).orderBy(F.col(FROM).asc_nulls_last(), F.col(TO).asc_nulls_last())
    rows = df.where(no_null(key))
    return rows.withColumn("prev_from", F.lag(FROM).over(order)).withColumn("prev_to", F.lag(TO).over(order)).withColumn("position", F.row_number().over(order)).where("position > 1").drop("position")


def interval_relations(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., effective_from, relation) of neighbours: open_predecessor, overlap, adjacent or gap."""
    relation = F.when(F.col("prev_to").isNull(), "open_predecessor").when(F.col("prev_to") > F.col(FROM), "overlap").when(F.col("prev_to") == F.col(FROM), "adjacent").otherwise("gap")
    return neighbours(df, key).select(*key, FROM, "prev_from", "prev_to", relation.alias("relation"))


def overlaps(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return interval_relations(df, key).where(F.col("relation").isin("overlap", "open_predecessor"))


def multiple_current(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., n) of keys with more than one current row."""
    return duplicate_keys(current_rows(df), key)


def schema_findings(df: DataFrame, key: Sequence[str]) -> list[str]:
    """Missing columns and history columns of a wrong type."""
    wanted = {FROM: T.DateType, TO: T.DateType, CURRENT: T.BooleanType}
    types = {f.name: f.dataType for f in df.schema.fields}
    out = [f"{c} is missing" for c in (*key, *wanted) if c not in types]
    return out + [f"{c} is {types[c].simpleString()}" for c, t in wanted.items() if c in types and not isinstance(types[c], (t, T.TimestampType) if t is T.DateType else t)]


def validate_history(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """All five invariants, and as a warning the keys that are blank without being null. With missing columns only the first is judged.

    One aggregate over the rows, one over the key's neighbours; nothing is collected."""
    spark = df.sparkSession
    found = schema_findings(df, key)
    schema = "rule string, status string, issues bigint, message string"
    head = spark.createDataFrame([("schema_completeness", "fail" if found else "pass", len(found), "; ".join(found))], schema)
    if any(f.endswith("missing") for f in found):
        return head
    per_row = df.agg(
        F.count_if(any_null(key)).alias("null_keys"),
        F.count_if(~any_null(key) & F.greatest(*[null_or_blank(k).cast("int") for k in key], F.lit(0)).cast("boolean")).alias("blank_keys"),
        F.count_if(reversed_dates()).alias("reversed"),
        F.count_if(active_with_end()).alias("active_with_end"),
        F.count_if(closed_without_end()).alias("closed_without_end"),
    )
    order = Window.partitionBy(*key).orderBy(F.col(FROM).asc_nulls_last(), F.col(TO).asc_nulls_last())
    keyed = df.where(no_null(key)).select(*key, FROM, TO, CURRENT, F.lag(TO).over(order).alias("prev_to"), F.row_number().over(order).alias("position"))
    keyed = keyed.withColumn("overlap", (F.col("position") > 1) & (F.col("prev_to").isNull() | (F.col("prev_to") > F.col(FROM))))
    per_key = keyed.groupBy(*key).agg(F.count_if(F.col(CURRENT)).alias("current"), F.count_if(F.col("overlap")).alias("overlaps"))
    across = per_key.agg(F.count_if(F.col("current") > 1).alias("multiple"), F.coalesce(F.sum("overlaps"), F.lit(0)).alias("overlaps"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    rules = [
        ("one_current_per_key", F.col("multiple"), text(F.col("multiple"), " keys with more than one current row"), "fail"),
        ("no_null_keys", F.col("null_keys"), text(F.col("null_keys"), " rows with a null key"), "fail"),
        ("no_blank_keys", F.col("blank_keys"), text(F.col("blank_keys"), " rows with a blank key"), "warn"),
        ("no_overlapping_dates", F.col("overlaps"), text(F.col("overlaps"), " overlaps"), "fail"),
        ("date_consistency", F.col("reversed") + F.col("active_with_end") + F.col("closed_without_end"), text(F.col("reversed"), " reversed, ", F.col("active_with_end"), " active with an end, ", F.col("closed_without_end"), " closed without"), "fail"),
    ]
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.when(n > 0, bad).otherwise("pass").alias("status"), n.alias("issues"), F.when(n > 0, m).otherwise("").alias("message")) for r, n, m, bad in rules])
    return head.unionByName(per_row.crossJoin(across).select(F.inline(rows)))


def validation_summary(report: DataFrame) -> DataFrame:
    return report.agg(*[F.count_if(F.col("status") == s).alias(f"{s}_rules") for s in ("pass", "fail", "warn")], F.sum("issues").alias("issues"))


def passes(report: DataFrame) -> bool:
    return report.where("status = 'fail'").isEmpty()

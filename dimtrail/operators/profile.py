"""Column profiles: counts, frequent values and safe samples, all columns at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dimtrail.functions.text import date_pattern, logical_type, sample_value


def unpivoted(df: DataFrame, columns: Sequence[str], ordinal: str | None = None) -> DataFrame:
    """(column, value as text[, ordinal]) rows."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(*([F.col(ordinal).alias("ordinal")] if ordinal else []), F.inline(cells))


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """One row a column: type, totals, nulls, distinct values, uniqueness and text lengths. Cells are counted by value first, which keeps the shuffle to distinct values."""
    columns = columns or df.columns
    types = df.sparkSession.createDataFrame([(c, df.schema[c].dataType.simpleString()) for c in columns], "column string, type string")
    cells = unpivoted(df, columns)
    if approximate:
        grouped = cells.groupBy("column").agg(F.count("*").alias("total"), F.count_if(F.col("value").isNull()).alias("nulls"), F.approx_count_distinct("value").alias("distinct"), F.min(F.length("value")).cast("bigint").alias("min_length"), F.max(F.length("value")).cast("bigint").alias("max_length"))
    else:
        valued = cells.groupBy("column", "value").agg(F.count("*").alias("n"))
        grouped = valued.groupBy("column").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("value").alias("distinct"), F.min(F.length("value")).cast("bigint").alias("min_length"), F.max(F.length("value")).cast("bigint").alias("max_length"))
    filled = F.col("total") - F.col("nulls")
    return grouped.join(types, "column").select("column", logical_type("type").alias("type"), "total", "nulls", "distinct", F.when(filled > 0, F.floor(F.col("distinct") * 10000 / filled)).otherwise(0).cast("bigint").alias("uniqueness"), ((filled > 0) & (F.col("distinct") == filled)).alias("is_unique"), "min_length", "max_length")


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5, max_distinct: int = 25) -> DataFrame:
    """(column, rank, value, n, share in parts of 10,000): the k most frequent values of columns with at most max_distinct, null counting as one."""
    counted = unpivoted(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    sizes = counted.groupBy("column").agg(F.count("*").alias("distinct"), F.sum("n").alias("total")).where(F.col("distinct") <= max_distinct)
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc_nulls_first())
    few = counted.join(sizes, "column")
    return few.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k).select("column", "rank", "value", "n", F.floor(F.col("n") * 10000 / F.col("total")).cast("bigint").alias("share"))


def first_samples(df: DataFrame, columns: Sequence[str], ordinal: str, n: int = 5, policy: str = "masked") -> DataFrame:
    """(column, position, sample): the first n different values by ordinal, as the policy shows them."""
    firsts = unpivoted(df, columns, ordinal).where("value is not null").groupBy("column", "value").agg(F.min("ordinal").alias("at"))
    shown = None
    for c in columns:
        shown = F.when(F.col("column") == c, sample_value("value", policy, c)) if shown is None else shown.when(F.col("column") == c, sample_value("value", policy, c))
    local = _firsts(firsts, n)
    return local.select("column", F.col("position"), shown.alias("sample"))


def _firsts(firsts: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("column").orderBy("at", "value")
    return firsts.withColumn("position", F.row_number().over(order).cast("bigint")).where(F.col("position") <= n)


def date_patterns(df: DataFrame, columns: Sequence[str], ordinal: str, n: int = 100) -> DataFrame:
    """(column, pattern, n) among the first n values that aren't null."""
    order = Window.partitionBy("column").orderBy("ordinal")
    cells = unpivoted(df, columns, ordinal).where("value is not null").withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    return cells.select("column", date_pattern("value").alias("pattern")).where("pattern is not null").groupBy("column", "pattern").agg(F.count("*").alias("n"))


def without_secrets(df: DataFrame) -> DataFrame:
    """Columns whose names don't speak of secrets."""
    return df.select([c for c in df.columns if not any(w in c.lower() for w in ("pass", "secret", "token", "key", "auth", "cred"))])

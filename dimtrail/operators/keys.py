"""Finding keys and types, keyset pages and cursors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dimtrail.functions.text import norm_text
from dimtrail.operators.changes import METADATA
from dimtrail.operators.profile import unpivoted


# Ends of names that keys have.
KEY_ENDS = ("_id", "_key", "_code", "_no", "_num", "_number", "id", "key", "code")


def key_scores(source: DataFrame, target: DataFrame) -> DataFrame:
    """(column, score, is_key) of the shared columns: 30 for a name that ends like a key's, 15 more for id or key itself, 10 if no value repeats (null is a value).

    All columns with the best score are the key; if no column scores, the first by name is."""
    shared = sorted(c for c in source.columns if c in target.columns and c not in METADATA)
    if not shared:
        raise ValueError("no shared columns")
    name = {c: 30 * c.lower().endswith(KEY_ENDS) + 15 * (c.lower() in ("id", "key")) for c in shared}
    valued = unpivoted(source, shared).groupBy("column", "value").agg(F.count("*").alias("n"))  # no column multiplies the rows of another
    counted = valued.groupBy("column").agg((F.max("n") == 1).alias("unique"))
    named = source.sparkSession.createDataFrame(list(name.items()), "column string, points long")
    rows = named.join(F.broadcast(counted), "column", "left")  # as many rows as columns
    rows = rows.select("column", (F.col("points") + F.when(F.coalesce("unique", F.lit(True)), 10).otherwise(0)).alias("score"))
    best = F.max("score").over(Window.partitionBy())
    return rows.withColumn("is_key", F.when(best > 0, F.col("score") == best).otherwise(F.col("column") == shared[0]))


def detect_keys(source: DataFrame, target: DataFrame) -> tuple[list[str], list[str]]:
    """Key columns, and tracked columns: the source's others, without those that a history adds."""
    key = sorted(r["column"] for r in key_scores(source, target).where("is_key").collect())
    return key, sorted(c for c in source.columns if c not in key and c not in METADATA)


def after_cursor(df: DataFrame, at: str, keys: Sequence[str], cursor: Mapping | None) -> Column:
    """Rows after a (time, keys) cursor: later, or at the same time with larger keys; without keys later only; all without a cursor."""
    if cursor is None:
        return F.lit(True)
    moment = F.lit(cursor[at]).cast("timestamp")
    later = F.col(at).cast("timestamp") > moment
    if not all(k in cursor for k in keys):
        return later
    return later | ((F.col(at).cast("timestamp") == moment) & (F.struct(*keys) > F.struct(*[F.lit(cursor[k]).cast(df.schema[k].dataType).alias(k) for k in keys])))


def page_after(df: DataFrame, at: str, keys: Sequence[str], cursor: Mapping | None, n: int | None = None) -> DataFrame:
    """The next n rows in (time, keys) order."""
    rows = df.where(after_cursor(df, at, keys, cursor)).orderBy(at, *keys)
    return rows if n is None else rows.limit(n)


def cursor_bounds(df: DataFrame, at: str, keys: Sequence[str]) -> DataFrame:
    """First and last (time, keys) of a slice, in one row."""
    mark = F.struct(F.col(at).cast("timestamp").alias(at), *keys)
    return df.agg(F.min(mark).alias("first"), F.max(mark).alias("last"))


def latest_per_key(df: DataFrame, key: Sequence[str], at: str, ties: Sequence[str] = ()) -> DataFrame:
    """One row a key, the last by time and then by the tie columns. An aggregate, so hot keys combine before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(at, *ties)).alias("__dt_v")).select(*key, "__dt_v.*").select(df.columns)


def upsert(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The table with rows inserted or replaced by key."""
    return table.join(rows.select(*key), list(key), "left_anti").unionByName(rows)


def typed_columns(df: DataFrame, key: Sequence[str], tracked: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Keys as text, tracked columns of nothing but whole numbers as bigint and others as text; and (column, type) rows."""
    whole = lambda c: F.coalesce(F.bool_and(norm_text(c).isNull() | (norm_text(c).rlike(r"^[+-]?[0-9]{1,18}$"))), F.lit(False)) & (F.count(norm_text(c)) > 0)
    found = df.agg(*[whole(c).alias(c) for c in tracked])
    kinds = found.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.when(F.col(c), "bigint").otherwise("string").alias("type")) for c in tracked])))
    row = found.first()
    return df.select(*[F.col(k).cast("string").alias(k) for k in key], *[norm_text(c).cast("bigint").alias(c) if row[c] else F.col(c).cast("string").alias(c) for c in tracked]), kinds


def _counted_on(numbered: DataFrame, name: str) -> DataFrame:
    """Numbers without gaps from those of monotonically_increasing_id: a row's place in its partition, behind the partitions before it."""
    part = F.shiftrightunsigned("__dt_id", 33).cast("int")
    sizes = {r.p: r.n for r in numbered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row a partition
    starts, at = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append(at)
        at += sizes.get(p, 0)
    begin = F.get(F.array(*[F.lit(n).cast("long") for n in starts]), part) if starts else F.lit(0).cast("long")
    return numbered.withColumn(name, begin + F.col("__dt_id").bitwiseAND((1 << 33) - 1)).drop("__dt_id")


def with_ordinal(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Rows numbered from 0 without gaps in the order that Spark reads them: counts of the partitions first, then each row's place in its own.

    `df` must read the same rows in the same partitions each time, as files do. A sort doesn't; with_sorted_ordinal is for that."""
    return _counted_on(df.withColumn("__dt_id", F.monotonically_increasing_id()), name)


def with_sorted_ordinal(df: DataFrame, path: str, name: str = "row_index") -> DataFrame:
    """Rows of a sorted table numbered from 0 without gaps in its order.

    A sort samples the bounds of its ranges anew each time it runs, so its rows are written under `path` with their place, once; the partitions are counted there."""
    placed = df.withColumn("__dt_id", F.monotonically_increasing_id())
    placed.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return _counted_on(df.sparkSession.read.schema(placed.schema).parquet(path), name)


MOST_PREVIEWED = 200


def preview(df: DataFrame, order: Sequence[str], n: int = 100) -> DataFrame:
    """The first n rows in an order, never more than MOST_PREVIEWED."""
    return df.orderBy(*order).limit(max(0, min(n, MOST_PREVIEWED)))


def to_key_json(columns: Sequence[str]) -> Column:
    """Some columns as one JSON text, by name, nulls included."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def from_key_json(text: Column, schema: str) -> Column:
    """The struct that to_key_json wrote."""
    return F.from_json(text, schema)

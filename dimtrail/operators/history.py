"""Maintaining and reading Type-2 history: half-open validity intervals, an open end as null."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimtrail.functions.text import no_null
from dimtrail.operators.changes import CURRENT, FROM, METADATA, TO, HistoryError, check_inputs, classify_changes, current_rows, historical_rows, joined, require_unique


def validity_type(history: DataFrame) -> T.DataType:
    """The type of a history's validity columns: timestamps if it has them, else dates."""
    given = history.schema[FROM].dataType if FROM in history.columns else None
    return given if isinstance(given, T.TimestampType) else T.DateType()


def history_schema(source: DataFrame, target: DataFrame, key: Sequence[str], tracked: Sequence[str]) -> T.StructType:
    """Types of the next history: the source's, else the target's, else string. Validity is by date, or by timestamp where the target has timestamps."""
    types = {f.name: f.dataType for f in (*target.schema.fields, *source.schema.fields)}
    fields = [T.StructField(c, types.get(c, T.StringType())) for c in (*key, *tracked)]
    grain = validity_type(target)
    return T.StructType([*fields, T.StructField(FROM, grain), T.StructField(TO, grain), T.StructField(CURRENT, T.BooleanType())])


def apply_history(source: DataFrame, target: DataFrame, key: Sequence[str], tracked: Sequence[str], date: datetime.date | datetime.datetime, mode: str = "full", policy: str = "soft_delete", check: bool = True) -> DataFrame:
    """The next history: closed versions as they are, and of each current or new key its retained, closed and new rows, from one join.

    A target without is_current holds current rows only. Current rows with a null flag are an error, not lost."""
    check_inputs(source, target, key, tracked, mode, policy)
    if check:
        require_unique(source, target, key)
    schema = history_schema(source, target, key, tracked)
    kinds = {f.name: f.dataType for f in schema.fields}
    grain = schema[FROM].dataType
    day = F.lit(date).cast(grain)

    def row(side: str, begin: Column, end: Column, current: bool) -> Column:
        values = [F.col(f"{side}.{c}").cast(kinds[c]).alias(c) for c in (*key, *tracked)]
        return F.struct(*values, begin.cast(grain).alias(FROM), end.cast(grain).alias(TO), F.lit(current).alias(CURRENT))

    begin = F.col(f"t.{FROM}") if FROM in target.columns else F.lit(None)
    end = F.col(f"t.{TO}") if TO in target.columns else F.lit(None)
    retained, closed, fresh = row("t", begin, end, True), row("t", begin, day, False), row("s", day, F.lit(None), True)
    rows = F.when(F.col("change_type") == "NEW", F.array(fresh)).when(F.col("change_type") == "CHANGED", F.array(closed, fresh)).when(F.col("change_type") == "DELETED", F.array(closed)).otherwise(F.array(retained))
    live = joined(source, target, key, tracked, mode, policy).select(F.inline(rows))
    if CURRENT not in target.columns:
        return live
    return historical_rows(target).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]).unionByName(live)


def sorted_history(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in (*key, FROM)])


def history_delta(changes: DataFrame, policy: str = "soft_delete") -> DataFrame:
    """The keys with whether a row is inserted (NEW, CHANGED) and whether the current one is closed (CHANGED, DELETED under soft_delete)."""
    closing = ["CHANGED", "DELETED"] if policy == "soft_delete" else ["CHANGED"]
    marked = changes.withColumn("inserts", F.col("change_type").isin("NEW", "CHANGED")).withColumn("closes", F.col("change_type").isin(*closing))
    return marked.where("inserts or closes").drop("field_changes")


def close_versions(history: DataFrame, keys: DataFrame, key: Sequence[str], at: datetime.date | datetime.datetime) -> DataFrame:
    """The history with the current rows of `keys` ended."""
    marked = history.join(keys.select(*key).distinct().withColumn("__dt_close", F.lit(True)), list(key), "left")
    ends = F.coalesce("__dt_close", F.lit(False)) & F.col(CURRENT)
    return marked.select(*[F.when(ends, F.lit(at).cast(validity_type(history))).otherwise(F.col(c)).alias(c) if c == TO else F.when(ends, False).otherwise(F.col(c)).alias(c) if c == CURRENT else F.col(c) for c in history.columns])


#: What no appended row may be: counts, as SQL, that a write can observe.
APPEND_FAULTS = {
    "reversed": f"count_if({FROM} >= {TO})",
    "active_with_end": f"count_if({CURRENT} and {TO} is not null)",
    "closed_without_end": f"count_if(not {CURRENT} and {TO} is null)",
    "without_begin_or_flag": f"count_if({FROM} is null or {CURRENT} is null)",
}


def append_guard(rows: DataFrame) -> None:
    """Raises on rows that no history may get: reversed, active with an end, closed without, without a begin or flag."""
    bad = rows.agg(*[F.expr(c).alias(name) for name, c in APPEND_FAULTS.items()]).first().asDict()
    if any(bad.values()):
        raise HistoryError(f"rows refused: {bad}")


def as_of(history: DataFrame, at) -> DataFrame:
    """The rows valid at a point in time."""
    point = F.lit(at)
    return history.where((F.col(FROM) <= point) & (F.col(TO).isNull() | (F.col(TO) > point)))


def as_of_join(events: DataFrame, history: DataFrame, key: Sequence[str], at: str) -> DataFrame:
    """Every event with the version of its key that was valid at its time, the one that began last if several; null columns if none.

    One sort of both sides by key and time instead of a range join: each event takes the last version that began by then,
    which is the valid one unless it has ended. Events of keys whose versions overlap, if there are any, take theirs by a
    range join."""
    rest = [c for c in history.columns if c not in key]
    begun = Window.partitionBy(*key).orderBy(FROM, F.col(TO).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    some = history.where(F.coalesce(F.col(TO) > F.col(FROM), F.lit(True)) & no_null(key))
    reach = F.max(F.coalesce(F.col(TO).cast("timestamp"), F.lit("9999-12-31").cast("timestamp"))).over(begun)
    nested = some.withColumn("__dt_reach", reach).where(F.col(FROM).cast("timestamp") < F.col("__dt_reach")).select(*key).distinct()
    if not nested.isEmpty():
        apart = events.join(nested, list(key), "left_anti").select(events.columns)
        mine = events.join(nested, list(key), "left_semi").select(events.columns)
        fits = reduce(lambda a, b: a & b, [F.col(f"e.{k}") == F.col(f"h.{k}") for k in key]) & (F.col(f"h.{FROM}").cast("timestamp") <= F.col(f"e.{at}").cast("timestamp")) & (F.col(f"h.{TO}").isNull() | (F.col(f"h.{TO}").cast("timestamp") > F.col(f"e.{at}").cast("timestamp")))
        same = mine.groupBy(*mine.columns).agg(F.count("*").alias("__dt_n"))  # equal events have equal versions
        wide = same.alias("e").join(some.join(nested, list(key), "left_semi").alias("h"), fits, "left")
        best = wide.groupBy(*[F.col(f"e.{c}") for c in same.columns]).agg(F.max_by(F.struct(*[F.col(f"h.{c}") for c in rest]), F.struct(F.col(f"h.{FROM}"), F.coalesce(F.col(f"h.{TO}").cast("timestamp"), F.lit("9999-12-31").cast("timestamp")))).alias("__dt_v"))
        found = best.select(*mine.columns, "__dt_v", F.explode(F.sequence(F.lit(1), F.col("__dt_n").cast("int")))).select(*mine.columns, *[F.col(f"__dt_v.{c}").alias(c) for c in rest])
        return as_of_join(apart, history.join(nested, list(key), "left_anti").select(history.columns), key, at).unionByName(found)
    event, version = F.struct(*events.columns), F.struct(*rest)
    empty_version, empty_event = F.lit(None).cast(history.select(version).schema[0].dataType), F.lit(None).cast(events.select(event).schema[0].dataType)
    left = events.select(*key, F.col(at).cast("timestamp").alias("__dt_at"), F.lit(1).alias("__dt_side"), event.alias("e"), empty_version.alias("v"))
    right = history.where(F.coalesce(F.col(TO) > F.col(FROM), F.lit(True))).select(*key, F.col(FROM).cast("timestamp").alias("__dt_at"), F.lit(0).alias("__dt_side"), empty_event.alias("e"), version.alias("v"))
    order = Window.partitionBy(*key).orderBy("__dt_at", "__dt_side").rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("v", F.last("v", ignorenulls=True).over(order)).where("e is not null")
    valid = (F.col(f"v.{TO}").isNull() | (F.col(f"v.{TO}").cast("timestamp") > F.col(f"e.{at}").cast("timestamp"))) & reduce(lambda a, b: a & b, [F.col(f"e.{k}").isNotNull() for k in key])
    return found.select("e.*", *[F.when(valid, F.col(f"v.{c}")).alias(c) for c in rest])


#: Slices of one key in as_of_join_spread.
MOST_SLICES = 64


def as_of_join_spread(events: DataFrame, history: DataFrame, key: Sequence[str], at: str, slice_rows: int = 1_000_000) -> DataFrame:
    """as_of_join for keys with very many events, on a history whose versions don't overlap: events of one key and time have one version, so each such point is
    looked up once, and a key's points are cut by time into slices of about slice_rows.

    Quantiles of the points' times, found by a mergeable sketch, are a key's cuts; a key with fewer points has none. The window that carries versions
    forward then runs in a slice, and a slice without a version of its own yet takes the last one of the slices before it. Events themselves move once,
    to their points, by key and time. Keys with cuts, and their slices, are 1 / slice_rows of the points and are broadcast. Results don't depend on the cuts."""
    rest = [c for c in history.columns if c not in key]
    parts = F.least(F.ceil(F.col("__dt_n") / slice_rows).cast("int"), F.lit(MOST_SLICES))
    seconds = F.unix_micros("__dt_at")
    moment = F.col(at).cast("timestamp")
    points = events.where(no_null(key) & moment.isNotNull()).select(*key, moment.alias("__dt_at")).distinct()
    counted = points.groupBy(*key).agg(F.count("*").alias("__dt_n"), F.percentile_approx(seconds, [k / MOST_SLICES for k in range(1, MOST_SLICES)], 10000).alias("__dt_q"))
    picked = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.get(F.col("__dt_q"), F.floor(i * MOST_SLICES / parts).cast("int") - 1))
    cuts = F.broadcast(counted.where(F.col("__dt_n") > slice_rows).select(*key, F.array_sort(F.array_distinct(picked)).alias("__dt_cuts")))
    slice_of = F.when(F.col("__dt_cuts").isNull(), 0).otherwise(F.size(F.filter("__dt_cuts", lambda c: c <= seconds)))
    lasting = history.where(F.coalesce(F.col(TO) > F.col(FROM), F.lit(True)) & no_null(key))
    version = F.struct(*rest)
    none = F.lit(None).cast(history.select(version).schema[0].dataType)
    left = points.join(cuts, list(key), "left").select(*key, slice_of.alias("__dt_slice"), "__dt_at", F.lit(1).alias("__dt_side"), none.alias("v"))
    right = lasting.withColumn("__dt_at", F.col(FROM).cast("timestamp")).join(cuts, list(key), "left").select(*key, slice_of.alias("__dt_slice"), "__dt_at", F.lit(0).alias("__dt_side"), version.alias("v"))
    order = Window.partitionBy(*key, "__dt_slice").orderBy("__dt_at", "__dt_side").rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("v", F.last("v", ignorenulls=True).over(order)).where("__dt_side = 1")
    tails = right.join(cuts.select(*key), list(key), "left_semi").groupBy(*key, "__dt_slice").agg(F.max_by("v", F.struct("__dt_at")).alias("__dt_tail"))
    slices = cuts.select(*key, F.explode(F.sequence(F.lit(0), F.size("__dt_cuts"))).alias("__dt_slice")).join(tails, [*key, "__dt_slice"], "left")
    before = Window.partitionBy(*key).orderBy("__dt_slice").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as a key has slices
    carried = slices.withColumn("__dt_carry", F.last("__dt_tail", ignorenulls=True).over(before)).where("__dt_carry is not null").drop("__dt_tail")
    found = found.join(F.broadcast(carried), [*key, "__dt_slice"], "left").withColumn("v", F.coalesce("v", "__dt_carry"))
    known = found.where(F.col(f"v.{TO}").isNull() | (F.col(f"v.{TO}").cast("timestamp") > F.col("__dt_at"))).where("v is not null").select(*key, "__dt_at", "v")
    return events.withColumn("__dt_at", moment).join(known, [*key, "__dt_at"], "left").select(*events.columns, *[F.col(f"v.{c}").alias(c) for c in rest])


def versions_of(history: DataFrame, keys: DataFrame, key: Sequence[str], current: bool = False) -> DataFrame:
    """The versions of some keys; the keys' side is broadcast only if Spark finds it small."""
    rows = history.where(F.col(CURRENT)) if current else history
    return rows.join(keys.select(*key).distinct(), list(key), "left_semi")


def version_counts(history: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    counts = [F.count("*").alias("versions"), F.count_if(F.col(CURRENT)).alias("active"), F.count_if(~F.col(CURRENT)).alias("historical")]
    return history.groupBy(*key).agg(*counts) if key else history.agg(*counts)


def view_versions(history: DataFrame, state: str = "all", sort_by: str | Sequence[str] = ()) -> DataFrame:
    rows = history if state == "all" else history.where(F.col(CURRENT) if state == "active" else ~F.col(CURRENT))
    return rows.orderBy(*([sort_by] if isinstance(sort_by, str) else sort_by)) if sort_by else rows


def versions_from_events(events: DataFrame, key: Sequence[str], at: str, tracked: Sequence[str], tie: str) -> DataFrame:
    """History made of dated facts: one version a key and day (the largest `tie` wins), each ending when the next begins."""
    daily = events.groupBy(*key, F.col(at).cast("date").alias(FROM)).agg(F.max_by(F.struct(*tracked), tie).alias("v"))
    order = Window.partitionBy(*key).orderBy(FROM)
    return daily.withColumn(TO, F.lead(FROM).over(order)).select(*key, "v.*", FROM, TO, F.col(TO).isNull().alias(CURRENT))


__all__ = ["APPEND_FAULTS", "METADATA", "append_guard", "apply_history", "as_of", "as_of_join", "classify_changes", "close_versions", "history_delta", "history_schema", "sorted_history", "version_counts", "versions_from_events", "versions_of", "view_versions"]

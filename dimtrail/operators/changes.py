"""Change detection: a source snapshot against the current rows of a Type-2 history."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dimtrail.functions.text import compares_as_text, differs, no_null, norm_text

FROM, TO, CURRENT = "effective_from", "effective_to", "is_current"
METADATA = (FROM, TO, CURRENT)
MODES, POLICIES = ("full", "incremental"), ("soft_delete", "ignore")


class DuplicateKeysError(ValueError):
    """A key stands in more than one row."""


class HistoryError(ValueError):
    """Inputs that can't be compared."""


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., n) of keys that repeat; keys with a null part don't count."""
    return df.where(no_null(key)).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(source: DataFrame, target: DataFrame, key: Sequence[str]) -> None:
    """Raises if keys repeat in the source or among the current rows of the target, with five of them, or if target rows lack is_current. One job for all."""
    names = F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("k")
    found = duplicate_keys(source, key).select(F.lit("source").alias("what"), names).unionByName(duplicate_keys(current_rows(target), key).select(F.lit("current target rows").alias("what"), names))
    if CURRENT in target.columns:
        found = found.unionByName(target.where(F.col(CURRENT).isNull()).select(F.lit(CURRENT).alias("what"), F.lit("").alias("k")))
    bad = found.limit(5).collect()
    if any(r.what == CURRENT for r in bad):
        raise HistoryError("rows without is_current")
    if bad:
        raise DuplicateKeysError(f"repeated keys: {sorted(f'{r.what}: {r.k}' for r in bad)}")


def current_rows(target: DataFrame) -> DataFrame:
    """Rows with is_current true; every row of a table without that column."""
    return target.where(F.col(CURRENT)) if CURRENT in target.columns else target


def historical_rows(target: DataFrame) -> DataFrame:
    return target.where(~F.col(CURRENT)) if CURRENT in target.columns else target.limit(0)


def check_inputs(source: DataFrame, target: DataFrame, key: Sequence[str], tracked: Sequence[str], mode: str, policy: str) -> None:
    if mode not in MODES or policy not in POLICIES:
        raise HistoryError(f"mode is one of {MODES}, policy one of {POLICIES}")
    for df, what in ((source, "source"), (target, "target")):
        lacking = [c for c in (*key, *tracked) if c not in df.columns]
        if lacking:
            raise HistoryError(f"{what} lacks {lacking}")
    if [c for c in METADATA if c in source.columns]:
        raise HistoryError("a source has no history columns")


def _value_pair(source: DataFrame, target: DataFrame, column: str) -> tuple[Column, Column]:
    """Old and new value as they are compared."""
    old, new = F.col(f"t.{column}"), F.col(f"s.{column}")
    if compares_as_text(target.schema[column].dataType, source.schema[column].dataType):
        return norm_text(old), norm_text(new)
    return old, new


def joined(source: DataFrame, target: DataFrame, key: Sequence[str], tracked: Sequence[str], mode: str, policy: str) -> DataFrame:
    """One full outer join of current target (t) and source (s) rows with change_type and field_changes. Null keys match nothing."""
    left = current_rows(target).select(F.struct(*target.columns).alias("t"), *[F.col(k).alias(f"__t_{k}") for k in key])
    right = source.select(F.struct(*key, *tracked).alias("s"), *[F.col(k).alias(f"__s_{k}") for k in key])
    both = left.join(right, reduce(lambda a, b: a & b, [F.col(f"__t_{k}") == F.col(f"__s_{k}") for k in key]), "full_outer")
    pairs = [(c, *_value_pair(source, target, c)) for c in tracked]
    changes = F.array_compact(F.array(*[F.when(differs(old, new), F.struct(F.lit(c).alias("column"), norm_text(old).alias("old_value"), norm_text(new).alias("new_value"))) for c, old, new in pairs]))
    deletes = mode == "full" and policy == "soft_delete"
    kind = F.when(F.col("t").isNull(), "NEW").when(F.col("s").isNull(), "DELETED" if deletes else "ABSENT").when(F.size("field_changes") > 0, "CHANGED").otherwise("UNCHANGED")
    return both.withColumn("field_changes", F.when(F.col("t").isNotNull() & F.col("s").isNotNull(), changes).otherwise(F.array().cast("array<struct<column:string,old_value:string,new_value:string>>"))).withColumn("change_type", kind)


def classify_changes(source: DataFrame, target: DataFrame, key: Sequence[str], tracked: Sequence[str], mode: str = "full", policy: str = "soft_delete", check: bool = True) -> DataFrame:
    """(key..., change_type, field_changes): NEW, CHANGED, UNCHANGED and, for full snapshots under soft_delete, DELETED keys.

    With `check`, repeated keys of the source or of current target rows are an error."""
    check_inputs(source, target, key, tracked, mode, policy)
    if check:
        require_unique(source, target, key)
    both = joined(source, target, key, tracked, mode, policy).where("change_type != 'ABSENT'")
    return both.select(*[F.coalesce(f"s.{k}", f"t.{k}").alias(k) for k in key], "change_type", "field_changes")


def change_summary(changes: DataFrame) -> DataFrame:
    """One row: counts by type and in total."""
    return changes.agg(*[F.count_if(F.col("change_type") == t.upper()).alias(f"{t}_rows") for t in ("new", "changed", "unchanged", "deleted")], F.count("*").alias("total_rows"))


def field_changes(changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row for each changed field."""
    return changes.select(*key, F.inline("field_changes"))

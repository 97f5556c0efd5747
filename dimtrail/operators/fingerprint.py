"""Digests of tables that do not depend on row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row_hashes(columns: Sequence[str]):
    """Xor, sum and count of row hashes: xor alone would lose pairs of equal rows."""
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])
    return F.concat_ws(":", F.coalesce(F.bit_xor(h), F.lit(0)).cast("string"), F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("string"), F.count("*").cast("string"))


def dataset_digest(df: DataFrame) -> DataFrame:
    """One row (digest): sha256 over schema, shape and rows, columns by name."""
    names = sorted(df.columns)
    schema = ",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in names)
    return df.agg(F.sha2(F.concat_ws("|", F.lit(schema), _row_hashes(names)), 256).alias("digest"))


def execution_fingerprint(source: DataFrame, target: DataFrame, date: str, mode: str, policy: str, key: Sequence[str], tracked: Sequence[str]) -> DataFrame:
    """One row (fingerprint) of inputs and parameters."""
    both = dataset_digest(source).select(F.col("digest").alias("s")).crossJoin(dataset_digest(target).select(F.col("digest").alias("t")))
    return both.select(F.sha2(F.concat_ws("|", "s", "t", F.lit(date), F.lit(mode), F.lit(policy), F.lit(",".join(key)), F.lit(",".join(sorted(tracked)))), 256).alias("fingerprint"))


def batch_fingerprints(df: DataFrame, batch: str, key: Sequence[str], at: str, source: str = "") -> DataFrame:
    """(batch, fingerprint) from each batch's source, size, first and last time and (key, time) rows in any order; not from what the batch is called, so that one that comes again is known."""
    ends = [F.min(at).cast("string"), F.max(at).cast("string")]
    return df.groupBy(batch).agg(F.sha2(F.concat_ws("|", F.lit(source), *ends, _row_hashes([*key, at])), 256).alias("fingerprint"))


def schema_fingerprints(registry: DataFrame) -> DataFrame:
    """(source, version, fingerprint) from the ordered column specifications."""
    spec = F.concat_ws(":", F.lpad(F.col("ordinal").cast("string"), 5, "0"), "slug", "type", F.col("nullable").cast("string"))
    return registry.groupBy("source", "version").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(spec)), "|"), 256).alias("fingerprint"))


def input_fingerprint(df: DataFrame) -> DataFrame:
    """One row (fingerprint) of a feed's content: names and values as text, rows in any order."""
    names = sorted(df.columns)
    return df.agg(F.sha2(F.concat_ws("|", F.lit(",".join(names)), _row_hashes(names)), 256).alias("fingerprint"))


def request_fingerprint(source: Column | str, schema_version: Column | str, mapping_version: Column | str, content: Column | str) -> Column:
    """What makes a request to onboard a feed the same request."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("\u0000")) for c in (source, schema_version, mapping_version, content)]), 256)

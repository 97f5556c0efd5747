"""Data contracts of a source snapshot, and quarantine of what breaks them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dimtrail.functions.text import null_or_blank
from dimtrail.operators.changes import METADATA

VERSION = 1
SAMPLES = 10
COMPATIBLE, WARNED, REJECTED = "compatible", "compatible_with_warning", "incompatible"


@dataclass(frozen=True)
class Contract:
    columns: tuple[tuple[str, str], ...]
    key: tuple[str, ...]
    tracked: tuple[str, ...]
    nullable: tuple[str, ...] = ()
    version: int = VERSION


def derive_contract(source: DataFrame, key: Sequence[str], tracked: Sequence[str]) -> Contract:
    """The contract that a source fulfils: its types, and which columns have nulls or blanks (one aggregate)."""
    names = [*key, *tracked]
    empty = source.agg(*[F.count_if(null_or_blank(c)).alias(c) for c in names]).first()
    return Contract(tuple((c, source.schema[c].dataType.simpleString()) for c in names), tuple(key), tuple(tracked), tuple(c for c in names if empty[c]))


def blank_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, blanks): null or blank values of each column, in one pass."""
    counted = df.agg(*[F.count_if(null_or_blank(c)).alias(c) for c in columns])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("blanks")) for c in columns])))


def repeated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., n) of keys that repeat, null parts included."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def schema_findings(df: DataFrame, contract: Contract) -> list[tuple[str, str, str]]:
    """(category, column, severity) of what the schema alone shows."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = dict(contract.columns)
    out = [("missing_column", c, "fail") for c in names if c not in types]
    out += [("history_column", c, "fail") for c in types if c in METADATA]
    out += [("unexpected_column", c, "warn") for c in types if c not in names and c not in METADATA]
    out += [("type_changed", c, "fail" if c in contract.key else "warn") for c, t in names.items() if c in types and types[c] != t]
    return out if contract.version == VERSION else [*out, ("contract_version", str(contract.version), "fail")]


def contract_findings(df: DataFrame, contract: Contract) -> DataFrame:
    """(category, column, severity, n, samples): schema findings, blanks where none are allowed with up to ten keys, and repeated keys."""
    spark = df.sparkSession
    out = spark.createDataFrame([(c, k, s, 1, []) for c, k, s in schema_findings(df, contract)], "category string, column string, severity string, n bigint, samples array<string>")
    present = set(df.columns)
    if not set(contract.key) <= present:
        return out
    shown = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in contract.key])
    strict = [c for c, _ in contract.columns if c in present and (c in contract.key or c not in contract.nullable)]
    blanks = df.select(shown.alias("k"), F.explode(F.array_compact(F.array(*[F.when(null_or_blank(c), F.lit(c)) for c in strict]))).alias("column"))
    blanks = _sampled(blanks)
    blanks = blanks.select(F.when(F.col("column").isin(*contract.key), "blank_key").otherwise("blank_value").alias("category"), "column", F.lit("fail").alias("severity"), "n", "samples")
    repeats = repeated_keys(df, contract.key).select(F.lit(",".join(contract.key)).alias("column"), shown.alias("k"))
    repeats = _sampled(repeats).select(F.lit("duplicate_key").alias("category"), "column", F.lit("fail").alias("severity"), "n", "samples")
    return out.unionByName(blanks).unionByName(repeats)


def _sampled(rows: DataFrame) -> DataFrame:
    """(column, n, samples) of (column, k) rows: the count and the ten smallest k."""
    local = rows.groupBy("column", "k").agg(F.count("*").alias("n"))
    counts = local.groupBy("column").agg(F.sum("n").alias("n"))
    ranked = local.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy("k"))).where(F.col("r") <= SAMPLES)
    return counts.join(ranked.groupBy("column").agg(F.array_sort(F.collect_list("k")).alias("samples")), "column")


def outcome(findings: DataFrame) -> DataFrame:
    """One row: compatible, compatible_with_warning or incompatible."""
    fails, warns = F.count_if(F.col("severity") == "fail"), F.count_if(F.col("severity") == "warn")
    return findings.agg(F.when(fails > 0, REJECTED).when(warns > 0, WARNED).otherwise(COMPATIBLE).alias("outcome"), fails.alias("failures"), warns.alias("warnings"))


def quarantine_rows(findings: DataFrame, source_name: str) -> DataFrame:
    """What a rejected batch leaves behind: categories, columns and sample keys, no row data."""
    return findings.where("severity = 'fail'").select(F.lit(source_name).alias("source"), "category", "column", "n", "samples")

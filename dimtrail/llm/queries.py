"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dimtrail.llm import conversations, decontaminate, html_text, language_model, line_templates, manifest, media, pieces, quality, secret_spans, simhash, sql, token_counts, unit_dedup
from dimtrail.llm.common import documents

TOKENIZERS = {"byte_bpe": "byte_bpe_50k.json", "pieces": "piece_bpe_32k.model"}


def tokenizer(kind: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZERS[kind])


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.with_quality(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "votes", "weak_label", "score", "keep")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_text.with_main_text(pages).select("page_id", "url", "text", "n_chars")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.with_prefix_counts(documents(spark, sf_dir).select("doc_id", "text"), tokenizer("byte_bpe"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op4_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.with_units_removed(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_removed", "removed", "text")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.with_contamination(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_templates.with_line_drops(documents(spark, sf_dir).select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", F.size("dropped_lines").cast("long").alias("n_dropped"), "dropped_lines", "repeated_lines", F.length("text").cast("long").alias("n_chars"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(documents(spark, sf_dir))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.with_media(documents(spark, sf_dir).select("doc_id", "text"), keep_media=False).drop("text")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.with_round_trip(documents(spark, sf_dir).select("doc_id", "text"), tokenizer("pieces")).drop("text")


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.with_scores(documents(spark, sf_dir))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = conversations.audits_of_all(talks, conversations.damaged(talks))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    proofs = manifest.inclusion_proofs(manifest.build_manifest(documents(spark, sf_dir), altered={"text": folded}))
    return proofs.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans.with_secrets(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


QUERIES = {f.__name__: f for f in (op1_quality, op2_html_text, op3_token_counts, op4_unit_dedup, op5_decontaminate, op6_line_templates, op7_simhash, op8_media, op9_pieces, op10_language_model, op11_conversations, op12_manifest, op13_secrets)}

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES = {
    "op5_decontaminate": f"""WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item_id, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0), unnest(range(1, len(w) - n + 2)) AS t(i)),
spots AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM d, (SELECT DISTINCT n FROM windows) AS s, unnest(range(1, len(w) - n + 2)) AS t(i)),
found AS (SELECT DISTINCT doc_id, spots.n, i, item_id FROM spots JOIN windows ON windows.n = spots.n AND windows.k = spots.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op11_conversations": sql.REPAIR,
    "op12_manifest": sql.MANIFEST,
}

"""Defined results for nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import pytest

from dimtrail.llm import decontaminate, html_text, language_model, line_templates, media, pieces, quality, secret_spans, simhash, token_counts, unit_dedup
from dimtrail.llm.queries import tokenizer

LONG = "Long winding words go on and on here. " * 9000
ROWS = [(1, "Some plain words to be read here."), (2, None), (3, ""), (4, LONG), (5, "Some plain words to be read here."), (1, "Some plain words to be read here."), (None, "No id but text."), (6, "   \n \t "), (7, "日本語 ▁ 🙂 \x00 ñ")]
SCHEMA = "doc_id bigint, text string"
BENCH = [(1, "some plain words"), (2, None), (3, ""), (None, "no id but"), (1, "some plain words")]


def operators(spark):
    bench = spark.createDataFrame(BENCH, "item_id bigint, text string")
    return {
        "quality": lambda d: quality.with_quality(d),
        "html": lambda d: html_text.with_main_text(d.withColumnRenamed("text", "html")),
        "tokens": lambda d: token_counts.with_prefix_counts(d, tokenizer("byte_bpe")),
        "units": lambda d: unit_dedup.with_units_removed(d),
        "bench": lambda d: decontaminate.with_contamination(d, bench),
        "lines": lambda d: line_templates.with_line_drops(d),
        "simhash": lambda d: simhash.near_duplicates(d),
        "keep_one": lambda d: simhash.keep_one(d),
        "media": lambda d: media.with_media(d),
        "pieces": lambda d: pieces.with_round_trip(d, tokenizer("pieces")),
        "scores": lambda d: language_model.with_scores(d),
        "secrets": lambda d: secret_spans.with_secrets(d),
    }


NAMES = ["quality", "html", "tokens", "units", "bench", "lines", "simhash", "keep_one", "media", "pieces", "scores", "secrets"]


@pytest.mark.parametrize("name", NAMES)
def test_edge_rows(spark, name):
    out = operators(spark)[name](spark.createDataFrame(ROWS, SCHEMA)).collect()
    # keep_one: 2, 3 and 6 have no words, 1 and 5 are copies and 1 stands twice; nulls stay
    assert len(out) == (5 if name == "keep_one" else len(ROWS))


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    df = operators(spark)[name](spark.createDataFrame([], SCHEMA))
    assert df.collect() == []
    assert "doc_id" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns(spark, name):
    clash = "doc_id bigint, text string, n_tokens string, score string, keep string, pieces string, th string, line string, n_chars bigint, removed string, component_id string, fp string, media string, spans string, dropped_lines string, n_words string, block string, start string, n_hex string, windows string, text_2 string"
    width = clash.count(",") + 1
    rows = [(i, t, *[None if "bigint" in c else "x" for c in clash.split(",")[2:]]) for i, t in ROWS]
    assert all(len(r) == width for r in rows)
    out = operators(spark)[name](spark.createDataFrame(rows, clash)).collect()
    assert len(out) == (5 if name == "keep_one" else len(ROWS))


def test_edge_values(spark):
    d = spark.createDataFrame(ROWS, SCHEMA)
    got = {(r.doc_id, r.text): r for r in token_counts.with_prefix_counts(d, tokenizer("byte_bpe")).collect()}
    assert got[2, None].n_tokens == got[3, ""].n_tokens == 0
    hit = {(r.doc_id, r.text): r for r in operators(spark)["bench"](d).collect()}
    assert hit[1, ROWS[0][1]].n_items == 1 and hit[1, ROWS[0][1]].contaminated
    assert hit[None, "No id but text."].n_items == 0 and hit[None, "No id but text."].n_hit == 3
    assert not hit[2, None].contaminated and hit[2, None].n_words == 0
    classes = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(d).collect()}
    assert classes[5, next(fp for i, fp in classes if i == 5)] == 1
    assert {c for (i, fp), c in classes.items() if fp == 0} == {2}
    scores = {r.doc_id: r for r in language_model.with_scores(d).collect()}
    assert scores[2].n_tokens == scores[3].n_tokens == 1
    kept = {r.doc_id: r.keep for r in quality.with_quality(d).collect()}
    assert not kept[2] and not kept[3] and not kept[6]
    cut = sorted(repr((r.doc_id, r.text and r.text[:20], r.n_removed)) for r in unit_dedup.with_units_removed(d).collect())
    first = "Some plain words to be read here."[:20]
    assert cut == sorted(repr(x) for x in [(1, first, 0), (1, first, 0), (2, None, 0), (3, "", 0), (4, LONG[:20], 8999), (5, "", 1), (None, "No id but text.", 0), (6, ROWS[7][1], 0), (7, ROWS[8][1], 0)])
    assert all(r.n_lines == (0 if r.text is None else r.text.count("\n") + 1) and r.dropped_lines == [] for r in operators(spark)["lines"](d).collect())
    shown = {r.doc_id: (r.text, r.n_chars) for r in operators(spark)["html"](d).collect()}
    assert shown[2] == shown[3] == shown[6] == ("", 0) and shown[1] == (ROWS[0][1], len(ROWS[0][1])) and shown[4][1] == len(LONG) - 1
    stored = {r.doc_id: r for r in operators(spark)["media"](d).collect()}
    assert stored[2].payload_sha256 == stored[3].payload_sha256 and (stored[2].n_bytes, stored[2].payload_bytes) == (0, 192) and stored[1].feature == stored[5].feature
    assert all(r.lossless for r in pieces.with_round_trip(d, tokenizer("pieces")).collect())


@pytest.mark.parametrize("k", range(5))
def test_stages_on_edge_rows(spark, tmp_path, k):
    """Nulls, empty and long texts, repeated rows and extra columns in every stage: what stays, and that an empty table stays empty."""
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[k]
    spark.createDataFrame(BENCH, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, th string, pieces string"
    rows = [(i, t, None, "s", None if t is None else len(t), "x", "y", "z") for i, t in ROWS]
    out = stage(spark, spark.createDataFrame(rows, schema), str(tmp_path))
    got = [r.doc_id for r in out.collect()]
    assert stage(spark, spark.createDataFrame([], schema), str(tmp_path)).collect() == []
    if k < 4:
        assert out.columns == [c.split()[0] for c in schema.split(", ")]
    if name == "quality":
        assert not {2, 3, 6} & set(got)
    elif name == "near_dedup":
        assert sorted(map(str, got)) == ["1", "2", "4", "7", "None"]
    elif name == "decontaminate":
        assert {1, 5} & set(got) == set() and {2, 3, 4, 6} <= set(got)
    else:
        assert len(got) == len(ROWS)

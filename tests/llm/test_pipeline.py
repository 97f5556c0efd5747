"""The pipeline's stages against plain Python, each on its own input."""

import corpus_pipeline
from dimtrail.llm import fingerprints
from tests.llm.test_operators import plain_components, plain_verdict


def test_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    given = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tiny)
        rows = out.collect()
        got = {r.doc_id: r for r in rows}
        assert len(got) == len(rows)
        if k < 4:
            assert out.columns == columns
        if name == "quality":
            assert all(got[i].text == given[i] for i in got)
            assert sum(labels[i] == 1 and i not in got for i in labels) <= 1
        elif name == "line_dedup":
            assert set(got) == set(given)
            for i, r in got.items():
                assert r.n_chars == len(r.text) and not set(r.text.split("\n")) - set(given[i].split("\n")) - {""}
        elif name == "near_dedup":
            ids = sorted(given)
            classes = plain_components([fingerprints.simhash(given[i]) for i in ids], 4)
            assert set(got) == {ids[c] for c in classes}
        elif name == "decontaminate":
            assert set(got) == {i for i, t in given.items() if not plain_verdict(t, items)[4]}
        else:
            assert set(got) == set(given) and all(r.n_pieces == len(r.pieces) for r in rows)
        if k < 4:
            docs = spark.createDataFrame(rows, out.schema)
            given = {r.doc_id: r.text for r in rows}


def test_run_is_the_stages(spark, tiny):
    assert corpus_pipeline.run(spark, tiny).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "pieces"]

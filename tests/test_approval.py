"""Frozen mappings, page chains, encodings, and as-of joins of hot keys."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from dimtrail.operators import approval
from dimtrail.operators.history import as_of_join, as_of_join_spread
from dimtrail.queries import files
from dimtrail.sources import readers, sinks

ALL = {"a": "customer_id", "b": "first_name", "c": "last_name", "d": "email", "e": "status", "f": "created_at"}


def review(spark, decided, proposals=None):
    proposals = proposals or [(s, t, 0.9, False) for s, t in ALL.items()]
    p = spark.createDataFrame(proposals, "source_field string, target string, score double, ambiguous boolean")
    d = spark.createDataFrame(decided, "source_field string, decision string, target string, at int")
    return approval.reviewed(p, d)


def found(df, **options):
    return sorted((r.finding, r.field) for r in approval.approval_findings(df, **options).collect())


def test_what_keeps_a_mapping_from_approval(spark):
    fine = [(s, "APPROVE", None, 1) for s in ALL]
    assert found(review(spark, fine)) == []
    assert found(review(spark, fine[1:])) == [("unmapped_required", "customer_id"), ("unreviewed", "a")]
    assert found(review(spark, [*fine, ("a", "REJECT", None, 2)])) == [("unmapped_required", "customer_id")]
    assert found(review(spark, [*fine, ("a", "REJECT", None, 2)]), incomplete=True) == []
    assert found(review(spark, [*fine, ("b", "OVERRIDE", "last_name", 2)])) == [("duplicate_target", "last_name"), ("unmapped_required", "first_name")]
    assert found(review(spark, [*fine, ("b", "OVERRIDE", "shoe", 2)]), incomplete=True) == [("unknown_target", "shoe")]
    doubtful = [(s, t, 0.9, s == "d") for s, t in ALL.items()]
    assert found(review(spark, fine, doubtful)) == [("unresolved_ambiguity", "d")]
    assert found(review(spark, [*fine, ("d", "OVERRIDE", "email", 2)], doubtful)) == []
    assert found(review(spark, [*fine, ("zzz", "APPROVE", "email", 1)])) == []


def test_frozen_versions(spark):
    rows = review(spark, [(s, "APPROVE", None, 1) for s in ALL])
    steps = spark.createDataFrame([("d", json.dumps([["NORMALIZE_EMAIL", None]]))], "source_field string, operations string")
    version = approval.frozen(rows, steps, "f1").cache()
    assert version.count() == 6 and version.select("digest").distinct().count() == 1
    again = approval.frozen(rows.orderBy(F.desc("source_field")), steps, "f1")
    assert again.first().digest == version.first().digest and approval.frozen(rows, steps, "f2").first().digest != version.first().digest
    feed = spark.createDataFrame([(1, "1", "A", "B", " X@Y.Z ", "ACTIVE", "2024-01-01")], "n int, a string, b string, c string, d string, e string, f string")
    assert approval.apply_version(feed, version, "f1", "n").first().email == "x@y.z"
    for bad in (version.withColumn("operations", F.lit("[]")), version.where("source_field != 'a'"), version.limit(0)):
        with pytest.raises(approval.ApprovalError):
            approval.apply_version(feed, bad, "f1", "n")
    with pytest.raises(approval.ApprovalError):
        approval.apply_version(feed, version, "f2", "n")
    with pytest.raises(approval.ApprovalError):
        approval.frozen(review(spark, []), steps, "f1")


def test_page_chains(spark, tmp_path):
    def put(name, pages):
        (tmp_path / name).mkdir()
        for k, page in enumerate(pages):
            (tmp_path / name / f"{k}.json").write_text(json.dumps({"page": k, **page}))
        return str(tmp_path / name)

    ids = lambda *a: {"data": [{"id": x} for x in a]}
    got = lambda path, **o: sorted(r.id for r in readers.read_pages(spark, path, **o).collect())
    short = put("short", [ids(1, 2), ids(3), ids(4, 5)])
    assert got(short, page_size=2) == [1, 2, 3] and got(short) == [1, 2, 3, 4, 5]
    assert got(put("empty", [ids(1, 2), ids(), ids(4, 5)])) == [1, 2]
    ended = put("ended", [ids(1, 2) | {"next": "x"}, ids(3, 4) | {"next": None}, ids(5, 6) | {"next": "y"}])
    assert got(ended, following="next", page_size=2) == [1, 2, 3, 4] and got(ended, following="next", most=3) == [1, 2, 3]


def test_pages_share_files(spark, tmp_path):
    """Thousands of pages are no more files than the write has tasks, and the chain still ends at its first short page."""
    keys = spark.range(20000).withColumnRenamed("id", "s_suppkey")
    keys.where("s_suppkey not between 9000 and 9002").repartition(3).write.parquet(str(tmp_path / "supplier.parquet"))
    at = str(tmp_path / "pages")
    rows = spark.read.parquet(str(tmp_path / "supplier.parquet")).selectExpr("s_suppkey div 5 page", "struct(s_suppkey id) r")
    sinks.write_pages(rows.groupBy("page").agg(F.array_sort(F.collect_list("r")).alias("data")), at)
    assert len(list((tmp_path / "pages").glob("*.json"))) <= 4
    assert sorted(r.id for r in readers.read_pages(spark, at, page_size=5, lines=True).collect()) == [*range(9000), 9003, 9004]
    assert [r.id for r in readers.read_pages(spark, at, most=7, lines=True).collect()] == list(range(7))


@pytest.mark.parametrize("name", ["chained_pages", "paged_feed", "json_envelope"])
def test_paged_queries_make_few_files(spark, tiny, tmp_path, monkeypatch, name):
    monkeypatch.setattr(files, "scratch", lambda _: str(tmp_path / "at"))
    monkeypatch.setattr(files, "PAGE_ROWS", 1)
    spark.range(400).selectExpr("id s_suppkey", "'x' s_name").write.parquet(str(tmp_path / "supplier.parquet"))
    files.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(list((tmp_path / "at").rglob("*.json"))) <= 4


def test_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("naïve;größe\nü;1\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("naïve,größe\nü,1\n".encode())
    for name in ("a", "b"):
        (row,) = readers.read_delimited(spark, str(tmp_path / f"{name}.csv")).collect()
        assert row.asDict() == {"naïve": "ü", "größe": "1"}
    (tmp_path / "c.csv").write_text('"one, two"\nx\n')
    assert readers.read_delimited(spark, str(tmp_path / "c.csv")).columns == ["one, two"]
    (tmp_path / "d.csv").write_text("only\nx\n")
    assert readers.read_delimited(spark, str(tmp_path / "d.csv")).first().only == "x"


@pytest.mark.parametrize("slice_rows", [1, 7, 50, 10_000])
def test_hot_key_as_of(spark, slice_rows):
    """Any slices give the rows of the plain join: hot keys, times on cuts, keys without versions, nulls."""
    rng = random.Random(slice_rows)
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    versions = []
    for key in ("hot", "cold", "x"):
        starts = sorted(rng.sample(range(60), 9))
        versions += [(key, k, day(a), day(b - (key == "x")) if b is not None and b - (key == "x") > a else None if b is None else day(b)) for k, (a, b) in enumerate(zip(starts, [*starts[1:], None], strict=True))]
    history = spark.createDataFrame([(*v, v[3] is None) for v in versions], "k string, v int, effective_from date, effective_to date, is_current boolean")
    events = [(i, rng.choice(["hot"] * 8 + ["cold", "x", "none", None]), rng.choice([day(rng.randint(-3, 62)), day(20)]) if rng.random() < 0.97 else None) for i in range(400)]
    events = spark.createDataFrame(events, "n int, k string, at date")
    want = sorted(map(repr, as_of_join(events, history, ["k"], "at").collect()))
    assert sorted(map(repr, as_of_join_spread(events, history, ["k"], "at", slice_rows).collect())) == want


def test_hot_key_as_of_orders_points_alone(spark):
    """A hot key's events don't go to tasks by their key: the window sees (key, time) points, cuts are broadcast whatever Spark thinks of their size."""
    day = datetime.date(2024, 1, 1)
    history = spark.createDataFrame([("hot", 1, day, None, True)], "k string, v int, effective_from date, effective_to date, is_current boolean")
    events = spark.range(3000).select("id", F.lit("hot").alias("k"), F.date_add(F.lit(day), (F.col("id") % 30).cast("int")).alias("at"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = as_of_join_spread(events, history, ["k"], "at", 10)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [last(v" in line]
        assert plan.count("strategy=broadcast") >= 3 and windows and not any("named_struct(id" in line for line in plan.splitlines())
        assert found.where("v = 1").count() == 3000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

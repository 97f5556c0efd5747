"""Change detection, history and invariants against truth tables and a plain-Python model."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from dimtrail.operators import changes, contracts, history, invariants, keys
from dimtrail.operators.changes import DuplicateKeysError, HistoryError

D0, D1 = datetime.date(2026, 1, 1), datetime.date(2026, 6, 8)
TARGET = "id string, city string, tier string, effective_from date, effective_to date, is_current boolean"
SOURCE = "id string, city string, tier string"


def frames(spark, source, target):
    return spark.createDataFrame(source, SOURCE), spark.createDataFrame(target, TARGET)


def current(i, city, tier):
    return (i, city, tier, D0, None, True)


def kinds(df):
    return {r.id: r.change_type for r in df.collect()}


def test_value_equality(spark):
    source, target = frames(spark, [("1", " Pune ", None), ("2", "pune", ""), ("3", "X", "A"), ("4", None, "A")], [current("1", "Pune", ""), current("2", "Pune", None), current("3", "X", "A"), current("4", "X", "A")])
    got = changes.classify_changes(source, target, ["id"], ["city", "tier"])
    assert kinds(got) == {"1": "UNCHANGED", "2": "CHANGED", "3": "UNCHANGED", "4": "CHANGED"}
    assert {(r.id, r.column, r.old_value, r.new_value) for r in changes.field_changes(got, ["id"]).collect()} == {("2", "city", "Pune", "pune"), ("4", "city", "X", None)}


def test_types_compare_as_text_when_they_differ(spark):
    source = spark.createDataFrame([("1", 100)], "id string, v bigint")
    target = spark.createDataFrame([("1", "100", D0, None, True)], "id string, v string, effective_from date, effective_to date, is_current boolean")
    assert kinds(changes.classify_changes(source, target, ["id"], ["v"])) == {"1": "UNCHANGED"}


@pytest.mark.parametrize(("mode", "policy", "deletes"), [("full", "soft_delete", True), ("full", "ignore", False), ("incremental", "soft_delete", False), ("incremental", "ignore", False)])
def test_deletes(spark, mode, policy, deletes):
    source, target = frames(spark, [("1", "a", "b")], [current("1", "a", "b"), current("2", "a", "b")])
    assert ("DELETED" in kinds(changes.classify_changes(source, target, ["id"], ["city", "tier"], mode, policy)).values()) == deletes


def test_null_keys_match_nothing(spark):
    source, target = frames(spark, [(None, "a", "b")], [current(None, "a", "b")])
    assert sorted(r.change_type for r in changes.classify_changes(source, target, ["id"], ["city", "tier"]).collect()) == ["DELETED", "NEW"]


def test_repeated_keys_abort(spark):
    source, target = frames(spark, [("1", "a", "b"), ("1", "c", "d")], [current("1", "a", "b")])
    with pytest.raises(DuplicateKeysError):
        changes.classify_changes(source, target, ["id"], ["city", "tier"])
    one, twice = frames(spark, [("1", "a", "b")], [current("1", "a", "b"), ("1", "o", "b", D0, D1, False), ("1", "p", "b", D0, D1, False)])
    assert kinds(changes.classify_changes(one, twice, ["id"], ["city", "tier"])) == {"1": "UNCHANGED"}


def test_bad_inputs(spark):
    source, target = frames(spark, [("1", "a", "b")], [("1", "a", "b", D0, None, None)])
    with pytest.raises(HistoryError):
        history.apply_history(source, target, ["id"], ["city", "tier"], D1)
    with pytest.raises(HistoryError):
        changes.classify_changes(source, target, ["id"], ["nope"])


def plain(source, target, mode, policy, date):
    """The next history as a loop over dicts."""
    norm = lambda v: (str(v).strip() or None) if v is not None else None
    now = {r[0]: r for r in target if r[5]}
    out = [r for r in target if not r[5]]
    new = {r[0]: r for r in source}
    for k, r in now.items():
        s = new.get(k)
        if s is None:
            out.append((*r[:4], date, False) if mode == "full" and policy == "soft_delete" else r)
        elif [norm(x) for x in s[1:]] != [norm(x) for x in r[1:3]]:
            out += [(*r[:4], date, False), (*s, date, None, True)]
        else:
            out.append(r)
    return out + [(*s, date, None, True) for k, s in new.items() if k not in now]


@pytest.mark.parametrize("seed", range(4))
def test_history_against_plain_python(spark, seed):
    rng = random.Random(seed)
    value = lambda: rng.choice(["a", "b", "A", " a", "", None])
    source = [(str(i), value(), value()) for i in range(30) if rng.random() < 0.7]
    target = [current(str(i), value(), value()) for i in range(30) if rng.random() < 0.7]
    target += [(str(i), "old", None, datetime.date(2025, 1, 1), D0, False) for i in range(0, 30, 4)]
    mode, policy = rng.choice(["full", "incremental"]), rng.choice(["soft_delete", "ignore"])
    s, t = frames(spark, source, target)
    got = history.apply_history(s, t, ["id"], ["city", "tier"], D1, mode, policy)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain(source, target, mode, policy, D1)))
    report = {r.rule: r.status for r in invariants.validate_history(got, ["id"]).collect()}
    assert set(report.values()) == {"pass"}
    again = history.apply_history(s, got, ["id"], ["city", "tier"], datetime.date(2026, 7, 1), mode, policy)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got.collect()))


def test_one_shuffle_a_side(spark):
    source, target = frames(spark, [("1", "a", "b")], [current("1", "a", "b")])
    plan = history.apply_history(source, target, ["id"], ["city", "tier"], D1, check=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_invariants(spark):
    bad = [("1", "a", "b", D1, D0, False), ("2", "a", "b", D0, D1, True), ("3", "a", "b", D0, None, False), ("4", "a", "b", D0, None, True), ("4", "a", "b", D1, None, True), (None, "a", "b", D0, None, True), (" ", "a", "b", D0, None, True), ("5", "a", "b", D0, D1, False), ("5", "a", "b", D1, None, True)]
    df = spark.createDataFrame(bad, TARGET)
    report = {r.rule: (r.status, r.issues) for r in invariants.validate_history(df, ["id"]).collect()}
    assert report == {"schema_completeness": ("pass", 0), "one_current_per_key": ("fail", 1), "no_null_keys": ("fail", 1), "no_blank_keys": ("warn", 1), "no_overlapping_dates": ("fail", 1), "date_consistency": ("fail", 3)}
    relations = {(r.id, r.relation) for r in invariants.interval_relations(df, ["id"]).collect()}
    assert relations == {("4", "open_predecessor"), ("5", "adjacent")}
    assert [r.status for r in invariants.validate_history(df.drop("effective_to"), ["id"]).collect()] == ["fail"]
    with pytest.raises(HistoryError):
        history.append_guard(df)


def test_as_of(spark):
    rows = [("1", "a", None, datetime.date(2026, 1, 1), datetime.date(2026, 2, 1), False), ("1", "b", None, datetime.date(2026, 3, 1), None, True)]
    df = spark.createDataFrame(rows, TARGET)
    assert [r.city for r in history.as_of(df, datetime.date(2026, 1, 31)).collect()] == ["a"]
    assert history.as_of(df, datetime.date(2026, 2, 1)).isEmpty()
    points = spark.createDataFrame([("1", datetime.date(2026, 1, 1)), ("1", datetime.date(2026, 2, 15)), ("1", datetime.date(2027, 1, 1)), ("2", datetime.date(2026, 1, 1)), (None, datetime.date(2026, 1, 1))], "id string, at date")
    got = {(r.id, r.at): r.city for r in history.as_of_join(points, df, ["id"], "at").collect()}
    assert [got[k] for k in sorted(got, key=repr)] == [got[k] for k in sorted(got, key=repr)] and got["1", datetime.date(2026, 1, 1)] == "a" and got["1", datetime.date(2026, 2, 15)] is None and got["1", datetime.date(2027, 1, 1)] == "b" and got["2", datetime.date(2026, 1, 1)] is None


def test_contract(spark):
    df = spark.createDataFrame([("1", "a"), ("2", None)], "id string, city string")
    contract = contracts.derive_contract(df, ["id"], ["city"])
    assert contract.nullable == ("city",)
    assert contracts.outcome(contracts.contract_findings(df, contract)).first().outcome == "compatible"
    assert contracts.outcome(contracts.contract_findings(df.withColumn("more", F.lit(1)), contract)).first().outcome == "compatible_with_warning"
    found = contracts.contract_findings(spark.createDataFrame([("1", "a"), ("1", "b"), (None, "c")], "id string, city string"), contract)
    assert {(r.category, r.n) for r in found.collect()} == {("duplicate_key", 1), ("blank_key", 1)}
    assert contracts.outcome(found).first().outcome == "incompatible"


def test_keys_and_cursors(spark):
    df = spark.createDataFrame([(1, "x", "2026-01-01 00:00:00"), (2, "y", "2026-01-01 00:00:00"), (3, "y", "2026-01-02 00:00:00")], "cust_id int, city string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert keys.detect_keys(df, df)[0] == ["cust_id"]
    cursor = {"ts": "2026-01-01 00:00:00", "cust_id": 1}
    assert [r.cust_id for r in keys.page_after(df, "ts", ["cust_id"], cursor).collect()] == [2, 3]
    assert [r.cust_id for r in keys.page_after(df, "ts", ["cust_id"], {"ts": cursor["ts"]}).collect()] == [3]
    assert [r.cust_id for r in keys.page_after(df, "ts", ["cust_id"], None, 2).collect()] == [1, 2]
    assert keys.cursor_bounds(df, "ts", ["cust_id"]).first().last.cust_id == 3


def test_as_of_of_nested_versions(spark):
    """An older version that outlasts a short one is valid again after it; equal events keep their number."""
    day = lambda k: datetime.date(2026, 1, k)
    h = spark.createDataFrame([("a", 1, day(1), day(20), False), ("a", 2, day(5), day(8), False), ("a", 3, day(20), None, True), ("b", 4, day(1), None, True)], "k string, v int, effective_from date, effective_to date, is_current boolean")
    events = spark.createDataFrame([("a", day(6)), ("a", day(10)), ("a", day(10)), ("a", day(25)), ("b", day(2)), ("c", day(2)), (None, day(2))], "k string, at date")
    got = sorted(((r.k or "", r["at"].day, r.v) for r in history.as_of_join(events, h, ["k"], "at").collect()), key=repr)
    assert got == sorted([("a", 6, 2), ("a", 10, 1), ("a", 10, 1), ("a", 25, 3), ("b", 2, 4), ("c", 2, None), ("", 2, None)], key=repr)


def test_history_by_timestamp(spark):
    at = lambda h: datetime.datetime(2026, 1, 1, h)
    empty = spark.createDataFrame([], "k string, v string, effective_from timestamp, effective_to timestamp, is_current boolean")
    first = history.apply_history(spark.createDataFrame([("a", "x")], "k string, v string"), empty, ["k"], ["v"], at(9))
    second = history.apply_history(spark.createDataFrame([("a", "y")], "k string, v string"), first, ["k"], ["v"], at(10))
    assert sorted((r.v, r.effective_from, r.effective_to) for r in second.collect()) == [("x", at(9), at(10)), ("y", at(10), None)]
    assert invariants.passes(invariants.validate_history(second, ["k"]))  # two changes on one day are no fault


def test_ordinals_previews_and_json(spark, tmp_path):
    spark.range(100).repartition(4).write.parquet(str(tmp_path / "r"))
    rows = keys.with_ordinal(spark.read.parquet(str(tmp_path / "r")))
    assert sorted(r.row_index for r in rows.collect()) == list(range(100))
    assert keys.preview(spark.range(1000), ["id"], 500).count() == keys.MOST_PREVIEWED
    coded = spark.createDataFrame([(1, None)], "b int, a string").select(keys.to_key_json(["b", "a"]).alias("j"))
    assert coded.first().j == '{"a":null,"b":1}'
    assert keys.detect_keys(spark.createDataFrame([("x", "x")], "p string, q string").union(spark.createDataFrame([("x", "x")], "p string, q string")), spark.createDataFrame([], "p string, q string"))[0] == ["p"]


@pytest.fixture
def spread(spark):
    """Small tables stay in several partitions, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_places_of_a_sorted_source(spark, tmp_path, spread):
    """More rows than a sort samples: a second sort has other ranges, places must not depend on that."""
    rows = spark.range(60000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(5000))).alias("ts"), (F.col("id") % 7).alias("user_id"))
    rows.repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    want = [r.event_id for r in sorted(rows.collect(), key=lambda r: (r.ts, r.user_id, r.event_id))]
    found = sorted(entry.queries()["all_rows_in_order"](spark, str(tmp_path)).collect(), key=lambda r: r.place)
    assert [r.place for r in found] == list(range(1, 60001)) and [r.event_id for r in found] == want


def test_places_of_a_sorted_history(spark, tmp_path, spread):
    k = F.col("id")
    orders = spark.range(60000).select(k.alias("o_orderkey"), F.pmod(F.xxhash64("id"), F.lit(3000)).alias("o_custkey"), F.date_add(F.lit(D0), (k % 400).cast("int")).alias("o_orderdate"), F.lit("1").alias("o_orderpriority"))
    orders.repartition(6).write.parquet(str(tmp_path / "orders.parquet"))
    found = sorted(entry.queries()["history_in_order"](spark, str(tmp_path)).collect(), key=lambda r: r.place)
    assert [r.place for r in found] == list(range(1, len(found) + 1))
    assert [(r.custkey, r.effective_from) for r in found] == sorted({(r.o_custkey, r.o_orderdate) for r in orders.collect()})

"""Guardrail thresholds, containment, onboarding rules, drift and functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from dimtrail.functions import text
from dimtrail.operators import containment, drift, fingerprint, guardrail, onboarding, profile

EVIDENCE = {"evaluated": 100, "changed": 0, "ratio": 0.0, "max_relative": 0.0, "max_absolute": 0.0, "deactivations": 0, "changes_per_second": 0.0, "dispersion": 0, "valid": True}


def decided(spark, **values):
    row = EVIDENCE | values
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()])
    r = guardrail.decide(df).first()
    return r.rules, r.severity, r.decision


@pytest.mark.parametrize(("values", "rules", "severity"), [
    ({}, [], "LOW"),
    ({"changed": 25}, [], "LOW"),
    ({"changed": 26}, ["HIGH_CHANGE_VOLUME"], "MEDIUM"),
    ({"ratio": 0.8}, [], "LOW"),
    ({"ratio": 0.81}, ["HIGH_POPULATION_IMPACT"], "MEDIUM"),
    ({"ratio": 0.81, "evaluated": 9}, [], "LOW"),
    ({"max_relative": 3.1, "max_absolute": 49.0}, [], "LOW"),
    ({"max_relative": 3.1, "max_absolute": 50.0}, ["LARGE_QUANTITY_SWING"], "MEDIUM"),
    ({"deactivations": 6}, ["MASS_DEACTIVATION"], "HIGH"),
    ({"changed": 10, "changes_per_second": 50.1}, ["HIGH_CHANGE_VELOCITY"], "MEDIUM"),
    ({"dispersion": 6, "changed": 30}, ["HIGH_CHANGE_VOLUME", "WIDE_GEOGRAPHIC_IMPACT"], "HIGH"),
    ({"valid": False}, ["SCD2_VALIDATION_FAILURE"], "CRITICAL"),
])
def test_rules(spark, values, rules, severity):
    assert decided(spark, **values) == (rules, severity, "SUSPICIOUS" if rules else "NORMAL")


def test_evidence_of_fields(spark):
    diffs = spark.createDataFrame([("b", "qty", "10", "50"), ("b", "qty", "0", "7"), ("b", "qty", "-5", "5"), ("b", "status", "active", "CLOSED"), ("b", "city", "a", "A"), ("b", "city", "a", None), ("b", "x", "nan", "1")], "batch string, `column` string, old_value string, new_value string")
    r = guardrail.field_evidence(diffs, "batch").first()
    assert (r.max_relative, r.max_absolute, r.total_absolute, r.worst_column, r.transitions, r.deactivations) == (7.0, 40, 57, "qty", 2, 1)


def test_holds(spark):
    events = spark.createDataFrame([("h", "HELD", 1), ("h", "RELEASED", 2), ("h", "RELEASED", 3), ("h", "DISCARDED", 4), ("g", "HELD", 1), ("x", "RELEASED", 1)], "hold_id string, status string, at int")
    assert {(r.hold_id, r.status) for r in containment.hold_states(events).collect()} == {("h", "RELEASED"), ("g", "HELD")}
    assert {(r.hold_id, r.status) for r in containment.refused_moves(events).collect()} == {("h", "DISCARDED"), ("x", "RELEASED")}


def test_digests_ignore_order_and_see_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k int, v string")
    digest = lambda df: fingerprint.dataset_digest(df).first().digest
    assert digest(a) == digest(a.orderBy(F.desc("k"))) == digest(a.select("v", "k"))
    assert len({digest(a), digest(a.distinct()), digest(a.union(a)), digest(a.withColumn("v", F.lit("x")))}) == 4


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "c string").select(make("c").alias("r")).first().r


@pytest.mark.parametrize(("value", "make", "want"), [
    ("  x\t", text.norm_text, "x"), (" \n", text.norm_text, None), ("First  Name!", text.slug, "first_name"), ("---", text.slug, "col"), ("Éa b", text.slug, "éa_b"),
    ("YES", text.to_flag, True), ("no", text.to_flag, False), ("", text.to_flag, None),
    ("2026-09-06", text.to_history_date, datetime.date(2026, 9, 6)), ("2026-09-06 23:30:00+05:00", text.to_history_date, datetime.date(2026, 9, 6)), ("2026-09-06T10:00:00.123Z", text.to_history_date, datetime.date(2026, 9, 6)), ("2026-09-06T23:00:00.123456+02:00", text.to_history_date, datetime.date(2026, 9, 6)), ("2026-09", text.to_history_date, None), ("06/09/2026", text.to_history_date, None),
    ("a@b.co", text.is_email, True), ("a@b", text.is_email, False), ("john@x.org", text.mask_email, "j***@x.org"), ("none", text.mask_email, "<MASKED_EMAIL>"), ("+1 555 123 4567", text.mask_phone, "***-4567"), ("j@x.org", text.mask_email, "*@x.org"), ("jo@x@y.org", text.mask_email, "j***@x@y.org"), ("12", text.mask_phone, "***-****"), ("ann lee", text.mask_name, "A*** L***"),
    ("Ab-12", text.shape_token, "Aa-##"), ("a@b.co", text.shape_token, "<EMAIL>"), ("25/01/2020", text.date_pattern, "DD/MM/YYYY"), ("01/25/2020", text.date_pattern, "MM/DD/YYYY"), ("01/02/2020", text.date_pattern, "AMBIGUOUS"), ("05/05/2020", text.date_pattern, "MM/DD/YYYY"), ("2020/1/5", text.date_pattern, "YYYY/MM/DD"), ("2020-01-05 10:00", text.date_pattern, None), ("x", text.date_pattern, None),
    ("12.9", lambda c: text.cast_text(c, "integer"), 12), ("1d", lambda c: text.cast_text(c, "float"), None), ("Y", lambda c: text.cast_text(c, "boolean"), True), ("b", lambda c: text.map_enum(c, {"A": "ACTIVE", "B": "BLOCKED"}), "BLOCKED"), (" q ", lambda c: text.map_enum(c, {"A": "ACTIVE"}), "q"),
    ("06/09/2026", lambda c: text.parse_date(c, "%d/%m/%Y"), datetime.date(2026, 9, 6)), ("2026/9/6", text.parse_date, datetime.date(2026, 9, 6)), ("soon", text.parse_date, None),
])
def test_functions(spark, value, make, want):
    assert one(spark, value, make) == want


def test_similarity_is_the_library_ratio(spark):
    assert abs(one(spark, "cust_id", lambda c: text.token_similarity(c, F.lit("Customer ID"))) - 0.7777777777777778) < 1e-9


def test_exception_moves(spark):
    exceptions = spark.createDataFrame([("a", False), ("b", True), ("c", False)], "exception_id string, protected boolean")
    t = lambda k: datetime.datetime(2026, 1, 1, 0, 0, k)
    events = spark.createDataFrame([("a", "CORRECTED", t(1)), ("a", "RESOLVED", t(2)), ("a", "DISMISSED", t(3)), ("b", "DISMISSED", t(1))], "exception_id string, status string, at timestamp")
    assert {(r.exception_id, r.status, r.refused) for r in onboarding.exception_states(exceptions, events).collect()} == {("a", "RESOLVED", 1), ("b", "OPEN", 1), ("c", "OPEN", 0)}


@pytest.mark.parametrize(("column", "value", "want"), [("phone", "+44 20 7946 0958 ext 3", "***-9583"), ("contact_email", "nobody", "<MASKED_EMAIL>"), ("ssn", "none", "***-**-1234"), ("full_name", "Ann Lee", "A*** L***"), ("full_name", "123", "123"), ("s_name", "Ann", "Ann"), ("note", "x" * 60, "x" * 50 + "..."), ("phone", None, None)])
def test_samples_are_masked_by_column_name(spark, column, value, want):
    assert one(spark, value, lambda c: text.sample_value(c, "masked", column)) == want


def signals(spark, **columns):
    rows = [(name, *({"type": "string", "uniqueness": 0.5, "has_at": False, "has_date": False, "top_values": []} | given).values()) for name, given in columns.items()]
    return spark.createDataFrame(rows, "source_field string, type string, uniqueness double, has_at boolean, has_date boolean, top_values array<string>")


def test_mapping_scores(spark):
    rows = signals(spark, cust_no={"uniqueness": 0.9}, acct_no={"uniqueness": 1.0}, last={}, state={"top_values": ["A", "INACTIVE"]}, email_2={"has_at": True}, opened_date={"type": "date"}, given_no={})
    got = {(r.source_field, r.target): r.score for r in onboarding.mapping_candidates(rows).collect()}
    assert got["cust_no", "customer_id"] == 0.95 and got["acct_no", "customer_id"] == 1.0  # no penalty from 0.8 on
    assert got["last", "last_name"] == 0.95 and ("last", "first_name") not in got
    assert got["state", "status"] == 1.0 and got["opened_date", "created_at"] == 1.0
    assert got["email_2", "email"] == round(0.7 * 2 * 5 / 12 + 0.1 + 0.2, 2)
    assert ("given_no", "last_name") not in got
    best = {r.source_field: r.target for r in onboarding.propose_mapping(rows, onboarding.mapping_candidates(rows)).collect()}
    assert best["last"] == "last_name" and best["state"] == "status"


def test_mapping_impact(spark):
    events = spark.createDataFrame([("s", "dob", "REMOVED", "string", None), ("s", "signup", "TYPE_CHANGED", "string", "date"), ("s", "state", "TYPE_CHANGED", "string", "float"), ("s", "first", "NULLABILITY_CHANGED", "false", "true"), ("s", "nick", "NULLABILITY_CHANGED", "false", "true")], "source string, slug string, event string, old string, new string")
    mapping = spark.createDataFrame([("s", "dob", "date_of_birth", "date", False), ("s", "signup", "created_at", "datetime", True), ("s", "state", "status", "enum", True), ("s", "first", "first_name", "string", True), ("s", "nick", "nickname", "string", False)], "source string, slug string, target string, wanted string, required boolean")
    got = {r.slug: r.impact for r in drift.mapping_impact(events, mapping).collect()}
    assert got == {"dob": "BROKEN", "signup": "REVIEW", "state": "BROKEN", "first": "REVIEW", "nick": "COMPATIBLE"}


@pytest.mark.parametrize(("message", "kind", "task", "code", "want"), [
    ("x", "DuplicateBusinessKeyError", "ingest_csvs", 0, "deterministic_scd2_error"), ("gone", "FileNotFoundError", "ingest_task", 0, "deterministic_input_error"), ("gone", "FileNotFoundError", None, 0, "unexpected_internal_error"),
    ("no such column", "KeyError", "schema_task", 0, "deterministic_schema_error"), ("artifact lost", "OSError", None, 0, "persistence_error"), ("x", "RuntimeError", "explain_task", 403, "permanent_ai_error"), ("Quota exceeded for the day", "RuntimeError", "explain_task", 429, "permanent_ai_error"),
    ("x", "TimeoutError", "explain_task", 0, "transient_ai_error"), ("x", "RuntimeError", "explain_changes", 503, "transient_ai_error"), ("x", "ValueError", "explain_changes", 0, "unexpected_internal_error"), ("duplicate key", "Exception", None, 0, "deterministic_scd2_error"), (None, "Exception", None, 0, "unexpected_internal_error"),
])
def test_failure_categories(spark, message, kind, task, code, want):
    from dimtrail.operators.metrics import failure_category

    df = spark.createDataFrame([(message, kind, task, code)], "m string, k string, t string, c int")
    assert df.select(failure_category(*map(F.col, "mktc")).alias("r")).first().r == want


def test_deleted_rows_are_no_evidence(spark):
    df = spark.createDataFrame([("b", t) for t in ("CHANGED", "NEW", "UNCHANGED", "DELETED")], "batch string, change_type string")
    r = guardrail.batch_counts(df, "batch").first()
    assert (r.evaluated, r.mutated, r.ratio) == (3, 2, 0.6667)


def test_drift_renames(spark):
    events = spark.createDataFrame([("s", "customer_name", "REMOVED", "string", None), ("s", "customer_names", "ADDED", None, "string"), ("s", "zzz", "ADDED", None, "string"), ("s", "dob", "REMOVED", "date", None), ("s", "bday", "ADDED", None, "string"), ("s", "qty", "REMOVED", "integer", None), ("s", "qty2", "ADDED", None, "float")], "source string, slug string, event string, old string, new string")
    assert {(r.removed, r.added, r.score) for r in drift.possible_renames(events).collect()} == {("customer_name", "customer_names", 0.963), ("dob", "bday", 0.88), ("qty", "qty2", 0.6071)}


def test_profile(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, "bb")], "id int, v string")
    got = {r.column: r for r in profile.profile_columns(df).collect()}
    assert got["id"].is_unique and (got["v"].nulls, got["v"].distinct, got["v"].max_length) == (1, 2, 2)
    assert [(r.value, r.n) for r in profile.top_values(df, ["v"]).orderBy("rank").collect()] == [("a", 2), (None, 1), ("bb", 1)]
    assert profile.without_secrets(df.withColumn("api_token", F.lit(1))).columns == ["id", "v"]


def test_actions_on_holds(spark):
    day = lambda k: datetime.date(2026, 1, k)
    history = spark.createDataFrame([("a", "x", day(1), None, True), ("b", "x", day(9), None, True)], "k string, v string, effective_from date, effective_to date, is_current boolean")
    frozen = spark.createDataFrame([("a", "y", day(5)), ("b", "y", day(5)), ("c", "y", day(5))], "k string, v string, at date")
    events = spark.createDataFrame([("h", "HELD", 1), ("g", "HELD", 1), ("g", "RELEASED", 2)], "hold_id string, status string, at int")
    args = (frozen, history, ["k"], ["v"], "at", day(10))
    done = containment.release(events, "h", *args)
    assert done.status == "RELEASED" and done.advances and [r.k for r in done.late.collect()] == ["b"]
    assert {(r.k, r.v, r.is_current) for r in done.history.collect()} == {("a", "x", False), ("a", "y", True), ("b", "x", True), ("c", "y", True)}
    for hold in ("g", "unknown"):
        with pytest.raises(containment.HoldError):
            containment.release(events, hold, *args)
        with pytest.raises(containment.HoldError):
            containment.discard(events, hold)
    strict = guardrail.Thresholds(changed=0)
    assert containment.reprocess(events, "h", *args, thresholds=strict).status == "HELD"
    assert containment.reprocess(events, "h", *args, thresholds=strict, force=True).status == "REPROCESSED"
    assert containment.discard(events, "h").history is None and containment.discard(events, "h", advance=True).advances


def test_drift_gate_of_canonical_batches(spark):
    from dimtrail.plans.pipeline import integrate_canonical

    broken = spark.createDataFrame([("crm", "BROKEN")], "source string, overall string")
    records = spark.createDataFrame([("1", "a", "b", "c@d.e", None, "active", datetime.datetime(2026, 1, 1))], "customer_id string, first_name string, last_name string, email string, date_of_birth date, status string, created_at timestamp")
    history = spark.createDataFrame([], "customer_id string, first_name string, last_name string, email string, date_of_birth date, status string, effective_from date, effective_to date, is_current boolean")
    with pytest.raises(ValueError):
        integrate_canonical(records, history, datetime.date(2026, 1, 2), broken)
    _, staged, judged = integrate_canonical(records, history, datetime.date(2026, 1, 2), thresholds=guardrail.Thresholds(dispersion=5))
    assert [(r.customer_id, r.status, r.is_current) for r in staged.collect()] == [("1", "ACTIVE", True)] and judged.first().decision == "NORMAL"


def test_corrected_exceptions(spark):
    exceptions = spark.createDataFrame([("a", 1, False), ("b", 2, False), ("c", 3, False)], "exception_id string, row_index int, protected boolean")
    at = datetime.datetime(2026, 1, 1)
    events = spark.createDataFrame([("a", "CORRECTED", at), ("b", "CORRECTED", at)], "exception_id string, status string, at timestamp")
    validated = spark.createDataFrame([(1, []), (2, [("R", "f", "m")]), (3, [])], "row_index int, errors array<struct<rule_id:string,field:string,message:string>>")
    assert {(r.exception_id, r.status) for r in onboarding.reprocess_exceptions(exceptions, events, validated).collect()} == {("a", "RESOLVED"), ("b", "REPROCESSED")}


def test_percentiles_in_slices(spark):
    """Exact at any number of distinct values, with ties, a null group and null values, for whole numbers, fractions and decimals."""
    import random

    rng = random.Random(4)
    rows = [(g, rng.choice([rng.random() * 1000, float(rng.randint(0, 5)), 7.25])) for g, n in (("a", 3000), ("b", 1), (None, 40), ("c", 2)) for _ in range(n)] + [("d", None), ("a", None)]
    for kind in ("double", "bigint", "decimal(12,2)"):
        df = spark.createDataFrame(rows, "g string, v double").selectExpr("g", f"cast(v AS {kind}) AS v")
        want = {}
        for r in df.collect():
            if r.v is not None:
                want.setdefault(r.g, []).append(r.v)
        got = {r.g: r for r in guardrail.latency_percentiles(df, ["g"], "v").collect()}
        assert set(got) == set(want)
        for g, values in want.items():
            values.sort()
            r = got[g]
            assert (r.n, r.min, r.p50, r.p95, r.p99, r.max) == (len(values), values[0], *[values[int(len(values) * q)] for q in (0.5, 0.95, 0.99)], values[-1])
        assert guardrail.latency_percentiles(df.limit(0), ["g"], "v").collect() == []

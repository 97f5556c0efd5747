"""Explanations, what contradicts them, and stored drift reports, on small inputs."""

import pytest
from pyspark.sql import functions as F

from dimtrail.operators import drift, guardrail, narrative
from dimtrail.plans.drift_reports import DriftReports
from dimtrail.queries.explained import RULE_NAMES

EVIDENCE = "batch string, evaluated long, changed long, new long, ratio double, dispersion long, deactivations long, max_absolute double, max_relative double, window_seconds double, valid boolean, rules array<string>, severity string, decision string, failures array<string>"
QUIET = ("b0", 3, 0, 1, 0.3333, 1, 0, 0.0, 0.0, 0.0, True, [], "LOW", "NORMAL", None)
HELD = ("b1", 40, 30, 2, 0.8, 9, 6, 70.0, 4.5, 61.9, False, ["HIGH_CHANGE_VOLUME", "SCD2_VALIDATION_FAILURE"], "CRITICAL", "SUSPICIOUS", ["two current rows", "a null key"])


@pytest.fixture(scope="module")
def decided(spark):
    return spark.createDataFrame([QUIET, HELD], EVIDENCE)


@pytest.fixture(scope="module")
def told(spark, decided):
    per_column = spark.createDataFrame([("b1", "v", 30), ("b1", "a", 2)], "batch string, column string, n long")
    return narrative.batch_explanations(decided, "batch", "crm", per_column)


def test_parts_of_an_explanation(told):
    quiet, held = [r.asDict() for r in told.orderBy("batch").collect()]
    assert quiet["points"] == ["evaluated: 3", "share moved: 33.3%"]
    assert quiet["summary"] == "Batch b0 of crm is committed." and quiet["validation"] == "All invariants of the history hold."
    assert quiet["what_changed"] == "3 rows: 0 changed, 1 new, 2 as before; 33.3% moved, over 1 keys."
    assert held["points"] == ["evaluated: 40", "share moved: 80.0%", "deactivations: 6", "largest relative change: 450.0%", "by column: a: 2, v: 30", "window: 61 s"]
    assert held["summary"] == "Batch b1 of crm is held at severity CRITICAL because of HIGH_CHANGE_VOLUME, SCD2_VALIDATION_FAILURE."
    assert held["validation"] == "Invariants of the history are broken: two current rows; a null key"


def test_no_batches(decided, told):
    assert narrative.batch_explanations(decided.limit(0), "batch", "crm").collect() == []
    assert narrative.grounding_violations(told.limit(0), decided, "batch", RULE_NAMES).collect() == []


def test_own_explanations_are_sound(decided, told):
    assert narrative.grounding_violations(told, decided, "batch", RULE_NAMES).collect() == []


@pytest.mark.parametrize(
    ("batch", "part", "text", "found"),
    [
        ("b0", "decision", "suspicious", [("DECISION_IMMUTABILITY", "suspicious", "NORMAL")]),
        ("b0", "decision", "normal", []),
        ("b0", "decision", None, [("DECISION_IMMUTABILITY", None, "NORMAL")]),
        ("b1", "severity", "LOW", [("SEVERITY_IMMUTABILITY", "LOW", "CRITICAL")]),
        ("b0", "summary", "It was held due to mass_deactivation.", [("UNTRIGGERED_RULE_CLAIMED", "MASS_DEACTIVATION", "")]),
        ("b1", "why_flagged", "MASS_DEACTIVATION was not looked at.", []),
        ("b1", "why_flagged", "LARGE_QUANTITY_SWING: its limit was breached", [("UNTRIGGERED_RULE_CLAIMED", "LARGE_QUANTITY_SWING", "HIGH_CHANGE_VOLUME,SCD2_VALIDATION_FAILURE")]),
        ("b1", "why_flagged", "HIGH_CHANGE_VOLUME exceeded", []),
        ("b1", "validation", "Validation passed.", [("CONTRADICTED_VALIDATION_STATUS", "passed", "failed")]),
        ("b0", "validation", "Validation passed.", []),
        ("b0", "summary", "The invariants were violated.", [("CONTRADICTED_VALIDATION_STATUS", "failed", "passed")]),
        ("b1", "containment", "Rows were committed to history.", [("CONTRADICTED_CONTAINMENT_STATUS", "committed", "held")]),
        ("b0", "containment", "Rows were committed to history.", []),
        ("b1", "containment", None, []),
    ],
)
def test_contradictions(decided, told, batch, part, text, found):
    other = told.withColumn(part, F.when(F.col("batch") == batch, F.lit(text)).otherwise(F.col(part)))
    assert [tuple(r)[1:] for r in narrative.grounding_violations(other, decided, "batch", RULE_NAMES).collect()] == found


def test_transitions_of_columns(spark):
    rows = [("b", "status", "A", "b"), ("b", "status", "a", "A"), ("b", "status", None, "x"), ("b", "n", "1", "2"), ("b", "n", "1", "two"), ("c", "k", "x", "y")]
    diffs = spark.createDataFrame(rows, "batch string, column string, old_value string, new_value string")
    assert sorted(map(tuple, guardrail.column_transitions(diffs, "batch").collect())) == [("b", "n", 1), ("b", "status", 1), ("c", "k", 1)]


def _registry(spark, version, columns):
    return drift.registry(spark.createDataFrame([("crm", version, n, t, False, i) for i, (n, t) in enumerate(columns)], drift.REGISTRY))


def test_stored_reports(spark, tmp_path):
    store = DriftReports(spark, str(tmp_path))
    assert store.page(5).collect() == [] and store.require_unbroken("crm", "m") is None
    v1 = _registry(spark, 1, [("mail", "string"), ("age", "string")])
    v2 = _registry(spark, 2, [("e_mail", "string"), ("age", "string")])
    v3 = _registry(spark, 3, [("e_mail", "string"), ("age", "int")])
    mapping = spark.createDataFrame([("crm", "mail", "email", "string", True), ("crm", "age", "age", "integer", False)], "source string, slug string, target string, wanted string, required boolean")
    one = store.add(v1, v2, mapping, "m")
    assert store.add(v1, v2, mapping, "m") == one and store.reports().count() == 1
    assert {(r.slug, r.impact, r.replacement) for r in store.impact(one).collect()} == {("mail", "BROKEN", "e_mail"), ("age", "COMPATIBLE", None)}
    assert {(r.slug, r.event) for r in store.events(one).collect()} == {("mail", "REMOVED"), ("e_mail", "ADDED")}
    with pytest.raises(ValueError, match="crm"):
        store.require_unbroken("crm", "m")
    store.require_unbroken("crm", "another")
    store.add(v2, v3, mapping.where("slug = 'age'"), "m")
    store.require_unbroken("crm", "m")
    assert [(r.overall, r.total) for r in store.page(1).collect()] == [("REVIEW", 2)]
    assert [(r.overall, r.total) for r in store.page(5, overall="BROKEN").collect()] == [("BROKEN", 1)]
    with pytest.raises(ValueError, match="two versions"):
        store.add(v1.limit(0), v2, mapping, "m")

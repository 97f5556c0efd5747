"""Run lifecycles, corrections as data and key detection."""

import datetime

import pytest
from pyspark.sql import functions as F

from dimtrail.operators import corrections, keys
from dimtrail.plans.run_log import RUN_MOVES, MoveError, RunLog, run_states


def test_moves_of_runs(spark):
    """Every pair of states against the table of moves, by folding one event after the path to the first."""
    paths = {"CREATED": []}
    while len(paths) < len(RUN_MOVES):
        for a, then in RUN_MOVES.items():
            for b in then:
                if a in paths and b not in paths:
                    paths[b] = [*paths[a], b]
    rows = [(f"{a}>{b}", s, k) for a in RUN_MOVES for b in RUN_MOVES for k, s in enumerate([*paths[a], b])]
    got = {r.run_id: r for r in run_states(spark.createDataFrame(rows, "run_id string, status string, at int")).collect()}
    for a, then in RUN_MOVES.items():
        for b in RUN_MOVES:
            r = got[f"{a}>{b}"]
            assert (r.status, r.refused) == ((b, 0) if b in then else (a, 1))
    odd = spark.createDataFrame([("x", "NONSENSE", 1), ("x", "PROFILING", 2), (None, "PROFILING", 1), ("x", None, 3)], "run_id string, status string, at int")
    assert [tuple(r) for r in run_states(odd).collect()] == [("x", "PROFILING", 1, 1, 0)]
    assert run_states(odd.limit(0)).collect() == []


def test_stored_runs(spark, tmp_path):
    log = RunLog(spark, str(tmp_path))
    assert log.status("a") is None and log.create("a", "k1", "f1") == "a" and log.status("a") == "CREATED"
    assert log.create("other", "k1", "f1") == "a"  # the same request again
    with pytest.raises(MoveError):
        log.create("other", "k1", "f2")
    with pytest.raises(MoveError):
        log.move("a", "COMPLETED")
    with pytest.raises(MoveError):
        log.move("b", "PROFILING")
    for status in ("FAILED", "CREATED", "PROFILING"):
        log.move("a", status, by="someone")
    assert [tuple(r) for r in log.states().collect()] == [("a", "PROFILING", 0, 3, 1)]
    assert log.events().count() == 4


def test_chains(spark):
    feed = spark.createDataFrame([(1, " Ann ", "x", "12.0"), (2, None, "yes", "abc"), (3, "C", "", None)], "n int, name string, flag string, amount string")
    step = corrections.step
    chains = [
        (1, "name", 2, F.array(step("UPPERCASE"))), (1, "name", 1, F.array(step("TRIM"))),
        (1, "amount", 1, F.array(step("CAST", "integer"))),
        (2, "amount", 1, F.array(step("CAST", "float"), step("SET", "7"), step("CAST", "integer"))),
        (2, "flag", 1, F.array(step("CAST", "boolean"))),
        (2, "name", 1, F.array(step("CONCAT", "/", fields=("flag", "amount", "none")))),
        (3, "name", 1, F.array(step("MAP_ENUM", mapping=F.create_map(F.lit("c"), F.lit("see"))), step("LOWERCASE"))),
        (3, "flag", 1, F.array(step("EVAL"), step("CAST", "colour"))),
        (3, "nothing", 1, F.array(step("SET", "1"))),
    ]
    rows = None
    for row, field, at, steps in chains:
        one = spark.range(1).select(F.lit(row).alias("row_index"), F.lit(field).alias("field"), F.lit(at).alias("at"), steps.alias("steps"))
        rows = one if rows is None else rows.unionByName(one)
    got = {r.n: r for r in corrections.corrected(feed, "n", rows).collect()}
    assert tuple(got[1])[:4] == (1, "ANN", "x", "12") and got[1].errors == []
    assert tuple(got[2])[:4] == (2, "yes/abc", "true", "7") and [e.rule_id for e in got[2].errors] == ["AMOUNT_CAST_ERROR"]
    assert tuple(got[3])[:4] == (3, "see", "", None) and [e.rule_id for e in got[3].errors] == ["UNSUPPORTED_TRANSFORMATION_OPERATION"] * 2
    assert corrections.corrected(feed, "n", rows.limit(0)).collect() == []
    dated = spark.range(1).select(F.lit(1).alias("row_index"), F.lit("name").alias("field"), F.lit(1).alias("at"), F.array(step("SET", "March 5, 2024T"), step("PARSE_DATE", "%B %d, %YT")).alias("steps"))
    assert corrections.corrected(feed, "n", dated).first().name == str(datetime.date(2024, 3, 5))


def test_detected_keys(spark):
    """Ends of names, whole names, uniqueness with a null as a value, and no name that scores."""

    def found(columns, *rows):
        df = spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in columns))
        return keys.detect_keys(df, df)

    assert found(["zip", "account_code", "a"], ("1", "1", "x"), ("2", "2", "x")) == (["account_code"], ["a", "zip"])
    assert found(["zeta", "alpha"], ("1", "1"), ("1", "1")) == (["alpha"], ["zeta"])
    assert found(["id", "user_id"], ("1", "1"), ("2", "2")) == (["id"], ["user_id"])
    assert found(["a", "b"], (None, "1"), ("x", "1")) == (["a"], ["b"])
    assert found(["part_no", "row_num", "x"], ("1", "2", "1"), ("1", "1", "1")) == (["row_num"], ["part_no", "x"])
    history = spark.createDataFrame([("1", "x", True)], "k_id string, v string, is_current boolean")
    assert keys.detect_keys(history, history) == (["k_id"], ["v"])
    assert found(["code", "a_key"], *[]) == (["a_key", "code"], [])
    with pytest.raises(ValueError):
        keys.detect_keys(history.select("v"), history.select("k_id"))

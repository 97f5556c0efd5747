"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from dimtrail.queries import SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FEW = ["change_classify", "history_full_soft", "point_in_time_join", "validation_report", "contract_findings", "guardrail_decisions", "valid_records", "schema_diff", "top_values", "latency_percentiles", "json_envelope", "paged_feed"]


@pytest.fixture(scope="module")
def tables(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", FEW)
def test_query_against_sql(spark, tiny, tables, name):
    df = entry.queries()[name](spark, tiny)
    found = tables.execute(SQL[name])
    names = sorted(df.columns)
    assert sorted(c[0] for c in found.description) == names
    at = [[c[0] for c in found.description].index(n) for n in names]
    want = sorted(repr(tuple(row[i] for i in at)) for row in found.fetchall())
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

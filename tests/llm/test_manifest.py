"""The Merkle manifest against a plain tree, and its block layout."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from dimtrail.llm import manifest, queries

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def leaf_of(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """Levels of a plain tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        lo = i // 8 * 8
        yield level[lo:i], level[i + 1 : lo + 8]
        i //= 8


def plain(rows):
    """Sorted result rows of a table, without Spark or blocks."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    key = lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))
    groups = {g: sorted((r for r in rows if r[2] == g), key=key) for g in langs}
    trees = {g: tree([leaf_of(r) for r in groups[g]]) for g in langs}
    top = tree([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            path = [*siblings(trees[g], i), *siblings(top, k)]
            lower = r[4] if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            x = leaf_of((*r[:4], lower if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[4]))
            for before, after in path:
                x = H(*before, x, *after)
            out.append((r[0], leaf_of(r), trees[g][-1][0], top[-1][0], H(*[s for b, a in path for s in (*b, *a)]), x, x == top[-1][0]))
    return sorted(out, key=repr)


def made(spark, rows, tmp_path, schema=SCHEMA, name="documents"):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return sorted((tuple(r) for r in queries.op12_manifest(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_layout(levels):
    seen = sorted(manifest.address(levels, d, i) for d in range(levels) for i in range(8**d))
    assert seen == list(range(manifest.size(levels)))
    for n in {1, 7, 8, 9, 8 ** (levels - 1) - 1, 8 ** (levels - 1)}:
        if 0 < n <= 8 ** (levels - 1):
            leaves = [hashlib.sha256(str(k).encode()).digest() for k in range(n)]
            nodes = manifest.lay_out(leaves, levels)
            level = [x.hex() for x in leaves]
            for depth in range(levels - 1, -1, -1):
                at = [manifest.address(levels, depth, k) * 32 for k in range(len(level))]
                assert [nodes[a : a + 32].hex() for a in at] == level
                level = [H(*level[k : k + 8]) for k in range(0, len(level), 8)]


def test_groups_of_all_sizes(spark, tmp_path):
    sizes = {None: 9, "": 1, "a": 8, "ä": 64, "b": 65, "c": 511, "d": 512, "e": 513, "f": 4100, "Z": 2}
    rows = [(1000 * k + i, "s", g, i, f"Text {i} Of {g}") for k, (g, n) in enumerate(sizes.items()) for i in range(n)]
    assert made(spark, rows, tmp_path) == plain(rows)


def test_edge_rows(spark, tmp_path):
    rows = [(5, "s", "en", 3, "ABC"), (5, "s", "en", 3, "ABC"), (5, "t", "en", 3, "ABC"), (None, None, None, None, None), (None, "s", "en", 1, "X"), (7, "", "", 0, ""), (8, "é", "fr", -1, "Ünï 🙂" * 50000), *[(12, "s", "en", 4, "Hot!")] * 700]
    assert made(spark, rows, tmp_path) == plain(rows)


def test_one_group_and_one_row(spark, tmp_path):
    rows = [(i, "s", "en", i, "X") for i in range(20)]
    assert made(spark, rows, tmp_path / "a") == plain(rows)
    assert made(spark, rows[:1], tmp_path / "b") == plain(rows[:1])


def test_empty_table_and_clashing_columns(spark, tmp_path):
    assert made(spark, [], tmp_path / "a") == []
    rows = [(i, "s", "en", i, "X") for i in range(20)]
    clash = spark.createDataFrame([(*r, *"abcdefg") for r in rows], SCHEMA + ", i string, n string, node string, leaf string, block string, path string, altered string")
    clash = clash.withColumn("group", F.lit("g")).withColumn("key", F.lit("k"))
    clash.write.parquet(f"{tmp_path}/b/documents.parquet")
    got = sorted((tuple(r) for r in queries.op12_manifest(spark, f"{tmp_path}/b").collect()), key=repr)
    assert got == plain(rows)


def test_against_sql(spark, tiny):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tiny}/documents.parquet'")
    want = sorted(db.sql(queries.ORACLES["op12_manifest"]).fetchall())
    assert sorted(tuple(r) for r in queries.op12_manifest(spark, tiny).collect()) == want

"""Merkle manifest of a table: a tree of digests for each group, one tree over the groups, stored as van Emde Boas blocks.

A block is an aligned subtree of up to ARITY ** HEIGHT leaves. Its nodes lie in one binary value: the upper half of its
levels first, then the lower subtrees one after another, each laid out the same way. `address` finds a node by arithmetic
alone, for building as for looking up siblings. The roots of a group's blocks are the leaves of its next level of blocks, until
one is left; the groups' roots are the leaves of a last tree of the same kind. Leaves are numbered without a task for a
whole group: by sorted ranges, whose counts give every range its first number."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dimtrail.llm.common import checkpointed

ARITY, HEIGHT, DIGEST = 8, 3, 32
BLOCK = ARITY**HEIGHT
#: Rows (ranges of leaves and groups in them) up to which first numbers are broadcast; beyond, they are joined by shuffle.
MOST_SENT = 200_000

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).digest()


def size(levels: int) -> int:
    """Nodes of a full tree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: int) -> int:
    """Place of a depth's index-th node (the root has depth 0) in a full tree of so many levels."""
    if levels <= 1:
        return 0
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    width = ARITY ** (depth - top)
    return size(top) + index // width * size(levels - top) + address(levels - top, depth - top, index % width)


def levels_of(n: int) -> int:
    """Levels of the tree over n leaves, at most a block's."""
    levels = 1
    while ARITY ** (levels - 1) < n:
        levels += 1
    return levels


def lay_out(leaves: Sequence[bytes], levels: int) -> bytes:
    """Nodes of the tree over the leaves: lower subtrees first, then the upper one over the digests of their roots. Subtrees without leaves are left out at the end."""
    if levels == 1:
        return leaves[0]
    top = levels // 2
    below = levels - top
    width = ARITY ** (below - 1)
    parts = [lay_out(leaves[k : k + width], below) for k in range(0, len(leaves), width)]
    roots = [p[:DIGEST].hex().encode() for p in parts]
    upper = lay_out([digest(*roots[k : k + ARITY]) for k in range(0, len(roots), ARITY)], top)
    return upper.ljust(size(top) * DIGEST, b"\0") + b"".join(p.ljust(size(below) * DIGEST, b"\0") for p in parts)


def level_texts(nodes: bytes, n: int, levels: int) -> list[bytes]:
    """Hex digests of each depth from the leaves up to the root's children, read from a block by address."""
    out = []
    for depth in range(levels - 1, 0, -1):
        width = ARITY ** (levels - 1 - depth)
        at = [address(levels, depth, k) * DIGEST for k in range(-(-n // width))]
        out.append(b"".join(nodes[a : a + DIGEST] for a in at).hex().encode())
    return out


def path_of(texts: Sequence[bytes], pos: int) -> list[tuple[bytes, bytes]]:
    """What stands before and after a leaf's ancestor in its run, for each depth of a block."""
    out, hexes = [], 2 * DIGEST
    for text in texts:
        start = pos // ARITY * ARITY
        out.append((text[start * hexes : pos * hexes], text[(pos + 1) * hexes : (start + ARITY) * hexes]))
        pos //= ARITY
    return out


def fold(leaf: bytes, path: Sequence[tuple[bytes, bytes]]) -> bytes:
    """Root above a leaf digest, in hex, from its siblings."""
    for before, after in path:
        leaf = hashlib.sha256(before + leaf + after).hexdigest().encode()
    return leaf


def encoded(column: Column) -> Column:
    """A value with its length in bytes; null is a dash."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[encoded(v) for v in values]), 256))


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Adds i, the row's place in its group from 0, and n, the group's rows. Nulls come first; equal rows in any order.

    Rows are sorted in ranges of the group and the order, with a tie-breaker that also splits rows repeated very often."""
    keys = [group, *order, "__dt_tie"]
    ranges = checkpointed(rows.withColumn("__dt_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__dt_tie"))
    ranges = ranges.withColumn("__dt_p", F.spark_partition_id()).withColumn("__dt_k", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    counts = ranges.groupBy("__dt_p", F.col(group).alias("__dt_g")).agg(F.count("*").alias("c"), F.min("__dt_k").alias("k"))
    earlier = F.coalesce(F.expr("sum(c) OVER (PARTITION BY __dt_g ORDER BY __dt_p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0))
    starts = checkpointed(counts.select(F.col("__dt_p").alias("__dt_q"), "__dt_g", (earlier - F.col("k")).alias("__dt_shift"), F.expr("sum(c) OVER (PARTITION BY __dt_g)").alias("n")))
    if starts.count() <= MOST_SENT:
        starts = F.broadcast(starts)
    found = ranges.join(starts, (F.col("__dt_p") == F.col("__dt_q")) & F.col(group).eqNullSafe(F.col("__dt_g")))
    return found.select(*rows.columns, (F.col("__dt_k") + F.col("__dt_shift")).alias("i"), "n")


def _map_rows(df: DataFrame, schema: str, each: Callable[[dict], Iterator[tuple]], batch: int = 4096) -> DataFrame:
    """Rows made from each row, written in batches."""
    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for got in batches:
            for k in range(got.num_rows):
                for row in each(got.slice(k, 1).to_pylist()[0]):
                    held.append(row)
                    if len(held) >= batch:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, kind)


def blocks_of(nodes: DataFrame, group_type: str, payload: Sequence[str] = ()) -> DataFrame:
    """Blocks of a level: group, block, n (the group's nodes on this level), nodes (van Emde Boas), and the payload columns as lists in leaf order.

    nodes: group, i, n, node and the payload. A block never has more than BLOCK leaves, whatever the group's size."""
    entry = F.struct((F.col("i") % BLOCK).alias("pos"), "node", *payload)
    lists = nodes.groupBy("group", F.expr(f"i div {BLOCK}").alias("block"), "n").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}

    def each(row):
        entries = row["entries"]
        leaves = [e["node"] for e in entries]
        levels = levels_of(len(leaves) if row["n"] <= BLOCK else BLOCK)
        yield (row["group"], row["block"], row["n"], len(leaves), lay_out(leaves, levels), *[[e[c] for e in entries] for c in payload])

    lists_of = "".join(f", {c} array<{kinds[c]}>" for c in payload)
    return checkpointed(_map_rows(lists, f"group {group_type}, block bigint, n bigint, size int, nodes binary{lists_of}", each, 64))


@dataclass
class Forest:
    """Stored trees of groups: blocks by level, and group, node (the root) of every group."""

    levels: list[DataFrame]
    roots: DataFrame
    group_type: str


def plant(nodes: DataFrame, payload: Sequence[str] = ()) -> Forest:
    """Builds the blocks of all groups, level by level; nodes: group, i, n, node and the payload. The number of levels follows the largest group."""
    kind = nodes.schema["group"].dataType.simpleString()
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, ended = [blocks_of(nodes, kind, payload)], []
    while True:
        roots = levels[-1].select("group", F.col("block").alias("i"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.substring("nodes", 1, DIGEST).alias("node"))
        ended.append(roots.where("n = 1").select("group", "node"))
        most = -(-most // BLOCK)
        if most <= 1:
            break
        levels.append(blocks_of(roots.where("n > 1"), kind))
    out = ended[0]
    for other in ended[1:]:
        out = out.unionByName(other)
    return Forest(levels, out, kind)


PATH = "array<struct<before:binary,after:binary>>"


def paths_to_blocks(forest: Forest, above: DataFrame) -> DataFrame:
    """For every block of the lowest level: group, block, path (siblings from the block's root up to the last root) and what `above` carries.

    above: group, path and carried columns of each group's root. Every level passes its blocks' paths to the blocks under them."""
    carried = [c for c in above.columns if c not in ("group", "path")]
    kinds = {f.name: f.dataType.simpleString() for f in above.schema.fields}
    schema = f"group {forest.group_type}, block bigint, path {PATH}" + "".join(f", {c} {kinds[c]}" for c in carried)
    made = None
    for blocks in reversed(forest.levels):
        heads = blocks.where(f"n <= {BLOCK}").select("group").join(above.withColumnRenamed("group", "__dt_g"), F.col("group").eqNullSafe(F.col("__dt_g"))).select("group", F.lit(0).cast("long").alias("block"), "path", *carried)
        paths = heads if made is None else heads.unionByName(made)
        if blocks is forest.levels[0]:
            return paths

        def each(row):
            texts = level_texts(row["nodes"], row["size"], levels_of(row["size"] if row["n"] <= BLOCK else BLOCK))
            up = [(p["before"], p["after"]) for p in row["path"]]
            for k in range(row["size"]):
                yield (row["group"], row["block"] * BLOCK + k, [{"before": b, "after": a} for b, a in path_of(texts, k) + up], *[row[c] for c in carried])

        made = _map_rows(with_paths(blocks, paths), schema, each, 512)
    return paths


def with_paths(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    right = paths.withColumnRenamed("group", "__dt_g").withColumnRenamed("block", "__dt_b")
    return blocks.join(right, F.col("group").eqNullSafe(F.col("__dt_g")) & (F.col("block") == F.col("__dt_b"))).drop("__dt_g", "__dt_b")


@dataclass
class Manifest:
    """Stored trees of a table: `groups` with the leaf blocks (leaves' ids and altered digests as payload), `top` over the groups' roots."""

    groups: Forest
    top: Forest


def build_manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, group: str = "lang", key: str = "doc_id", altered: dict[str, Column] | None = None) -> Manifest:
    """Merkle manifest of a table; altered: other values of some columns, whose digest is stored beside the leaf (null where they change nothing).

    Every row is a leaf, repeated rows too; rows of one key come by digest. Null groups and keys are values like others and come first. Texts stay
    where they are read; digests of DIGEST bytes alone move. An empty table gives a manifest without blocks."""
    leaf = leaf_digest([F.col(c) for c in columns])
    other = F.lit(None).cast("binary")
    if altered:
        other = leaf_digest([altered.get(c, F.col(c)) for c in columns])
    rows = docs.select(F.col(group).alias("group"), F.col(key).alias("key"), leaf.alias("node"), other.alias("altered"))
    rows = rows.withColumn("altered", F.when(F.col("altered") != F.col("node"), F.col("altered")))
    groups = plant(numbered(rows, "group", ["key", "node"]), ["key", "altered"])
    roots = numbered(groups.roots.select(F.lit(0).alias("all"), "group", "node"), "all", ["group"])
    return Manifest(groups, plant(roots.select(F.col("all").alias("group"), F.col("group").alias("key"), "i", "n", "node"), ["key"]))


def inclusion_proofs(manifest: Manifest) -> DataFrame:
    """For every leaf: its group and key, leaf, subroot, root, proof_sha256 (of the siblings, level by level), folded_root (from the altered digest
    where there is one) and verified (folded_root is the root). All digests in hex."""
    top = manifest.top
    at = paths_to_blocks(top, top.roots.select("group", F.array().cast(PATH).alias("path"), F.lower(F.hex("node")).alias("root")))
    kind = manifest.groups.group_type

    def of_groups(row):
        texts = level_texts(row["nodes"], row["size"], levels_of(row["size"] if row["n"] <= BLOCK else BLOCK))
        levels = len(texts) + 1
        up = [(p["before"], p["after"]) for p in row["path"]]
        for k in range(row["size"]):
            at = address(levels, levels - 1, k) * DIGEST
            yield row["key"][k], [{"before": b, "after": a} for b, a in path_of(texts, k) + up], row["nodes"][at : at + DIGEST].hex(), row["root"]

    above = checkpointed(_map_rows(with_paths(top.levels[0], at), f"group {kind}, path {PATH}, subroot string, root string", of_groups, 512))
    key = manifest.groups.levels[0].schema["key"].dataType.elementType.simpleString()

    def of_leaves(row):
        texts = level_texts(row["nodes"], row["size"], levels_of(row["size"] if row["n"] <= BLOCK else BLOCK))
        levels = len(texts) + 1
        up = [(p["before"], p["after"]) for p in row["path"]]
        seen = b"".join(b + a for b, a in up)
        for k in range(row["size"]):
            at = address(levels, levels - 1, k) * DIGEST
            leaf, altered, path = row["nodes"][at : at + DIGEST].hex(), row["altered"][k], path_of(texts, k)
            root = fold((altered.hex() if altered else leaf).encode(), path + up).decode()
            proof = hashlib.sha256(b"".join(b + a for b, a in path) + seen).hexdigest()
            yield row["group"], row["key"][k], leaf, row["subroot"], row["root"], proof, root, root == row["root"]

    schema = f"group {kind}, key {key}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _map_rows(with_paths(manifest.groups.levels[0], paths_to_blocks(manifest.groups, above)), schema, of_leaves)

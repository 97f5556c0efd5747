"""SimHash near-duplicates by a generalised pigeonhole search.

Fingerprints within `distance` bits are linked, and documents get the smallest doc_id that links reach. Correlated bits
are put together into partitions; a dynamic programme gives the partitions unequal thresholds whose sum is
distance - partitions + 1, so that two linked fingerprints agree within the threshold in at least one partition. Each
fingerprint is indexed by its value in a partition and probes the values within the threshold; hits are verified.
The number of partitions is the one with the least estimated work for as many fingerprints as there are.

Equal fingerprints are one node, so exact copies cost nothing. Before the search, members of a bucket that are close
enough to the bucket's lowest and highest fingerprint are linked to those; the search then gives only links between the
components of that, which keeps large groups of near copies from showing all their pairs."""

from __future__ import annotations

from itertools import combinations
from math import comb, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimtrail.llm.common import checkpointed
from dimtrail.llm.components import connected_components
from dimtrail.llm.fingerprints import with_fingerprint

DISTANCE = 4
BITS = 64
#: Work of one probe row, in compared pairs.
PROBE_COST = 8.0
#: Members of one label in a bucket above which they aren't compared with each other.
HEAVY = 1000
#: Tasks over which a component's fingerprints are dealt.
SALTS = 16


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set (64 x 64); partial matrices are summed on Spark."""

    def partial(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for lo in range(0, len(bits), 1 << 20):
                total += bits[lo : lo + (1 << 20)].T @ bits[lo : lo + (1 << 20)]
            n += len(bits)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, BITS * BITS), pa.int32()), pa.array([n, *total.astype(np.int64).ravel().tolist()], pa.int64())], names=["cell", "n"])

    cells = {r.cell: r.n for r in nodes.select("fp").mapInArrow(partial, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    return cells.get(-1, 0), np.array([cells.get(i, 0) for i in range(BITS * BITS)], dtype=float).reshape(BITS, BITS)


def correlated_partitions(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt into partitions of even size; each takes, one by one, the free bit most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    strength = np.abs(np.divide(both / max(n, 1) - np.outer(p, p), spread, out=np.zeros_like(both), where=spread > 1e-12))
    np.fill_diagonal(strength, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        width = (BITS - sum(map(len, out))) // (parts - k)
        group = [max(free, key=lambda b: (strength[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < width:
            nxt = max(free, key=lambda b: (strength[b, group].sum(), -b))
            group.append(nxt)
            free.remove(nxt)
        out.append(sorted(group))
    return out


def within(p: np.ndarray, most: int) -> list[float]:
    """Estimated share of pairs that differ in at most t of the bits, for t up to `most`; p: the bits' shares of ones."""
    dist = np.zeros(most + 2)
    dist[0] = 1
    for differ in 2 * p * (1 - p):
        dist[1:] = dist[1:] * (1 - differ) + dist[:-1] * differ
        dist[0] *= 1 - differ
    return np.cumsum(dist[: most + 1]).tolist()


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one for each row of costs and summing to `total`, with the least cost; costs[i][t + 1] is that of threshold t, from -1 (not probed)."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, own in enumerate(row, start=-1):
                if cost + own < nxt.get(spent + t, (inf,))[0]:
                    nxt[spent + t] = (cost + own, [*chosen, t])
        best = nxt
    return best[total]


def search_plan(n: int, both: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """The partitions and thresholds with the least estimated work."""
    n = max(n, 1)  # without fingerprints every plan would cost nothing, even one with thousands of probes
    p, best = np.diag(both) / n, (inf, [])
    for parts in range(2, distance + 2):
        groups = correlated_partitions(n, both, parts)
        costs = []
        for g in groups:
            share = within(p[g], distance)
            costs.append([0.0] + [sum(comb(len(g), k) for k in range(t + 1)) * n * PROBE_COST + n * n / 2 * share[t] for t in range(distance + 1)])
        cost, thresholds = allocate(costs, distance - parts + 1)
        if cost < best[0]:
            best = (cost, list(zip(groups, thresholds, strict=True)))
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_components(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(node, component) over the distinct values of the column fp of `nodes`, for those with a link; component: the smallest node of it."""
    n, both = bit_statistics(nodes)
    plan = [(g, t) for g, t in search_plan(n, both, distance) if t >= 0]
    masks = [_signed(sum(1 << b for b in g)) for g, _ in plan]
    probes = [(i, masks[i], _signed(sum(1 << b for b in flip))) for i, (g, t) in enumerate(plan) for k in range(t + 1) for flip in combinations(g, k)]

    def signatures(df, rows):
        table = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(m).cast("long").alias("mask"), F.lit(x).cast("long").alias("flip")) for i, m, x in rows])
        return df.select("*", F.explode(table).alias("s")).select(*df.columns, F.col("s.part").alias("part"), F.col("fp").bitwiseAND(F.col("s.mask")).bitwiseXOR(F.col("s.flip")).alias("sig"))

    own = [(i, m, 0) for i, m in enumerate(masks)]
    index = signatures(nodes.select("fp"), own)
    close = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    ends = index.groupBy("part", "sig").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high")
    stars = index.join(ends, ["part", "sig"])
    near = [stars.where((F.col("fp") != F.col(e)) & close("fp", e)).select(F.col("fp").alias("a"), F.col(e).alias("b")) for e in ("low", "high")]
    first = checkpointed(connected_components(near[0].unionByName(near[1])))
    label = nodes.select("fp").join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("label"), F.col("component").isNotNull().alias("starred"))
    found = _between_labels(signatures(label.select("fp", "label"), probes), signatures(label.select("fp", "label"), own)).where((F.col("a") < F.col("b")) & close("a", "b"))
    second = connected_components(found.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()).select(F.col("node").alias("label"), F.col("component").alias("top"))
    return label.join(second, "label", "left").where(F.col("starred") | F.col("top").isNotNull()).select(F.col("fp").alias("node"), F.coalesce("top", "label").alias("component"))


def _between_labels(probes: DataFrame, index: DataFrame) -> DataFrame:
    """(a, la, b, lb): probes with the members of their bucket that have another label.

    Members of one label are never put side by side where they are many: a label with more than HEAVY members in a bucket
    meets the bucket's other heavy labels through the list of those, and light rows as usual."""
    bucket = ["part", "sig"]
    heavy = index.groupBy(*bucket, "label").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY).select(*bucket, "label")
    heavy = checkpointed(heavy.withColumn("heavy", F.lit(True)))
    left = probes.join(heavy, [*bucket, "label"], "left").select(*bucket, F.col("fp").alias("a"), F.col("label").alias("la"), F.col("heavy").isNotNull().alias("ha"))
    right = index.join(heavy, [*bucket, "label"], "left").select(*bucket, F.col("fp").alias("b"), F.col("label").alias("lb"), F.col("heavy").isNotNull().alias("hb"))
    columns = ["a", "la", "b", "lb"]
    light = left.where("not ha").join(right, bucket).where("la != lb").select(*columns)
    if heavy.isEmpty():
        return light
    mixed = left.where("ha").join(right.where("not hb"), bucket).where("la != lb").select(*columns)
    pairs = heavy.select(*bucket, F.col("label").alias("la")).join(heavy.select(*bucket, F.col("label").alias("lb")), bucket).where("la != lb")
    dense = left.where("ha").join(pairs, [*bucket, "la"]).join(right.where("hb"), [*bucket, "lb"]).select(*columns)
    return light.unionByName(mixed).unionByName(dense)


def fingerprint_classes(marked: DataFrame, lowest: F.Column, distance: int = DISTANCE) -> DataFrame:
    """(fp, component, least) for every value of the column fp of `marked`; least: the smallest value of `lowest`, an aggregate, over the component.

    The rows of a component are dealt over SALTS tasks when least is written to them."""
    nodes = checkpointed(marked.groupBy("fp").agg(lowest.alias("least")))
    linked = checkpointed(fingerprint_components(nodes, distance)).withColumnRenamed("node", "fp")
    named = nodes.join(linked, "fp", "left")
    alone = named.where("component is null").select("fp", F.col("fp").alias("component"), "least")
    many = named.where("component is not null")
    least = many.groupBy("component").agg(F.min("least").alias("least")).select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    many = many.select("fp", "component", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int").alias("salt")).join(least, ["component", "salt"])
    return alone.unionByName(many.select("fp", "component", "least"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp (long), component_id for every row of `docs`: the smallest doc_id that links within `distance` bits reach.

    Null and empty texts have fingerprint zero and are linked like any other. Null ids never become a component_id unless
    a component has no other. Repeated rows stay repeated; other columns are not looked at. An empty table gives an empty result."""
    marked = checkpointed(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fp"))
    return marked.join(fingerprint_classes(marked, F.min("doc_id"), distance), "fp").select("doc_id", "fp", F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row of each component of `docs`: that with the smallest doc_id, nulls last, and of texts that share it the one with the smallest hash.

    Rows with equal id and text are one row; which of them stays, if other columns differ, is not fixed. Rows that repeat an
    id with unlike texts are judged each by its own text. An empty table gives an empty result."""
    keys = [F.xxhash64(F.col("doc_id").isNull(), "doc_id").alias("__dt_id"), F.xxhash64("text").alias("__dt_th")]
    marked = checkpointed(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", *keys, "fp"))
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__dt_th").alias("th"), F.col("__dt_id").alias("id"))
    first = fingerprint_classes(marked, F.min(rank), distance).select(F.col("least.id").alias("__dt_id"), F.col("least.th").alias("__dt_th")).distinct()
    return docs.select("*", *keys).join(first, ["__dt_id", "__dt_th"]).dropDuplicates(["__dt_id", "__dt_th"]).select(*docs.columns)

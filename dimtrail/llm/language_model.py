"""N-gram scoring by deleted interpolation.

The probability of a token after the two before it is a mixture of maximum-likelihood estimates of orders 3 to 1 and a
uniform one,

    a[b] * c(u v w) / c(u v) + b[b] * c(v w) / c(v) + c[b] * c(w) / N + d[b] / (V + 1),

whose weights depend on the bucket b of the context: the power of two of c(u v) where that is not 0, else that of c(v),
else none. The weights are learned by expectation-maximisation on the tokens of a deleted part of the training texts,
with counts of the rest; then the counts of the whole training part are put in. Every word has n-grams of its own,
however rare it is.

Words are 64-bit hashes. Pairs and triples are hashes of SPARE_BITS bits more than it takes to number the bytes of the
input, so that the chance that an n-gram is taken for another stays below 1 in 250,000 at every size. Documents are dealt into blocks of about BLOCK_BYTES by a hash of id and
text, those of the deleted part, of the rest and of the held-out texts into blocks of their own. A block asks for its
distinct n-grams in sorted arrays; parts of the key space add up the arrays of all blocks and answer each block with the
totals. Nothing of the vocabulary is broadcast or collected, and what moves grows with the distinct n-grams of the blocks.

There are as many parts as blocks, so a block's request has as many rows; with very large inputs raise block_bytes along
with the memory of a task (about 30 times block_bytes), so that rows still hold many keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dimtrail.llm.common import checkpointed

HELD_OUT, DELETED, FOLDS = 2, 0, 7
ORDERS = 3
#: Bits that keys of pairs and triples have beyond the size of the input.
SPARE_BITS = 18
BLOCK_BYTES = 8 << 20
#: Bytes of text whose hashed bytes are held at a time.
SLICE = 1 << 20
ROUNDS = 100
#: Cells of the held-out tokens: estimates to the uniform one in steps of 2 ** (1 / STEPS). A cell carries its mean estimates.
STEPS = 1
KEPT_BLOCK, DELETED_BLOCK, HELD_OUT_BLOCK = 0, 1, 2


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
END, START, _TRIPLE = (mixed(np.array([k], np.uint64))[0] for k in (101, 102, 103))


def _powers(base: int) -> np.ndarray:
    out = np.full(SLICE, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens one after another, and the token count of each text; null counts as empty.

    A word's hash is a sum over its bytes times powers of their places, taken from running sums over the text."""
    texts = pc.cast(pc.fill_null(texts, ""), pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    word = _IN_WORD[data]
    begin, finish = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    finish[:-1] &= ~word[1:]
    filled = offsets[1:] > offsets[:-1]
    begin[offsets[:-1][filled]] = word[offsets[:-1][filled]]
    finish[offsets[1:][filled] - 1] = word[offsets[1:][filled] - 1]
    starts, stops = np.flatnonzero(begin), np.flatnonzero(finish)
    del begin, finish, word
    before, after, scale = (np.empty(len(starts), np.uint64) for _ in range(3))
    carry, up, down = np.uint64(0), 1, 1
    for lo in range(0, len(data), SLICE):
        run = _BYTE[data[lo : lo + SLICE]]
        run *= _UP[: len(run)]
        np.cumsum(run, out=run)
        run *= np.uint64(up)
        run += carry
        a, b = np.searchsorted(starts, [lo, lo + SLICE])
        here = starts[a:b] - lo
        before[a:b] = np.where(here > 0, run[here - 1], carry)
        scale[a:b] = _DOWN[here] * np.uint64(down)
        a, b = np.searchsorted(stops, [lo, lo + SLICE])
        after[a:b] = run[stops[a:b] - lo]
        carry = run[-1]
        up, down = up * pow(_BASE, SLICE, 1 << 64) % (1 << 64), down * pow(_INVERSE, SLICE, 1 << 64) % (1 << 64)
    after -= before
    after *= scale
    lengths = np.diff(np.searchsorted(starts, offsets)) + 1
    out = np.full(int(lengths.sum()), END, np.uint64)
    ends = np.zeros(len(out), bool)
    ends[np.cumsum(lengths) - 1] = True
    out[~ends] = mixed(after)
    return out, lengths


def shifted(values: np.ndarray, firsts: np.ndarray, fill) -> np.ndarray:
    """The value of the token before; `fill` for a text's first token."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[firsts] = fill
    return out


def ngram_keys(tokens: np.ndarray, lengths: np.ndarray, bits: int) -> list[np.ndarray]:
    """Keys of the word, pair and triple that end at each token; a text begins after two starts. Words have all 64 bits, since their counts are to be exact."""
    firsts = np.cumsum(lengths) - lengths
    two = mixed(mixed(shifted(tokens, firsts, START)) ^ tokens)
    three = shifted(two, firsts, START)
    three += _TRIPLE
    three = mixed(mixed(three) ^ tokens)
    two, three = two >> np.uint64(64 - bits), three >> np.uint64(64 - bits)
    return [tokens, two, three]


def packed(values: np.ndarray) -> bytes:
    """Numbers as byte planes, as many as the largest needs, each compressed by itself; before them their number, and the size of each plane."""
    width = max((int(values.max(initial=0)).bit_length() + 7) // 8, 1)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    made = [pa.compress(plane.tobytes(), codec="zstd", asbytes=True) for plane in planes] if len(values) else []
    return np.array([len(values), *map(len, made)], "<u4").tobytes() + bytes(4) + b"".join(made)


def unpacked(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:4], "little")
    out = np.zeros((size, 8), np.uint8)
    sizes = []
    while (n := int.from_bytes(data[4 * len(sizes) + 4 : 4 * len(sizes) + 8], "little")) > 0:
        sizes.append(n)
    at = 4 * len(sizes) + 8
    for plane, n in enumerate(sizes):
        out[:, plane] = np.frombuffer(pa.decompress(data[at : at + n], size, codec="zstd"), np.uint8)
        at += n
    return out.view("<u8").ravel()


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return keys[first], np.diff(first, append=len(keys))


def block_keys(texts: pa.ChunkedArray, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    tokens, lengths = token_hashes(texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0))
    return ngram_keys(tokens, lengths, bits), lengths


REQUEST = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("part", T.IntegerType()), *[T.StructField(f"{c}{k}", T.BinaryType()) for c in ("keys", "n") for k in range(ORDERS)]])
ANSWER = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("part", T.IntegerType()), *[T.StructField(f"{c}{k}", T.BinaryType()) for c in ("n", "kept") for k in range(ORDERS)], T.StructField("totals", T.ArrayType(T.LongType()))])
CELL = T.StructType([T.StructField("cell", T.LongType()), T.StructField("n", T.LongType()), *[T.StructField(f"p{k}", T.DoubleType()) for k in range(ORDERS)]])


def _table(rows: list[tuple], schema: T.StructType) -> pa.Table:
    arrow = to_arrow_schema(schema)
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)


def requests_of(block: pa.Table, parts: int, bits: int) -> pa.Table:
    """A block's distinct keys of each order, with their counts unless it is held out, by part of the key space."""
    keys, _ = block_keys(block.column("text"), bits)
    kind = block.column("kind")[0].as_py()
    found = [counted(k) for k in keys]
    cuts = [[0, *np.searchsorted(k, np.array([p * (1 << bits) // parts for p in range(1, parts)], np.uint64)).tolist(), len(k)] for (k, _), bits in zip(found, (64, bits, bits), strict=True)]
    rows = []
    for p in range(parts):
        own = [(k[c[p] : c[p + 1]], n[c[p] : c[p + 1]]) for (k, n), c in zip(found, cuts, strict=True)]
        if any(len(k) for k, _ in own):
            rows.append((block.column("block")[0].as_py(), kind, p, *[packed(np.diff(k, prepend=np.uint64(0))) for k, _ in own], *[None if kind == HELD_OUT_BLOCK else packed(n) for _, n in own]))
    return _table(rows, REQUEST)


def answers_of(part: pa.Table) -> pa.Table:
    """The totals of a part's keys for every block that asked, and for deleted blocks the counts of the kept part too; and a row of totals: tokens and distinct words, of all and of the kept training texts."""
    blocks, kinds = part.column("block").to_pylist(), np.array(part.column("kind").to_pylist())
    number = part.column("part")[0].as_py()
    out, totals = [[b, k, number] for b, k in zip(blocks, kinds.tolist(), strict=True)], None
    kept_of = [[] for _ in blocks]
    for order in range(ORDERS):
        keys = [np.cumsum(unpacked(k.as_py())) for k in part.column(f"keys{order}")]
        sizes = [len(k) for k in keys]
        keys = np.concatenate(keys)
        by_key = np.argsort(keys)
        first = np.flatnonzero(np.diff(keys[by_key], prepend=~keys[by_key[:1]]))
        del keys
        counts = np.concatenate([np.zeros(size, np.int64) if n.as_py() is None else unpacked(n.as_py()).astype(np.int64) for n, size in zip(part.column(f"n{order}"), sizes, strict=True)])
        total = np.add.reduceat(counts[by_key], first) if len(first) else counts
        counts[np.repeat(kinds != KEPT_BLOCK, sizes)] = 0
        kept = np.add.reduceat(counts[by_key], first) if len(first) else counts
        place = np.empty(len(by_key), np.int64)
        place[by_key] = np.repeat(np.arange(len(first)), np.diff(first, append=len(by_key)))
        del by_key, counts
        if order == 0:
            totals = [int(total.sum()), int((total > 0).sum()), int(kept.sum()), int((kept > 0).sum())]
        at = 0
        for i, size in enumerate(sizes):
            own = place[at : at + size]
            out[i].append(packed(total[own]))
            kept_of[i].append(packed(kept[own]) if kinds[i] == DELETED_BLOCK else None)
            at += size
    rows = [(*head, *kept, None) for head, kept in zip(out, kept_of, strict=True)]
    return _table([*rows, (None, None, number, *[None] * (2 * ORDERS), totals)], ANSWER)


def token_counts(keys: list[np.ndarray], answers: pa.Table, column: str) -> list[np.ndarray]:
    """Counts of each token's n-grams of each order, from a block's answers."""
    by_part = np.argsort(np.array(answers.column("part").to_pylist()), kind="stable")
    out = []
    for order, own in enumerate(keys):
        place = np.unique(own, return_inverse=True)[1]
        got = answers.column(f"{column}{order}").to_pylist()
        out.append(np.concatenate([unpacked(got[i]) for i in by_part]).astype(np.int64)[place])
    return out


def estimates(counts: list[np.ndarray], lengths: np.ndarray, tokens: int, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood estimates of each order (rows, from 1) of every token, and its bucket."""
    firsts = np.cumsum(lengths) - lengths
    texts = counts[0][firsts[0] + lengths[0] - 1] if len(lengths) else 0  # as many as ends
    p, context = np.empty((ORDERS, len(counts[0]))), None
    p[0] = counts[0] / max(tokens, 1)
    bucket = np.zeros(len(counts[0]), np.int64)
    for k in range(1, ORDERS):
        context = shifted(counts[k - 1], firsts, texts)
        p[k] = counts[k] / np.maximum(context, 1)
        bucket = np.where(context > 0, 64 * k + np.log2(np.maximum(context, 1)).astype(np.int64), bucket)
    return p, bucket


def held_out_cells(block: pa.Table, answers: pa.Table, bits: int, tokens: int, distinct: int) -> pa.Table:
    """(cell, n, p0, p1, p2): tokens of a deleted block by bucket and estimates, with counts of the kept part; p: sums of the estimates to the uniform one."""
    keys, lengths = block_keys(block.column("text"), bits)
    p, bucket = estimates(token_counts(keys, answers, "kept"), lengths, tokens, distinct)
    p *= distinct + 1
    cell = bucket
    with np.errstate(divide="ignore"):
        for row in p:
            cell = cell << 11 | np.where(row > 0, np.clip(np.round(np.log2(row) * STEPS) + 1024, 1, 2047), 0).astype(np.int64)
    cells, place = np.unique(cell, return_inverse=True)
    return pa.Table.from_arrays([pa.array(cells), pa.array(np.bincount(place)), *[pa.array(np.bincount(place, row)) for row in p]], schema=to_arrow_schema(CELL))


def em_weights(cells: list[tuple], rounds: int = ROUNDS) -> np.ndarray:
    """Weights (uniform, order 1 to 3) of each bucket from (cell, n, p0, p1, p2) rows; a bucket without tokens has those of the nearest of its kind."""
    weights = np.zeros((64 * ORDERS, ORDERS + 1))
    for kind in range(ORDERS):
        weights[64 * kind : 64 * kind + 64, : kind + 2] = 1 / (kind + 2)
    table = np.array(sorted(cells), float).reshape(-1, 2 + ORDERS)
    bucket = np.array([c[0] >> 11 * ORDERS for c in sorted(cells)], np.int64)
    known = np.unique(bucket)
    for b in known.tolist():
        n = table[bucket == b, 1]
        p = np.vstack([np.ones(len(n)), (table[bucket == b, 2:] / n[:, None]).T])
        w = weights[b].copy()
        for _ in range(rounds):
            share = w[:, None] * p
            w = (share / share.sum(axis=0) * n).sum(axis=1) / n.sum()
            w = np.where(weights[b] > 0, np.maximum(w, 1e-9), 0)
            w /= w.sum()
        weights[b] = w
    for b in range(len(weights)):
        kin = known[known // 64 == b // 64]
        if len(kin) and b not in kin:
            weights[b] = weights[kin[np.argmin(np.abs(kin - b))]]
    return weights


def scores_of(block: pa.Table, answers: pa.Table, bits: int, weights: np.ndarray, tokens: int, distinct: int, schema: pa.Schema) -> pa.Table:
    """Scores of a block's documents with the counts it was answered."""
    keys, lengths = block_keys(block.column("text"), bits)
    counts = token_counts(keys, answers, "n")
    p, bucket = estimates(counts, lengths, tokens, distinct)
    w = weights if tokens else np.eye(ORDERS + 1)[np.zeros(len(weights), int)]
    p = w[bucket, 0] / (distinct + 1) + sum(w[bucket, k + 1] * p[k] for k in range(ORDERS))
    firsts = np.cumsum(lengths) - lengths
    total = lambda x: np.add.reduceat(x, firsts)
    made = [block.column("doc_id").combine_chunks(), pa.array(np.full(len(lengths), block.column("kind")[0].as_py() == HELD_OUT_BLOCK)), pa.array(lengths), pa.array(total((counts[0] > 0).astype(np.int64))), pa.array(np.full(len(lengths), tokens)), pa.array(total(np.log10((counts[0] + 1) / (tokens + distinct + 1)))), pa.array(total(np.log10(p)))]
    return pa.Table.from_arrays([a.cast(f.type) for a, f in zip(made, schema, strict=True)], schema=schema)


def with_scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of `docs`.

    A null or empty text is its end alone. A null id is in the fold of the empty text. Repeated rows are texts of their own.
    With no training text every count is 0. Other columns aren't looked at; an empty table gives an empty result."""
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    kind = F.when(fold == HELD_OUT, HELD_OUT_BLOCK).when(fold == DELETED, DELETED_BLOCK).otherwise(KEPT_BLOCK)
    docs = docs.select("doc_id", "text", kind.cast("int").alias("kind"))
    sizes = {r.kind: r.bytes or 0 for r in docs.groupBy("kind").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()}
    blocks = [sizes[k] // block_bytes + 1 if k in sizes else 0 for k in range(3)]
    n_blocks = max(sum(blocks), 1)
    parts = n_blocks
    bits = min(sum(sizes.values()).bit_length() + SPARE_BITS, 64)
    of_kind = lambda values: F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), F.col("kind") + 1)
    block = of_kind(np.cumsum(blocks) - blocks) + F.pmod(F.xxhash64("doc_id", "text"), of_kind(np.maximum(blocks, 1)))
    dealt = docs.withColumn("block", block.cast("int")).repartitionById(n_blocks, "block")  # a block or part a task

    requests = dealt.groupBy("block").applyInArrow(lambda table: requests_of(table, parts, bits), REQUEST)
    answers = checkpointed(requests.repartitionById(parts, "part").groupBy("part").applyInArrow(answers_of, ANSWER))
    tokens, distinct, kept_tokens, kept_distinct = answers.where("totals is not null").agg(*[F.coalesce(F.sum(F.col("totals")[i]), F.lit(0)) for i in range(4)]).first()
    answers = answers.where("block is not null").drop("totals")
    n_deleted = max(blocks[DELETED_BLOCK], 1)
    wanted = answers.where(F.col("kind") == DELETED_BLOCK).repartition(n_deleted, "block")
    deleted = docs.where(F.col("kind") == DELETED_BLOCK).withColumn("block", block.cast("int")).repartition(n_deleted, "block")
    cells = deleted.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(lambda left, right: held_out_cells(left, right, bits, kept_tokens, kept_distinct), CELL)
    cells = cells.groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(ORDERS)])
    weights = em_weights([tuple(r) for r in cells.collect()])  # cells of a fixed grid, some ten thousand in use

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(n, t) for n, t in (("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))]]
    arrow = to_arrow_schema(T.StructType(fields))
    return dealt.groupBy("block").cogroup(answers.repartitionById(n_blocks, "block").groupBy("block")).applyInArrow(lambda left, right: scores_of(left, right, bits, weights, tokens, distinct, arrow), T.StructType(fields))

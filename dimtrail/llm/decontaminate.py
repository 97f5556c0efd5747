"""Benchmark decontamination with an Aho-Corasick automaton over word codes.

Every word of the benchmark gets a code of a few characters, all of one width, every window of WINDOW consecutive words
of an item (an item of fewer words is one window) becomes a key, and each document is read once: its words turn into
codes, words that no item has into one code that no key has. A code is a number in base 16 with other digits at each
place, so matches start where words do and no state of the automaton has more than a few followers. Positions in the
coded text give word positions, from which hit passages are mapped back to character offsets of the original.

The automaton is made of at most MAX_BLOCK_BYTES of benchmark text. Its size is checked first; a larger benchmark is
dealt into blocks, each of which is broadcast and scans the documents in tasks of its own. An automaton takes about 350
times its text, so that a task's takes some 350 MB at most."""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimtrail.llm.common import append_columns, lower_ascii, utf8

WINDOW = 13
MAX_BLOCK_BYTES = 1 << 20
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = 16

RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
]
_FOUND = "__dt_found"
_FOUND_TYPE = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))]))


#: Lower-cases A-Z and turns every byte that no word has into a blank.
_WORDS = bytes(32 if WORD.fullmatch(lower_ascii(bytes([b]))) is None else lower_ascii(bytes([b]))[0] for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(_WORDS).split()


class Scanner:
    """The automaton of a list of (item id as string or None, text)."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        texts = [(item, words_of(text)) for item, text in items]
        known = dict.fromkeys(w for _, words in texts for w in words)
        self.width = 1
        while BASE**self.width < len(known):
            self.width += 1
        self.codes = {w: "".join(chr(1 + place * BASE + n // BASE**place % BASE) for place in range(self.width)) for n, w in enumerate(known)}
        self.unknown = "\x00" * self.width
        keys: dict[str, tuple[int, set]] = {}
        for item, words in texts:
            for i in range(max(1, len(words) - window + 1) if words else 0):
                part = words[i : i + window]
                keys.setdefault("".join([self.codes[w] for w in part]), (len(part), set()))[1].add(item)
        self.automaton = ahocorasick.Automaton()
        for key, value in keys.items():
            self.automaton.add_word(key, value)
        self.empty = not keys
        if keys:
            self.automaton.make_automaton()

    def find(self, words: list[bytes]) -> list[tuple[int, int, set]]:
        """(first word, last word, item ids) of every window in the text."""
        if self.empty or not words:
            return []
        get, unknown, width = self.codes.get, self.unknown, self.width
        coded = "".join([get(w, unknown) for w in words])
        return [(end // width - n + 1, end // width, ids) for end, (n, ids) in self.automaton.iter(coded)]


def merged(windows: list[tuple[int, int]]) -> list[list[int]]:
    runs: list[list[int]] = []
    for first, last in sorted(windows):
        if runs and first <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], last)
        else:
            runs.append([first, last])
    return runs


def verdict(text: str | None, words: list[bytes], found: list[tuple[int, int, set]]) -> tuple:
    """The fields of RESULT."""
    runs = merged([(a, b) for a, b, _ in found])
    hit = sum(b - a + 1 for a, b in runs)
    ids = sorted({i for _, _, s in found for i in s if i is not None})
    spans = []
    if runs:
        data = utf8(text)
        at = [m.span() for m in WORD.finditer(lower_ascii(data))]
        length, done = 0, 0
        for a, b in runs:
            length += len(data[done : at[a][0]].decode("utf-8", "surrogatepass"))
            start, done = length, at[a][0]
            length += len(data[done : at[b][1]].decode("utf-8", "surrogatepass"))
            spans.append({"start": start, "end": length})
            done = at[b][1]
    return len(words), hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0 and 20 * hit >= len(words), ids, spans


def benchmark_blocks(benchmark: DataFrame, limit: int = MAX_BLOCK_BYTES) -> list[DataFrame]:
    """The distinct items in blocks of about `limit` bytes of text."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // limit) or 1
    if blocks == 1:
        return [items]
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) for b in range(blocks)]


def with_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = MAX_BLOCK_BYTES) -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256, contaminated, item_ids and spans (character offsets of hit passages) to every row.

    A null or empty text has no words and is not contaminated. Benchmark rows with a null text or without words have no
    window; those with a null id hit words but name no item; repeated rows count once. With an empty benchmark nothing is hit."""
    blocks = benchmark_blocks(benchmark, limit)
    context = docs.sparkSession.sparkContext
    if len(blocks) == 1:
        shared = context.broadcast([(r.item, r.text) for r in blocks[0].collect()])

        def make():
            scanner = scanner_of(shared, window)

            def compute(texts):
                out = []
                for t in texts:
                    words = words_of(t)
                    out.append(verdict(t, words, scanner.find(words)))
                return list(zip(*out, strict=True))

            return compute

        return append_columns(docs, RESULT, make)

    text_hash = F.xxhash64("text").alias("__dt_th")
    hits = None
    for block in blocks:  # a scan each, so that a task holds one automaton; only rows that are hit move
        found = _scan_block(docs.select("doc_id", "text"), context.broadcast([(r.item, r.text) for r in block.collect()]), window, _FOUND)
        found = found.where(F.size(_FOUND) > 0).select(F.col("doc_id").alias("__dt_id"), text_hash, _FOUND)
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.groupBy("__dt_id", "__dt_th").agg(F.flatten(F.collect_set(_FOUND)).alias(_FOUND))
    both = docs.join(hits, docs["doc_id"].eqNullSafe(F.col("__dt_id")) & (F.xxhash64(docs["text"]) == F.col("__dt_th")), "left")
    return _judge(both.select(*docs.columns, _FOUND), _FOUND)


_SCANNERS: dict = {}


def scanner_of(shared, window: int) -> Scanner:
    """One automaton in a worker at a time."""
    key = (shared.id if hasattr(shared, "id") else None, shared._path if hasattr(shared, "_path") else id(shared), window)
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = Scanner(shared.value, window)
    return _SCANNERS[key]


def _scan_block(docs: DataFrame, shared, window: int, column: str) -> DataFrame:
    def make():
        scanner = Scanner(shared.value, window)

        def compute(texts):
            return [[[{"first": a, "last": b, "items": list(ids)} for a, b, ids in scanner.find(words_of(t))] for t in texts]]

        return compute

    return append_columns(docs, [T.StructField(column, _FOUND_TYPE)], make)


def _judge(docs: DataFrame, column: str) -> DataFrame:
    rest = [c for c in docs.columns if c != column and c not in {f.name for f in RESULT}]
    both = docs.select(*rest, F.struct("text", F.col(column).alias("found")).alias("__dt_both"))
    schema = T.StructType([f for f in both.schema.fields if f.name != "__dt_both"] + RESULT)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index("__dt_both")).to_pylist()
            made = [verdict(r["text"], words_of(r["text"]), [(f["first"], f["last"], set(f["items"])) for f in r["found"] or []]) for r in rows]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in rest]
            arrays += [pa.array([m[i] for m in made], types.field(f.name).type) for i, f in enumerate(RESULT)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rest, *[f.name for f in RESULT]])

    return both.mapInArrow(run, schema)

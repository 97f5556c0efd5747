"""Repeated lines and sentences, removed wherever they stand but first.

A text's units are its lines that aren't blank, of any length, and the sentences of lines that have more than one. Units
are normalised (lower case, single blanks) and hashed to 128 bits. A sentence of fewer than MIN_WORDS words says too little
alone: it is hashed with as many sentences before it, and once more with as many after it, as make MIN_WORDS words, and
goes when either run repeats. Digests are grouped over all documents and the occurrence with the smallest (document id,
offset) stays. A repeated line goes with its line end; in lines that stay, repeated
sentences go. What is taken out is reported by its offsets in the original text.

Digests are counted first, combined inside the tasks. The ones that repeat set bits in a broadcast table of bounded size,
and only units whose bit is set are joined with them; a bit too many costs time, never a result. The repeated digests are
written out before the join, so that Spark sees the sizes of both sides and splits the partition of one that very many
documents have."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimtrail.llm.common import checkpointed, slices

MIN_WORDS = 8
#: Text whose units are held at a time; a single longer text still goes as one.
SLICE_BYTES = 1 << 20
#: Bits of the table of repeated digests, at most (64 MB) and in one of its chunks.
MOST_BITS, CHUNK_BITS = 29, 20
SENTENCE = re.compile(r"[^.!?]+[.!?]*\s*|[.!?]+\s*")


def units(text: str | None, min_words: int = MIN_WORDS) -> list[tuple[int, int, bool, str]]:
    """(start, end, whether it is a line, normalised text) of the units in text order; a line comes before its sentences, and a short sentence comes with each of its runs."""
    out, at = [], 0
    for line in (text or "").split("\n"):
        words = line.lower().split()
        if words:
            out.append((at, at + len(line) + 1, True, " ".join(words)))
        if len(words) >= min_words:
            parts, start = [], at
            for part in SENTENCE.findall(line):  # they cover the line
                own = part.lower().split()
                if own:
                    parts.append((start, start + len(part), own))
                start += len(part)
            if len(parts) > 1:
                for i, (start, end, own) in enumerate(parts):
                    if len(own) >= min_words:
                        out.append((start, end, False, " ".join(own)))
                        continue
                    for mark, step in (("\x00<", -1), ("\x00>", 1)):  # a run is no line and no sentence, nor a run to the other side
                        k, run = i, own
                        while len(run) < min_words and 0 <= k + step < len(parts):
                            k += step
                            run = run + parts[k][2] if step > 0 else parts[k][2] + run
                        if len(run) >= min_words:
                            out.append((start, end, False, mark + " ".join(run)))
        at += len(line) + 1
    return out


def digests(docs: DataFrame, min_words: int = MIN_WORDS, marks: Broadcast | None = None) -> DataFrame:
    """(doc_id, th, span, line, again, hi, lo): the units of every row with their digests; with marks, those whose bit is set.

    th, a hash of the text, tells rows of one id but different texts apart; span is start << 32 | end; again marks a unit
    that the same text has before. Null and blank texts have no units; repeated rows have theirs each."""

    def run(batches):
        for batch in (b.slice(lo, hi - lo) for b in batches for lo, hi in slices(b.column(1), SLICE_BYTES)):
            counts, spans, lines, again, hashes = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = units(text, min_words)
                counts.append(len(found))
                own = [xxhash.xxh3_128_digest(u[3].encode("utf-8", "surrogatepass")) for u in found]
                seen: set[bytes] = set()
                for u, h in zip(found, own, strict=True):
                    spans.append(u[0] << 32 | u[1])
                    lines.append(u[2])
                    again.append(h in seen)
                    seen.add(h)
                hashes += own
            if spans:
                row = pa.array(np.repeat(np.arange(len(counts)), counts))
                both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
                arrays = [batch.column(0).take(row), batch.column(2).take(row), pa.array(spans, pa.int64()), pa.array(lines), pa.array(again), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]
                made = pa.RecordBatch.from_arrays(arrays, names=["doc_id", "th", "span", "line", "again", "hi", "lo"])
                if marks is not None:
                    place = both[:, 0] & (8 * len(marks.value) - 1)
                    made = made.filter(pa.array((marks.value[place >> 3] >> (place & 7) & 1).astype(bool)))
                yield made

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, f"doc_id {kind}, th long, span long, line boolean, again boolean, hi long, lo long")


def marked_digests(firsts: DataFrame) -> Broadcast:
    """One bit for each place of a table of 16 to 32 times as many as there are digests, at most 2 ** MOST_BITS, set where one falls."""
    size = 1 << min(max((16 * firsts.count()).bit_length(), CHUNK_BITS), MOST_BITS)

    def chunk(key: tuple[pa.Scalar, ...], digests: pa.Table) -> pa.Table:
        bits = np.zeros(1 << CHUNK_BITS, np.uint8)
        bits[digests.column("place").to_numpy() & ((1 << CHUNK_BITS) - 1)] = 1
        return pa.table({"chunk": [key[0].as_py()], "bits": [np.packbits(bits, bitorder="little").tobytes()]}, schema=pa.schema([("chunk", pa.int64()), ("bits", pa.binary())]))

    place = F.pmod(F.col("hi"), F.lit(size))
    chunks = firsts.select(place.alias("place")).groupBy(F.shiftright("place", CHUNK_BITS).alias("chunk")).applyInArrow(chunk, "chunk long, bits binary")
    out = np.zeros((size >> CHUNK_BITS, 1 << CHUNK_BITS - 3), np.uint8)
    for r in chunks.collect():  # at most 2 ** (MOST_BITS - CHUNK_BITS) rows
        out[r.chunk] = np.frombuffer(r.bits, np.uint8)
    return firsts.sparkSession.sparkContext.broadcast(out.ravel())


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, span, line, first_id) of every unit that an earlier one repeats; first_id: the document of the first.

    A null id ranks first; texts that share an id rank by th."""
    found = digests(docs, min_words)
    none = F.col("doc_id").isNull()
    firsts = found.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max(none).alias("null_first")).where("n > 1")
    firsts = checkpointed(firsts.select("hi", "lo", "null_first", F.when(~F.col("null_first"), F.col("first_id")).alias("first_id")))
    hits = digests(docs, min_words, marked_digests(firsts)).join(firsts, ["hi", "lo"])
    later = F.when(F.col("null_first"), ~none).otherwise(F.col("doc_id") > F.col("first_id")) | F.col("again")
    twins = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high")).where("low != high")
    twins = checkpointed(twins.select(F.col("doc_id").alias("twin")))
    if not twins.isEmpty():  # of the texts of the first id, only the one with the smallest hash has the first unit
        own = digests(docs.join(twins, F.col("doc_id").eqNullSafe(F.col("twin")), "left_semi"), min_words)
        low = own.groupBy("hi", "lo", F.col("doc_id").alias("twin")).agg(F.min("th").alias("low"))
        same = (hits["hi"] == low["hi"]) & (hits["lo"] == low["lo"]) & hits["doc_id"].eqNullSafe(F.col("twin"))
        hits = hits.join(low, same, "left").drop(low["hi"], low["lo"])
        later = later | F.coalesce(F.col("th") > F.col("low"), F.lit(False))
    return hits.where(later).select("doc_id", "th", "span", "line", "first_id")


def with_units_removed(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row with repeated units taken out of text; adds removed (array of start, end, first_id by original offsets, merged where they touch) and n_removed.

    n_removed counts lines, and sentences of lines that stay. Null texts stay null and empty ones empty, with nothing
    removed. Rows that repeat id and text are one document and keep the same units; a null id ranks first, and texts that
    share an id rank by a hash. A column n_chars is set to the new length; other columns stay as they are."""
    unit = F.struct("span", "line", "first_id")
    spans = repeated_units(docs, min_words).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(unit)).alias("__dt_spans"))
    spans = spans.select(F.col("doc_id").alias("__dt_id"), F.col("th").alias("__dt_th"), "__dt_spans")
    names = [c for c in docs.columns if c not in ("removed", "n_removed")]
    both = docs.select(*names).join(spans, docs["doc_id"].eqNullSafe(F.col("__dt_id")) & (F.xxhash64("text") == F.col("__dt_th")), "left").select(*names, "__dt_spans")
    id_type = docs.schema["doc_id"].dataType
    span_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("first_id", id_type)]))
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("removed", span_type), T.StructField("n_removed", T.LongType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in (b.slice(lo, hi - lo) for b in batches for lo, hi in slices(b.column(b.schema.get_field_index("text")), SLICE_BYTES)):
            at = {n: batch.schema.get_field_index(n) for n in names}
            texts = batch.column(at["text"]).to_pylist()
            cut = [cut_out(t, s) for t, s in zip(texts, batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            columns = {n: batch.column(i) for n, i in at.items()}
            columns["text"] = pa.array([c[0] for c in cut], kinds.field("text").type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if c[0] is None else len(c[0]) for c in cut], kinds.field("n_chars").type)
            columns |= {"removed": pa.array([c[1] for c in cut], kinds.field("removed").type), "n_removed": pa.array([c[2] for c in cut], pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema.fields], names=schema.names)

    return both.mapInArrow(run, schema)


def cut_out(text: str | None, spans: list[dict] | None) -> tuple[str | None, list[dict], int]:
    """The text without the spans (sorted by start), the spans merged where they touch or overlap, and how many lines, and sentences of other lines, they were."""
    if not text or not spans:
        return text, [], 0
    merged: list[dict] = []
    taken, line_end = set(), 0
    for s in sorted(spans, key=lambda s: (s["span"] >> 32, -s["span"])):  # a line before its sentences
        start, end = s["span"] >> 32, s["span"] & 0xFFFFFFFF
        if s["line"]:
            line_end = end
        elif start < line_end:
            continue
        taken.add(s["span"])
        end = min(end, len(text))
        if merged and start <= merged[-1]["end"]:
            merged[-1]["end"] = max(merged[-1]["end"], end)
        else:
            merged.append({"start": start, "end": end, "first_id": s["first_id"]})
    kept, at = [], 0
    for s in merged:
        kept.append(text[at : s["start"]])
        at = s["end"]
    kept.append(text[at:])
    return "".join(kept), merged, len(taken)

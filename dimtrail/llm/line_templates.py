"""Line deduplication by a log-template tree of fixed depth.

A line's leaf is its token count and its first LEADING tokens, tokens with a digit standing for any. Inside a leaf a
token counts as constant at its place when lines of at least MIN_DOCS texts have it there; other tokens, and all with
a digit, become <*>. A template is what remains; it must be constant in at least CONSTANT of its places. The tree has two
levels below its root, the token count and the leading tokens, and both are one hash, the leaf's number; a leaf has as many
children as its lines have leading tokens, and a line is compared with none but the leaf's constant tokens. A template
recurs when it stands in at least MIN_DOCS different companies. Every line of a recurring template
is dropped. The company tells boilerplate, which stands in all kinds of documents, from copied documents, whose lines
keep each other's company and which are left to document deduplication.

A leaf of at least MIN_DOCS texts is common. A text with less than half of its other tokens in common leaves is a company
of its own. All other texts are copies of something and are one company for each head, the longest other common line;
a leaf is a head only if it is one of the two longest in at least half of its texts, so that a copy with a changed line
is no new company. Templates with enough texts of their own are found first; their lines then count for nothing when
the companies of the remaining templates are found. However many copies a company has, it counts once.

Totals of leaves and cells are written out before they are joined back, so that Spark sees both sides and splits the
partition of a line that very many documents have.

First the leaves of at least MIN_DOCS texts are counted, without their lines. A table of bits, 16 to 32 for each of them and at most
64 MB, then tells lines that may recur from those that don't; one that is let in by chance costs time, never a result."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dimtrail.llm.common import checkpointed
from dimtrail.llm.unit_dedup import marked_digests

LEADING = 3
MIN_DOCS = 3
CONSTANT = 0.7
_DIGIT = re.compile(r"\d")  # decimal digits of all scripts
DIGIT = r"\p{Nd}"  # the same for Spark
ANY = "<*>"
ADDED = ("n_lines", "dropped_lines", "repeated_lines")


def leaf_of(tokens: list[str], leading: int = LEADING) -> int:
    """The leaf's number; 0 for a line without tokens."""
    if not tokens:
        return 0
    head = [ANY if _DIGIT.search(t) else t for t in tokens[:leading]]
    return xxhash.xxh64_intdigest(f"{len(tokens)}\x00" + "\x00".join(head)) - (1 << 63)


def text_leaves(text: str | None) -> list[tuple[int, str]]:
    """(leaf, line with single blanks) of each line."""
    out = []
    for line in (text or "").split("\n"):
        tokens = line.split()
        out.append((leaf_of(tokens), " ".join(tokens)))
    return out


def _leaves(docs: DataFrame) -> DataFrame:
    """(leaf, th): the leaves of each text."""

    def run(batches):
        for batch in batches:
            leaves, hashes = [], []
            for text, th in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {leaf for leaf, line in text_leaves(text) if line}
                leaves += own
                hashes += [th] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array(hashes, pa.int64())], names=["leaf", "th"])

    return docs.select("text", F.xxhash64("text").alias("th")).mapInArrow(run, "leaf long, th long")


def common_leaves(docs: DataFrame, min_docs: int = MIN_DOCS) -> Broadcast:
    """Bits of the leaves of at least min_docs different texts, by unit_dedup.marked_digests; none are set for an empty table or null texts."""
    often = _leaves(docs).distinct().groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    return marked_digests(checkpointed(often.select(F.col("leaf").alias("hi"))))


def occurrences(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """(doc_id, th, at, leaf, line_id, line, held, total) of every line in a marked leaf, of every row, repeated ones too; null and blank texts have none. line_id: a hash of the line; held and total: the text's tokens in lines of this leaf, and in all lines."""

    def run(batches):
        marks = shared.value
        size = 8 * len(marks)
        for batch in batches:
            rows = []
            for doc_id, text, th in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                lines = [(at, leaf, line, line.count(" ") + 1) for at, (leaf, line) in enumerate(text_leaves(text)) if line]
                total, held = sum(x[3] for x in lines), Counter()
                for _, leaf, _, n in lines:
                    held[leaf] += n
                for at, leaf, line, n in lines:
                    place = leaf % size
                    if marks[place >> 3] >> (place & 7) & 1:
                        rows.append((doc_id, th, at, leaf, xxhash.xxh64_intdigest(line) - (1 << 63), line, held[leaf], total))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (batch.column(0).type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "th", "at", "leaf", "line_id", "line", "held", "total"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, f"doc_id {kind}, th long, at int, leaf long, line_id long, line string, held long, total long")


def _own(common: str, total: str) -> F.Column:
    """Whether less than half of a text's tokens outside the template's leaf are in common leaves."""
    return 2 * (F.col(common) - F.col("held")) < F.col(total) - F.col("held")


def recurring_templates(seen: DataFrame, held: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(leaf, template_id) of the templates in at least min_docs companies, none of none; seen: (leaf, template_id, th, held); held: (leaf, th, held, total) of all texts."""
    often = checkpointed(held.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs))
    lines = checkpointed(held.join(often, "leaf"))
    texts = lines.groupBy("th").agg(F.max("total").alias("total"), F.sum("held").alias("common"))
    first = seen.join(texts, "th").where(_own("common", "total")).groupBy("leaf", "template_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    first = checkpointed(first.select("leaf", "template_id"))
    known = first.select("leaf").distinct().withColumn("known", F.lit(True))
    lines = lines.join(known, "leaf", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    longest = F.slice(F.sort_array(F.collect_list(F.when(~F.col("known"), F.struct("held", "leaf"))), asc=False), 1, 2)["leaf"]
    of_known = lambda yes: F.coalesce(F.sum(F.when(F.col("known") == yes, F.col("held"))), F.lit(0))
    texts = checkpointed(lines.groupBy("th").agg((F.max("total") - of_known(True)).alias("total"), of_known(False).alias("common"), longest.alias("longest")))
    heads = texts.select(F.explode("longest").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("longest")).join(often, "leaf").where(2 * F.col("longest") >= F.col("n")).select(F.col("leaf").alias("head"))
    left = seen.join(first, ["leaf", "template_id"], "left_anti").join(texts, "th")
    own = left.where(_own("common", "total")).select("leaf", "template_id", F.struct(F.lit(1), "th").alias("company"))
    copies = left.where(~_own("common", "total")).select("leaf", "template_id", F.get(F.filter("longest", lambda x: x != F.col("leaf")), F.lit(0)).alias("head"))
    copies = copies.where("head is not null").distinct().join(heads, "head").select("leaf", "template_id", F.struct(F.lit(0), "head").alias("company"))
    second = own.unionAll(copies).distinct().groupBy("leaf", "template_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    return first.unionAll(second.select("leaf", "template_id"))


def recurring_lines(found: DataFrame, min_docs: int = MIN_DOCS, constant: float = CONSTANT, companies: bool = True) -> DataFrame:
    """(leaf, line_id, template, recurs) of the lines whose template stands in at least min_docs texts; recurs: in as many companies, or true without companies. Nothing found gives nothing.

    A token at its place in a leaf is one hash, its cell; lines travel as ids, and their text comes back for templates only."""
    counts = found.select("leaf", "line_id", "th").distinct().groupBy("leaf", "line_id").agg(F.count("*").alias("texts"))
    full = checkpointed(counts.groupBy("leaf").agg(F.sum("texts").alias("in_leaf")).where(F.col("in_leaf") >= min_docs))
    lines = counts.join(full, "leaf").join(found.groupBy("line_id").agg(F.min("line").alias("line")), "line_id").select("leaf", "line_id", "texts", "line")
    lines = checkpointed(lines)
    cell = lambda token, place: F.when(~token.rlike(DIGIT), F.xxhash64(F.col("leaf"), place, token))
    cells = lines.select("line_id", "texts", F.posexplode(F.transform(F.split("line", " "), cell)).alias("place", "cell")).where("cell is not null")
    fixed = cells.groupBy("cell").agg(F.sum("texts").alias("n")).where(F.col("n") >= min_docs).select("cell")
    fixed = checkpointed(fixed)
    places = cells.drop("texts").join(fixed, "cell").groupBy("line_id").agg(F.collect_list("place").alias("places"))
    tokens = F.split("line", " ")
    shaped = lines.join(places, "line_id").where(F.size("places") >= constant * F.size(tokens))
    shape = F.array_join(F.transform(tokens, lambda t, i: F.when(F.array_contains("places", i), t).otherwise(ANY)), " ")
    templates = checkpointed(shaped.select("leaf", "line_id", shape.alias("template")).withColumn("template_id", F.xxhash64("template")))
    seen = found.select("line_id", "th", "held").join(templates.select("leaf", "line_id", "template_id"), "line_id").select("leaf", "template_id", "th", "held").distinct()
    seen = checkpointed(seen)
    often = seen.groupBy("leaf", "template_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf", "template_id")
    if companies:
        spread = recurring_templates(seen, found.select("leaf", "th", "held", "total").distinct(), min_docs).withColumn("recurs", F.lit(True))
        often = often.join(spread, ["leaf", "template_id"], "left").withColumn("recurs", F.coalesce("recurs", F.lit(False)))
    else:
        often = often.withColumn("recurs", F.lit(True))
    return templates.join(often, ["leaf", "template_id"]).select("leaf", "line_id", "template", "recurs")


def with_line_drops(docs: DataFrame, min_docs: int = MIN_DOCS, constant: float = CONSTANT, companies: bool = True) -> DataFrame:
    """Every row with the lines of recurring templates taken out of text; adds n_lines, dropped_lines and repeated_lines (numbers from 0, ascending).

    repeated_lines are all lines whose template min_docs texts have, copied documents among them; dropped are those of them whose
    template is in min_docs companies, or all with companies=False.

    Lines end at line feeds; those that stay keep their bytes and order. Blank lines are never dropped. Null texts stay null,
    with no lines; empty texts have one. A column n_chars is set to the new length. Repeated rows and ties are each treated
    by their own text; equal texts lose equal lines."""
    found = checkpointed(occurrences(docs, common_leaves(docs, min_docs)))
    bad = checkpointed(recurring_lines(found, min_docs, constant, companies).select("line_id", "recurs"))  # so that the join sees its size and a line's skew
    hits = found.select("doc_id", "th", "at", "line_id").join(bad, "line_id").select("doc_id", "th", "at", "recurs")
    places = lambda c: F.array_sort(F.collect_set(c))
    drops = hits.groupBy(F.col("doc_id").alias("__dt_id"), F.col("th").alias("__dt_th")).agg(places(F.when(F.col("recurs"), F.col("at"))).alias("__dt_drops"), places("at").alias("__dt_repeats"))
    both = docs.drop(*ADDED).join(drops, docs["doc_id"].eqNullSafe(F.col("__dt_id")) & (F.xxhash64("text") == F.col("__dt_th")), "left")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(F.col("__dt_drops"), i)), "\n")
    text = F.when(F.coalesce(F.size("__dt_drops"), F.lit(0)) < 1, F.col("text")).otherwise(kept)
    made = [text.alias("text") if c == "text" else (F.length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c)) for c in docs.columns if c not in ADDED]
    return both.select(*made, F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), *[F.coalesce(c, F.array().cast("array<int>")).alias(name) for c, name in (("__dt_drops", "dropped_lines"), ("__dt_repeats", "repeated_lines"))])

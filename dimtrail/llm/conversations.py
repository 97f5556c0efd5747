"""Repair of conversation structure: the cheapest edits that give every conversation a legal order of roles.

Dynamic programming over a conversation's rows keeps the cheapest edits for each end of the pattern (s?(ua)+)?. Edits are a
persistent list: every prefix is a node that points to the one before, with ancestors at powers of two and a rolling hash, so
that equally dear edits are compared by a search for their longest common prefix; equal hashes are verified letter by letter.

Rows are sorted in ranges over all conversations. A conversation that lies in one range is streamed through once. One that
covers several is cut there: each part gives the cheapest edits from every start to every end of the pattern, parts are
chained, and its repaired rows are hashed as a stream. At most one conversation is cut at each border."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dimtrail.llm.common import checkpointed, utf8

KEEP, REROLE, DELETE, INSERT = "KRDI"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Where the pattern stands: nothing yet, after s, after u, after a; and whether it may end there.
EMPTY, AFTER_S, AFTER_U, AFTER_A = range(4)
ENDS = (EMPTY, AFTER_A)
KEEPS = {"s": ((EMPTY, AFTER_S),), "u": ((EMPTY, AFTER_U), (AFTER_S, AFTER_U), (AFTER_A, AFTER_U)), "a": ((AFTER_U, AFTER_A),)}
REROLES = ((EMPTY, AFTER_U, "user"), (AFTER_S, AFTER_U, "user"), (AFTER_A, AFTER_U, "user"), (AFTER_U, AFTER_A, "assistant"))
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
LEFT_TRUNCATED = 5
#: From any place of the pattern every continuation can be followed at this much more cost (two rows put in and one taken out), so dearer places can't win.
SLACK = 12

WHITE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}


class Prefixes:
    """Edit strings that share their beginnings; node 0 is the empty one."""

    def __init__(self, modulus: int = (1 << 61) - 1):
        self.modulus = modulus
        self.up: list[list[int]] = [[]]
        self.letter, self.depth, self.hash = [""], [0], [0]
        self.equal: dict[int, int] = {}

    def add(self, node: int, letter: str) -> int:
        up, k = [node], 0
        while k < len(self.up[up[-1]]):
            up.append(self.up[up[-1]][k])
            k += 1
        self.up.append(up)
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * 1000003 + ord(letter)) % self.modulus)
        return len(self.letter) - 1

    def extend(self, node: int, letters: str) -> int:
        for letter in letters:
            node = self.add(node, letter)
        return node

    def _same(self, node: int) -> int:
        while node in self.equal:
            node = self.equal[node]
        return node

    def _mismatch(self, x: int, y: int) -> tuple[int, int] | None:
        """The first place where two prefixes of one length differ; None, and remembered, if they don't."""
        found, walked = None, []
        while (a := self._same(x)) != (b := self._same(y)):
            if self.letter[x] != self.letter[y]:
                found = x, y
            walked.append((a, b))
            x, y = self.up[x][0], self.up[y][0]
        if found is None:
            self.equal.update((max(p), min(p)) for p in walked)
        return found

    def ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether a's string comes before b's."""
        least = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, least), self.ancestor(b, least)
        if self.hash[x] == self.hash[y]:
            found = self._mismatch(x, y)
            if found is None:
                return self.depth[a] < self.depth[b]
            x, y = found
        else:
            for k in range(len(self.up[x]) - 1, -1, -1):
                if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                    x, y = self.up[x][k], self.up[y][k]
            x, y = self._mismatch(self.up[x][0], self.up[y][0]) or (x, y)
        return self.letter[x] < self.letter[y]

    def text(self, node: int, above: int = 0) -> str:
        """The string of a node, from below one of its ancestors."""
        out = []
        while node != above:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def shared(self, nodes: Sequence[int]) -> int:
        """The deepest node that all nodes pass through."""
        low = nodes[0]
        for other in nodes[1:]:
            x, y = self.ancestor(low, self.depth[other]), self.ancestor(other, self.depth[low])
            while x != y:
                k = next((k for k in range(len(self.up[x]) - 1, 0, -1) if self.up[x][k] != self.up[y][k]), 0)
                x, y = self.up[x][k], self.up[y][k]
            low = x
        return low


class Repair:
    """Cheapest edits of the rows given so far, for each place of the pattern where they may leave it.

    hashed: also the hash of the repaired rows of each. What all of them begin with is written out from time to time, so memory doesn't grow with
    the rows; a place that is dearer than the cheapest by more than SLACK is given up where only the whole is asked for."""

    def __init__(self, start: int = EMPTY, hashed: bool = True, whole: bool = True, modulus: int = (1 << 61) - 1):
        self.prefixes, self.modulus, self.whole = Prefixes(modulus), modulus, whole
        self.at = {start: (0, 0, hashlib.sha256() if hashed else None)}
        self.written, self.limit = [], 4096

    def _put(self, made: dict, end: int, cost: int, start: tuple, letter: str, piece: str | None, first: bool) -> None:
        old = made.get(end)
        if old is not None and cost >= old[0]:
            if cost > old[0]:
                return
            if start[1] == old[1]:
                if letter >= old[2]:
                    return
            elif not self.prefixes.less(self.prefixes.extend(start[1], letter), self.prefixes.extend(old[1], old[2])):
                return
        made[end] = (cost, start[1], letter, start[2], piece, first)

    def _take(self, made: dict) -> dict:
        out = {}
        for end, (cost, node, letter, seen, piece, first) in made.items():
            if seen is not None and piece is not None:
                seen = seen.copy()
                seen.update(utf8(piece if first else "\n" + piece))
            out[end] = (cost, self.prefixes.extend(node, letter), seen)
        return out

    def _insert(self) -> None:
        """Rows put in before the next row."""
        for end, starts, piece in ((AFTER_U, (EMPTY, AFTER_S, AFTER_A), "user:"), (AFTER_A, (AFTER_U,), "assistant:")):
            made: dict = {}
            if end in self.at:
                cost, node, seen = self.at[end]
                made[end] = (cost, node, "", seen, None, False)
            for start in starts:
                if start in self.at:
                    self._put(made, end, self.at[start][0] + COSTS[INSERT], self.at[start], INSERT, piece, start == EMPTY)
            self.at |= self._take(made)

    def row(self, role: str, fault: int, text: str = "") -> None:
        self._insert()
        made: dict = {}
        extra = LEFT_TRUNCATED if fault == TRUNCATED else 0
        for place, (cost, node, seen) in self.at.items():
            self._put(made, place, cost + COSTS[DELETE], (cost, node, seen), DELETE, None, False)
        if fault not in (BLANK, DUPLICATE):
            for start, end in KEEPS.get(role[:1], ()):
                if start in self.at:
                    self._put(made, end, self.at[start][0] + COSTS[KEEP] + extra, self.at[start], KEEP, f"{role}:{text}", start == EMPTY)
            for start, end, other in REROLES:
                if start in self.at:
                    self._put(made, end, self.at[start][0] + COSTS[REROLE] + extra, self.at[start], REROLE, f"{other}:{text}", start == EMPTY)
        self.at = self._take(made)
        if self.whole:
            least = min(c for c, _, _ in self.at.values())
            self.at = {p: v for p, v in self.at.items() if v[0] <= least + SLACK}
        if len(self.prefixes.letter) > self.limit:
            self._compact()

    def _compact(self) -> None:
        old, new = self.prefixes, Prefixes(self.modulus)
        low = old.shared([n for _, n, _ in self.at.values()])
        self.written.append(old.text(low))
        self.at = {p: (c, new.extend(0, old.text(n, low)), s) for p, (c, n, s) in self.at.items()}
        self.prefixes, self.limit = new, max(4096, 4 * len(new.letter))

    def finish(self) -> tuple[int, str, str]:
        """Cost, edits and hash (empty if not asked for) of the cheapest legal whole."""
        self._insert()
        best = None
        for place in ENDS:
            if place in self.at:
                here = self.at[place]
                if best is None or here[0] < best[0] or here[0] == best[0] and self.prefixes.less(here[1], best[1]):
                    best = here
        return best[0], "".join(self.written) + self.prefixes.text(best[1]), best[2].hexdigest() if best[2] is not None else ""

    def edits(self) -> dict[int, tuple[int, str]]:
        """Cost and edits for every place where the rows may leave the pattern."""
        return {p: (c, "".join(self.written) + self.prefixes.text(n)) for p, (c, n, _) in self.at.items()}


class Counts:
    """Faults and gaps of a run of rows in order."""

    def __init__(self):
        self.faults, self.illegal, self.turns = [0] * 4, 0, 0
        self.first = self.last = self.low = self.high = None

    def row(self, initial: str, fault: int, turn: int | None) -> None:
        self.faults[fault] += 1
        self.illegal += self.last is not None and self.last + initial not in LEGAL
        self.first = initial if self.first is None else self.first
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def join(self, faults: Sequence[int], illegal: int, first: str, last: str, turns: int, low: int | None, high: int | None) -> None:
        """Adds the next part's counts."""
        self.faults = [a + b for a, b in zip(self.faults, faults, strict=True)]
        self.illegal += illegal + (self.last is not None and self.last + first not in LEGAL)
        self.first, self.last = first if self.first is None else self.first, last
        self.turns += turns - (low is not None and low == self.high)
        self.low = low if self.low is None else self.low
        self.high = self.high if high is None else high

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage that the checksum of `conv_id:turn` chooses: a row in twenty each is dropped, emptied, loses its [.!?], comes twice, or is the user's.

    Null roles and texts are one space, as nulls are in the checksum; turns stay null. Equal rows are damaged alike."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), how.alias("how")).where("how != 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    twice = F.explode(F.array_repeat(F.lit(0), F.when(F.col("how") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), twice.alias("__dt_0")).drop("__dt_0")


def _stream(df: DataFrame, schema: str, start, batch: int = 1024) -> DataFrame:
    """Rows that `start()`, once a task, makes: a function from a row (None at the end) to rows."""
    kind = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, held, size = start(), [], 0

        def rows():
            for got in batches:
                for k in range(0, got.num_rows, 256):
                    columns = [c.to_pylist() for c in got.slice(k, 256).columns]
                    yield from zip(*columns, strict=True)
            yield None

        for row in rows():
            for made in step(row):
                held.append(made)
                size += sum(len(v) for v in made if isinstance(v, str))
                if len(held) >= batch or size > 1 << 22:
                    yield table(held)
                    held, size = [], 0
        if held:
            yield table(held)

    return df.mapInArrow(run, kind)


def in_order(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """conv_id, turn, role, text, fault (blank or truncated), part and place: rows in order of conversation and turn (nulls first, then role and the
    text's digest), in sorted ranges that may cut a conversation, however many of all rows it has."""
    last = F.right(F.rtrim(F.col("text"), F.lit(WHITE)), F.lit(1))
    fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    keys = ["conv_id", "turn", "role", "digest", "__dt_tie"]
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", fault.cast("int").alias("fault"), F.unhex(F.md5("text")).alias("digest"))
    rows = rows.withColumn("__dt_tie", F.monotonically_increasing_id())
    ranges = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    dealt = checkpointed(ranges.sortWithinPartitions(*keys).drop("__dt_tie"))
    return dealt.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id())


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _whole(rows: DataFrame, conv_type: str) -> DataFrame:
    """Results of conversations none of which is cut."""

    def start():
        now, counts, repair, seen = None, None, None, set()

        def step(row):
            nonlocal now, counts, repair, seen
            if counts is not None and (row is None or row[0] != now):
                cost, audit, digest = repair.finish()
                yield now, counts.gaps, *counts.faults[1:], counts.illegal, cost, audit, digest
                counts = None
            if row is None:
                return
            conv, turn, role, text, fault = row
            if counts is None:
                now, counts, repair, seen = conv, Counts(), Repair(), set()
            if fault != BLANK:
                mark = hashlib.blake2b(utf8(f"{len(role)}:{role}{text}"), digest_size=16).digest()
                fault = DUPLICATE if mark in seen else fault
                seen.add(mark)
            counts.row(role[:1], fault, turn)
            repair.row(role, fault, text)

        return step

    return _stream(rows.select("conv_id", "turn", "role", "text", "fault"), f"conv_id {conv_type}, {RESULT}", start)


EDITS = "array<struct<start:int,end:int,cost:bigint,edits:string>>"


def _parts(rows: DataFrame, conv_type: str) -> DataFrame:
    """For each part of a cut conversation its counts and the cheapest edits from every start to every end of the pattern.

    A row is a duplicate if its role and text stand at an earlier place; first places are found by digest over all parts, combined before the
    shuffle. Texts stay where they are."""
    mark = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    slim = rows.select("conv_id", "part", "place", "turn", F.left("role", F.lit(1)).alias("initial"), "fault", mark.alias("mark"))
    first = slim.groupBy(F.col("conv_id").alias("__dt_c"), F.col("mark").alias("__dt_m")).agg(F.min("place").alias("first"))
    slim = slim.join(first, F.col("conv_id").eqNullSafe(F.col("__dt_c")) & (F.col("mark") == F.col("__dt_m")))
    fault = F.when(F.col("fault") == BLANK, BLANK).when(F.col("place") > F.col("first"), DUPLICATE).otherwise(F.col("fault"))
    slim = slim.select("conv_id", "part", "place", "turn", "initial", fault.alias("fault")).repartition("part").sortWithinPartitions("place")

    def start():
        now, counts, repairs = None, None, None

        def step(row):
            nonlocal now, counts, repairs
            if counts is not None and (row is None or row[:2] != now):
                found = [{"start": s, "end": e, "cost": c, "edits": t} for s, r in enumerate(repairs) for e, (c, t) in r.edits().items()]
                yield *now, counts.faults, counts.illegal, counts.first, counts.last, counts.turns, counts.low, counts.high, found
                counts = None
            if row is None:
                return
            conv, part, _, turn, initial, fault = row
            if counts is None:
                now, counts, repairs = (conv, part), Counts(), [Repair(s, hashed=False, whole=False) for s in range(4)]
            counts.row(initial, fault, turn)
            for r in repairs:
                r.row(initial, fault)

        return step

    return _stream(slim, f"conv_id {conv_type}, part int, faults array<bigint>, illegal bigint, first string, last string, turns bigint, low bigint, high bigint, found {EDITS}", start)


class Chain:
    """Parts of one conversation in order: counts, and the cheapest edits through all of them."""

    def __init__(self):
        self.counts, self.prefixes = Counts(), Prefixes()
        self.at = {EMPTY: (0, 0, None)}  # cost, edits, (what came before, part, start, edits of the part)

    def part(self, part: int, found: list[dict]) -> None:
        made: dict = {}
        for f in found:
            if f["start"] not in self.at:
                continue
            cost, node, before = self.at[f["start"]]
            cost += f["cost"]
            old = made.get(f["end"])
            if old is None or cost < old[0] or cost == old[0] and self.prefixes.less(self.prefixes.extend(node, f["edits"]), self.prefixes.extend(old[1], old[2]["edits"])):
                made[f["end"]] = (cost, node, f, before)
        least = min(c for c, *_ in made.values())
        self.at = {e: (c, self.prefixes.extend(n, f["edits"]), (b, part, f["start"], f["edits"])) for e, (c, n, f, b) in made.items() if c <= least + SLACK}

    def finish(self) -> tuple[int, str, list[tuple[int, int, str]]]:
        """Cost, edits, and (part, start, edits) of every part."""
        ends = {}
        for place, tail in ((EMPTY, ""), (AFTER_A, ""), (AFTER_U, "I"), (AFTER_S, "II"), (EMPTY, "II")):
            if place in self.at:
                cost, node, path = self.at[place]
                ends[place, tail] = (cost + COSTS[INSERT] * len(tail), self.prefixes.extend(node, tail), path)
        best = None
        for (_, tail), here in ends.items():
            if best is None or here[0] < best[0] or here[0] == best[0] and self.prefixes.less(here[1], best[1]):
                best = (*here, tail)
        slices, path, tail = [], best[2], best[3]
        while path is not None:
            path, part, start, edits = path
            slices.append((part, start, edits + tail))
            tail = ""
        return best[0], self.prefixes.text(best[1]), slices[::-1]


def _chained(parts: DataFrame, conv_type: str) -> DataFrame:
    """Results of cut conversations without their hash, and `slices`: the edits of every part."""

    def start():
        now, chain = None, None

        def step(row):
            nonlocal now, chain
            if chain is not None and (row is None or row[0] != now):
                cost, audit, slices = chain.finish()
                c = chain.counts
                yield now, c.gaps, *c.faults[1:], c.illegal, cost, audit, [{"part": p, "start": s, "edits": e} for p, s, e in slices]
                chain = None
            if row is None:
                return
            if chain is None:
                now, chain = row[0], Chain()
            chain.counts.join(*row[2:9])
            chain.part(row[1], row[9])

        return step

    schema = f"conv_id {conv_type}, {RESULT.rpartition(',')[0]}, slices array<struct<part:int,start:int,edits:string>>"
    return _stream(parts.repartition("conv_id").sortWithinPartitions("conv_id", "part"), schema, start, 16)


def repaired_rows(rows: DataFrame, slices: DataFrame) -> DataFrame:
    """conv_id, part, k, role, text of the repaired conversations, in order of part and k.

    rows: of in_order; slices: conv_id, part, start (place of the pattern), edits. A part's edits stand before its rows in one sorted stream."""
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    edits = slices.select("conv_id", "part", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("role"), F.col("edits").alias("text"), F.col("start").cast("int").alias("fault"))
    both = rows.select("conv_id", "part", "place", "role", "text", "fault").unionByName(edits)

    def start():
        edits, at, state, k = "", 0, EMPTY, 0

        def put(conv, part):
            nonlocal at, state, k
            while at < len(edits) and edits[at] == INSERT:
                role = "assistant" if state == AFTER_U else "user"
                state = AFTER_A if state == AFTER_U else AFTER_U
                yield conv, part, k, role, ""
                at, k = at + 1, k + 1

        now = None

        def step(row):
            nonlocal edits, at, state, k, now
            if now is not None and (row is None or row[2] < 0):
                yield from put(*now)
            if row is None:
                return
            conv, part, place, role, text, fault = row
            if place < 0:
                now, edits, at, state, k = (conv, part), text, 0, fault, 0
                return
            yield from put(conv, part)
            letter = edits[at]
            at += 1
            if letter == DELETE:
                return
            if letter == REROLE:
                role = "assistant" if state == AFTER_U else "user"
            state = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}[role[0]]
            yield conv, part, k, role, text
            k += 1

        return step

    dealt = both.repartition("part", "conv_id").sortWithinPartitions("part", "conv_id", "place")
    return _stream(dealt, f"conv_id {conv_type}, part int, k bigint, role string, text string", start)


def _hashes(repaired: DataFrame, conv_type: str) -> DataFrame:
    """SHA-256 of each conversation's repaired rows, read in order as a stream; nothing of it is held."""

    def start():
        now, seen, some = None, None, False

        def step(row):
            nonlocal now, seen, some
            if some and (row is None or row[0] != now):
                yield now, seen.hexdigest()
                some = False
            if row is None:
                return
            piece = f"{row[1]}:{row[2]}"
            if not some:
                now, seen, some = row[0], hashlib.sha256(utf8(piece)), True
            else:
                seen.update(utf8("\n" + piece))

        return step

    dealt = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "part", "k").select("conv_id", "role", "text")
    return _stream(dealt, f"conv_id {conv_type}, sha string", start)


def audits(conversations: DataFrame, parts: int | None = None) -> DataFrame:
    """For every conversation of (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Null roles and texts are one space; a null conv_id is a conversation; null turns come first and make no gap; a role without a first letter is no
    legal one. Repeated rows are duplicates. Rows of one turn come by role and the text's digest. An empty table gives no rows; other columns are left out.
    parts: ranges to sort into."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = in_order(conversations.select("conv_id", "turn", space("role"), space("text")), parts)
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    spans = rows.groupBy("conv_id").agg(F.min("part").alias("a"), F.max("part").alias("b"))
    cut = checkpointed(spans.where("a < b").select(F.col("conv_id").alias("__dt_cut")))  # at most one for each border of ranges
    if cut.isEmpty():
        return _whole(rows, conv_type)
    in_cut = F.col("conv_id").eqNullSafe(F.col("__dt_cut"))
    whole = _whole(rows.join(F.broadcast(cut), in_cut, "left_anti"), conv_type)
    mine = rows.join(F.broadcast(cut), in_cut, "left_semi")
    chained = checkpointed(_chained(_parts(mine, conv_type), conv_type))
    repaired = repaired_rows(mine, chained.select("conv_id", F.inline("slices")))
    hashes = _hashes(repaired, conv_type).withColumnRenamed("conv_id", "__dt_c")
    joined = chained.drop("slices").join(hashes, F.col("conv_id").eqNullSafe(F.col("__dt_c")), "left").drop("__dt_c")
    return whole.unionByName(joined.withColumn("repaired_sha256", F.coalesce("sha", F.sha2(F.lit(""), 256))).drop("sha"))


def audits_of_all(conversations: DataFrame, rows: DataFrame, parts: int | None = None) -> DataFrame:
    """audits() of rows made from conversations, with zeros, no edits and the hash of nothing for conversations that have no row left."""
    ids = conversations.select(F.col("conv_id").alias("__dt_id")).distinct()
    found = ids.join(audits(rows, parts), F.col("__dt_id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("__dt_id", "conv_id")
    numbers = [c for c in found.columns if c not in ("conv_id", "audit", "repaired_sha256")]
    return found.na.fill(0, numbers).withColumn("audit", F.coalesce("audit", F.lit(""))).withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))

"""Secrets in text: fixed patterns, and a linear-chain conditional random field that adds what they miss.

The field tags words and single marks as begin, inside or outside of a secret. It sees each token's shape (length, kinds of
characters, changes between them), the words and shapes around it, whether space stands before it, and how much of the whole text
is digits and marks. It is trained on passages of a sample of the table: secrets that the patterns find there, the same with
other values and without their key word, and passages without any. Decoding is Viterbi over whole texts, many blocks of tokens
side by side."""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimtrail.llm.common import append_columns, utf8

#: Documents whose passages the field is trained on, at most about; chosen by hash.
SAMPLE_ROWS = 8000
#: Characters of a passage on either side, rounds of training, and the share of all weights that a round takes away.
AROUND, ROUNDS, RIDGE = 120, 50, 1e-6
TABLE_BITS = 15
#: Characters that are cut into tokens at once; tokens that are scored at once.
PIECE, SCORED = 1 << 21, 1 << 17

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")

OUT, BEGIN, IN = range(3)
NEVER = np.float32(-1e4)

FIELDS = [
    T.StructField("n_assign", T.LongType()),
    T.StructField("n_access", T.LongType()),
    T.StructField("n_hex", T.LongType()),
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' whole matches, by start and kind. Runs of too few characters can't hold a longer match, so two patterns ask for the length at once."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def shown(spans: Sequence[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# --- tokens and features

#: Kinds of characters: white has no bit. NO_HEX stands beside the kind of a letter that is no small hexadecimal digit.
LOWER, UPPER, DIGIT, BEYOND, NO_HEX, MARK = (1 << k for k in range(6))
LETTERED = LOWER | UPPER | DIGIT | BEYOND


def _kinds() -> np.ndarray:
    kinds = np.full(129, MARK, np.uint8)
    for chars, kind in ((string.ascii_lowercase, LOWER | NO_HEX), ("abcdef", LOWER), (string.ascii_uppercase, UPPER | NO_HEX), (string.digits, DIGIT), (map(chr, [*range(33), 127]), 0), (chr(128), BEYOND | NO_HEX)):
        kinds[[ord(c) for c in chars]] = kind
    return kinds


KIND = _kinds()
#: Weights of a letter by its place in the token; letters from the 64th on weigh alike.
_WEIGHT = np.cumprod(np.full(64, 1099511628211, np.uint64))


@dataclass
class Tokens:
    """Tokens of texts one after another: place and end in the text, hash of the lower-case letters, shape, mix of kinds, whether space stands before; of which text; and a feature of each text."""

    start: np.ndarray
    end: np.ndarray
    word: np.ndarray
    shape: np.ndarray
    mix: np.ndarray
    glued: np.ndarray
    text: np.ndarray
    file: np.ndarray


def _piece(codes: np.ndarray, before: bool) -> list[np.ndarray]:
    """Start, end, word, shape, mix, glued of the tokens of some characters; before: whether the first follows on a token."""
    kind = KIND[np.minimum(codes, 128)]
    lettered = (kind & LETTERED) != 0
    inner = np.zeros(len(kind), bool)  # a letter after a letter
    np.logical_and(lettered[1:], lettered[:-1], out=inner[1:])
    start = np.flatnonzero((kind != 0) & ~inner)
    if not len(start):
        return [np.zeros(0, t) for t in (np.int64, np.int64, np.uint32, np.uint32, np.uint32, bool)]
    ends = lettered.copy()
    ends[:-1] &= ~inner[1:]
    end = np.flatnonzero(ends | (kind == MARK)) + 1
    place = np.arange(len(codes)) - np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(codes)]])))
    low = codes.astype(np.uint64) + np.uint64(1)
    low[(kind & UPPER) != 0] += np.uint64(32)
    low[kind == 0] = 0
    word = np.add.reduceat(low * _WEIGHT[np.minimum(place, 63)], start)
    word = ((word ^ (word >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.uint32)
    mix = np.bitwise_or.reduceat(kind, start).astype(np.uint32)
    change = np.zeros(len(kind), np.int32)
    np.not_equal(kind[1:] & LETTERED, kind[:-1] & LETTERED, out=change[1:], casting="unsafe")
    change *= inner
    lengths = LENGTH[np.minimum(end - start, len(LENGTH) - 1)]
    changes = CHANGE[np.minimum(np.add.reduceat(change, start), len(CHANGE) - 1)]
    shape = np.where(mix == MARK, word, mix | lengths << np.uint32(6) | changes << np.uint32(10))
    glued = kind[start - 1] != 0
    if start[0] == 0:
        glued[0] = before
    return [start, end, word, shape, mix, glued]


#: Classes of lengths and of changes between kinds, by their number.
LENGTH = np.searchsorted([2, 3, 5, 8, 12, 16, 20, 24, 32, 41, 65], np.arange(66), side="right").astype(np.uint32)
CHANGE = np.searchsorted([1, 2, 3, 5, 8, 13], np.arange(14), side="right").astype(np.uint32)


def tokens_of(texts: Sequence[str]) -> Tokens:
    """Tokens of the texts. They are read as one, with a line's end between them, and cut into pieces at the ends of words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    heads = np.concatenate([[0], np.cumsum(sizes + 1)])
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    parts, at = [_piece(codes[:0], False)], 0
    while at < len(codes):
        stop = min(at + PIECE, len(codes))
        while stop < len(codes) and KIND[min(codes[stop], 128)] & LETTERED:
            stop += 1
        made = _piece(codes[at:stop], at > 0 and bool(KIND[min(codes[at - 1], 128)]))
        made[0] += at
        made[1] += at
        parts.append(made)
        at = stop
    start, end, word, shape, mix, glued = (np.concatenate(c) for c in zip(*parts, strict=True))
    text = np.searchsorted(heads, start, side="right").astype(np.int32) - 1
    marks = np.bincount(text[mix == MARK], minlength=len(texts))
    numbers = np.bincount(text, ((mix & DIGIT) != 0) * (end - start), minlength=len(texts))
    size = np.maximum(sizes, 1)
    file = np.searchsorted([0.001, 0.01, 0.05, 0.2], numbers / size) * 8 + np.searchsorted([0.01, 0.03, 0.06, 0.12, 0.25], marks / size)
    return Tokens(start - heads[text], end - heads[text], word, shape, mix, glued, text, file.astype(np.uint32))


def features(tokens: Tokens, lo: int, hi: int) -> list[np.ndarray]:
    """Places in the weight table, an array for each kind of feature, of tokens lo to hi; neighbours are of the same text."""
    if hi <= lo:
        return [np.zeros(0, np.intp)] * N_FEATURES
    ways = {}
    for by in (-3, -2, -1, 1):
        at = np.arange(lo + by, hi + by)
        np.clip(at, 0, len(tokens.text) - 1, out=at)
        ways[by] = at, (tokens.text[at] == tokens.text[lo:hi]).astype(np.uint32)
    ways[-1][1][: 1 if lo == 0 else 0] = ways[-2][1][: max(0, 2 - lo)] = ways[-3][1][: max(0, 3 - lo)] = 0
    if hi == len(tokens.text):
        ways[1][1][-1] = 0
    near = lambda column, by: column[ways[by][0]] * ways[by][1]
    shape, mix, glued, word = tokens.shape[lo:hi], tokens.mix[lo:hi], tokens.glued[lo:hi].astype(np.uint32), tokens.word[lo:hi]
    before, two, shape_before = near(tokens.word, -1), near(tokens.word, -2), near(tokens.shape, -1)
    columns = [
        shape,
        shape * 2 + glued,
        np.where(tokens.end[lo:hi] - tokens.start[lo:hi] <= 12, word, shape | 1 << 14),
        before,
        two,
        near(tokens.word, -3),
        near(tokens.word, 1),
        shape_before,
        near(tokens.shape, 1),
        shape_before * 31 + shape,
        before * 31 + mix,
        two * 31 + shape,
        tokens.file[tokens.text[lo:hi]] * 64 + mix,
        near(tokens.mix, -1) * 4096 + mix * 2 + glued,
    ]
    return [((c * np.uint32(2654435761) + np.uint32((k * 40503 + 1) * 2246822519 % 2**32)) >> np.uint32(32 - TABLE_BITS)).astype(np.intp) for k, c in enumerate(columns)]


N_FEATURES = 14


# --- the field


@dataclass
class Field:
    """weights: for out, begin and in a row of the table's places; moves: from a tag to the next; starts: the first tag."""

    weights: np.ndarray
    moves: np.ndarray
    starts: np.ndarray

    def scores(self, tokens: Tokens) -> np.ndarray:
        """A row for each tag."""
        out = np.zeros((3, len(tokens.start)), np.float32)
        for lo in range(0, out.shape[1], SCORED):
            hi = min(lo + SCORED, out.shape[1])
            for places in features(tokens, lo, hi):
                for tag in range(3):
                    out[tag, lo:hi] += self.weights[tag].take(places)
        return out


ALLOWED = np.array([[0, 0, NEVER], [0, 0, 0], [0, 0, 0]], np.float32)
FIRST = np.array([0, 0, NEVER], np.float32)


def viterbi(scores: np.ndarray, moves: np.ndarray, starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best tags of a chain of tokens (scores: a row for each tag); `first` marks those that begin a text.

    The chain is cut into blocks. The best way through a block is found for every tag before it, all blocks side by side; then blocks are
    chained, and tags are read back the same way. Of equally good ways the one with the lower tags before stands."""
    n = scores.shape[1]
    if n == 0:
        return np.zeros(0, np.uint8)
    length = int(max(1, np.sqrt(n)))
    blocks = -(-n // length)
    padded = np.zeros((3, blocks * length), np.float32)
    padded[:, :n] = scores
    padded[1:, n:] = NEVER
    heads = np.ones(blocks * length, np.float32)  # what fills the last block begins anew, so that it favours no tag before it
    heads[:n] = first
    heads[0] = 1
    padded = np.ascontiguousarray(padded.reshape(3, blocks, length).transpose(2, 0, 1))  # place, tag, block
    heads = np.ascontiguousarray(heads.reshape(blocks, length).T)
    free, begun = moves + ALLOWED, starts + FIRST
    more = (begun[None] - free)[:, :, None]  # what the beginning of a text changes
    best = np.where(np.eye(3, dtype=bool), np.float32(0), 4 * NEVER)[:, :, None].repeat(blocks, 2)  # tag before the block, tag now, block
    back = np.empty((length, 3, 3, blocks), np.uint8)
    for t in range(length):
        steps = free[:, :, None] + more * heads[t] if heads[t].any() else free[:, :, None]
        ways = [best[:, q, None] + steps[q] for q in range(3)]
        best = np.maximum(ways[0], ways[1])
        np.greater(ways[1], ways[0], out=back[t], casting="unsafe")
        later = ways[2] > best
        back[t][later] = 2
        best = np.where(later, ways[2], best) + padded[t]
    before, through = np.array([0, NEVER, NEVER], np.float32), np.empty((3, blocks), np.uint8)
    ends = np.ascontiguousarray(best.transpose(2, 0, 1))
    for b in range(blocks):
        ways = before[:, None] + ends[b]
        through[:, b] = ways.argmax(axis=0)
        before = ways.max(axis=0)
        before -= before.max()
    last = int(before.argmax())
    entry, leave = np.empty(blocks, np.uint8), np.empty(blocks, np.uint8)
    for b in range(blocks - 1, -1, -1):
        leave[b], entry[b] = last, through[last, b]
        last = int(entry[b])
    tags, now, rows = np.empty((blocks, length), np.uint8), leave, np.arange(blocks)
    for t in range(length - 1, -1, -1):
        tags[:, t] = now
        now = back[t, entry, now, rows]
    return tags.reshape(-1)[:n]


def tagged_spans(texts: Sequence[str], field: Field) -> list[list[tuple[int, int]]]:
    """Spans that the field finds in every text."""
    tokens = tokens_of(texts)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    first = np.concatenate([[True], tokens.text[1:] != tokens.text[:-1]]) if len(tokens.text) else np.zeros(0, bool)
    tags = viterbi(field.scores(tokens), field.moves, field.starts, first)
    begins = np.flatnonzero(tags == BEGIN)
    if len(begins):
        outside = np.flatnonzero((tags != IN) | first)
        ends = outside[np.minimum(np.searchsorted(outside, begins, side="right"), len(outside) - 1)]
        for b, e in zip(begins, np.where(ends > begins, ends, len(tags)), strict=True):
            out[tokens.text[b]].append((int(tokens.start[b]), int(tokens.end[e - 1])))
    return out


# --- training


def chances(scores: np.ndarray, moves: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of every tag (place, tag, passage), and expected numbers of pairs of tags, by scaled forward and backward products.

    scores: place, tag, passage; places from a passage's size on don't count."""
    length = len(scores)
    step = np.exp(moves + ALLOWED)
    likely = np.exp(scores - scores.max(axis=1, keepdims=True))
    forward, backward = np.empty_like(scores), np.ones_like(scores)
    now = np.exp(starts + FIRST)[:, None] * likely[0]
    for t in range(length):
        now = np.where(t < sizes, step.T @ now * likely[t], now) if t else now
        now = now / now.sum(axis=0)
        forward[t] = now
    double = np.zeros((3, 3), np.float32)
    for t in range(length - 2, -1, -1):
        after = likely[t + 1] * backward[t + 1]
        now = step @ after
        inside = t + 1 < sizes
        double += (forward[t] * (inside / (forward[t] * now).sum(axis=0))) @ after.T
        backward[t] = np.where(inside, now / now.sum(axis=0), 1)
    single = forward * backward
    return single / single.sum(axis=1, keepdims=True), double * step


def train(passages: Sequence[tuple[str, Sequence[tuple[int, int]]]], files: Sequence[int], rounds: int = ROUNDS) -> Field:
    """A field fitted on passages with the spans of their secrets; files: the file feature of the text each is from."""
    tokens = tokens_of([t for t, _ in passages])
    tokens.file = np.array(files, np.uint32)
    sizes = np.bincount(tokens.text, minlength=len(passages))
    heads = np.concatenate([[0], np.cumsum(sizes)])
    tags = np.zeros(len(tokens.start), np.uint8)
    for k, (_, spans) in enumerate(passages):
        own = slice(heads[k], heads[k + 1])
        for s, e in spans:
            held = np.flatnonzero((tokens.start[own] < e) & (tokens.end[own] > s)) + heads[k]
            tags[held], tags[held[:1]] = IN, BEGIN
    place = np.arange(len(tags)) - heads[tokens.text]
    made = np.stack(features(tokens, 0, len(tags)))
    weights, moves, starts = np.zeros((3, 1 << TABLE_BITS), np.float32), np.zeros((3, 3), np.float32), np.zeros(3, np.float32)
    truth = np.eye(3, dtype=np.float32)[tags].T
    pairs = np.zeros((3, 3), np.float32)
    follows = np.flatnonzero(place[1:] > 0)
    np.add.at(pairs, (tags[follows], tags[follows + 1]), 1)
    begun = truth[:, place == 0].sum(axis=1)
    scores = np.zeros((int(sizes.max()), 3, len(passages)), np.float32)
    state = [np.full_like(x, 1e-3) for x in (weights, moves, starts)]
    for _ in range(rounds):
        for tag in range(3):
            scores[place, tag, tokens.text] = weights[tag].take(made).sum(axis=0)
        single, double = chances(scores, moves, starts, sizes)
        slope = np.empty_like(weights)
        for tag in range(3):
            miss = truth[tag] - single[place, tag, tokens.text]
            slope[tag] = np.bincount(made.ravel(), np.tile(miss, len(made)), 1 << TABLE_BITS)
        slopes = slope / len(passages) - RIDGE * weights, (pairs - double) / len(passages), (begun - single[0][:, sizes > 0].sum(axis=1)) / len(passages)
        for x, g, s in zip((weights, moves, starts), slopes, state, strict=True):
            s += g.astype(np.float32) ** 2
            x += 0.3 * g.astype(np.float32) / np.sqrt(s)
    return Field(weights, moves, starts)


VALUES = (string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", string.ascii_letters + string.digits + "!#$%&*@^")


def _value(rng: random.Random) -> str:
    """A made secret: random characters of some alphabet, at times behind a short prefix, with both letters and digits."""
    while True:
        body = "".join(rng.choices(rng.choice(VALUES), k=rng.choice((16, 20, 24, 32, 36, 40, 48, 64))))
        if sum(c.isdigit() for c in body) >= 2 and sum(c.isalpha() for c in body) >= 2:
            return rng.choice(("", "", "", "AKIA", "sk-", "pk_", "gh_", "eyJ")) + body


def _plain(rng: random.Random, words: list[str]) -> str:
    """Something that looks long or odd and is no secret: numbers, joined words, addresses, dates, names with a number."""
    some = [rng.choice(words) for _ in range(4)]
    digits = "".join(rng.choices(string.digits, k=rng.choice((4, 8, 10, 13, 16, 20))))
    return rng.choice((digits, "".join(some), "-".join(some), "_".join(some).upper(), "".join(w.capitalize() for w in some), f"{some[0]}{digits[:2]}@{some[1]}{digits[2]}.com", f"https://{some[0]}.org/{some[1]}/{digits[:4]}", f"{digits[:3]}.{digits[1:3]}.{digits[:2]}.1", f"2024-0{digits[0]}-1{digits[1]}T1{digits[2]}:00:00Z", f"{some[0]}{digits[:3]}", f"v{digits[0]}.{digits[1]}.{digits[2]}", f"+1 ({digits[:3]}) 555-{digits[:4]}"))


def lessons(windows: Sequence[tuple[str, int, int, int]], seed: int = 7) -> tuple[list, list]:
    """Passages with the spans of their secrets, and file features, from (text, start, end, file); start < 0: a passage without any.

    A secret also comes with another value and without what stands before it; a passage without any also gets a made secret, or something odd that is none."""
    rng, out, files = random.Random(seed), [], []

    def add(text, spans, file):
        out.append((text, spans))
        files.append(file)

    for text, s, e, file in windows:
        if s >= 0:
            add(text, [(s, e)], file)
            value = _value(rng)
            add(text[:s] + value + text[e:], [(s, s + len(value))], file)
            head = re.sub(r"\S+\s*[:=]?\s*[\"']?$", "", text[:s])
            value = rng.choice((text[s:e], _value(rng)))
            add(head + value + " " + text[e:].lstrip("\"'"), [(len(head), len(head) + len(value))], file)
            continue
        add(text, [], file)
        gaps = [m.end() for m in re.finditer(r"\s", text)] or [len(text)]
        words = re.findall(r"[^\W\d_]{2,}", text) or ["word"]
        for kind in range(2):
            at = rng.choice(gaps)
            value = _plain(rng, words) if kind else _value(rng)
            lead = rng.choice(("", "", "key=", "auth: ", 'token = "', "password: ", "Bearer ", "secret=", "id "))
            if kind and lead:
                lead = rng.choice(("id ", "see ", "no. ", "name: ", "date = ", "(", '"'))
            add(text[:at] + lead + value + " " + text[at:], [] if kind else [(at + len(lead), at + len(lead) + len(value))], file)
    return out, files


def _window(text: str, s: int, e: int) -> tuple[str, int, int]:
    """The passage around a span that isn't too long, begun and ended at white space."""
    e = min(e, s + 200)
    lo, hi = max(0, s - AROUND), min(len(text), e + AROUND)
    while 0 < lo < s and not text[lo - 1].isspace():
        lo += 1
    while e < hi < len(text) and not text[hi].isspace():
        hi -= 1
    return text[lo:hi], s - lo, e - lo


def windows_of(text: str | None, mark: int) -> list[dict]:
    """Passages of a document for training: the values of up to four secrets, and in one document of six a passage without any."""
    if not text:
        return []
    out, file = [], int(tokens_of([text]).file[0])
    found = base_spans(text)
    for s, kind, e in [x for x in found if x[1] < 2 or not any(a <= x[0] < b for a, k, b in found if k < 2)][:4]:
        if kind == 0:
            s = ASSIGN.match(text, s).start(2)
        cut, a, b = _window(text, s, e)
        if b <= len(cut) and len(base_spans(cut)) <= 2:
            out.append({"text": cut, "s": a, "e": b, "file": file})
    if mark % 6 == 0:
        at = mark // 6 % len(text)
        cut, _, _ = _window(text, at, at)
        if cut.strip() and not base_spans(cut):
            out.append({"text": cut, "s": -1, "e": -1, "file": file})
    return out


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Field | None:
    """A field trained on passages of about sample_rows documents, chosen by hash of id and text; None for a table without text.

    Rows repeated often count once. Where the sample has no secret, made ones are put into its passages all the same."""
    rows = docs.count()
    if not rows:
        return None
    share = min(1.0, sample_rows / rows)
    mark = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    chosen = docs.select("text", mark.alias("__dt_mark")).where(F.col("__dt_mark") < int(share * (1 << 40))).where("text is not null")
    window = T.StructType([T.StructField("text", T.StringType()), T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType()), T.StructField("file", T.IntegerType())])
    make = lambda: lambda texts, marks: [[windows_of(t, m) for t, m in zip(texts, marks, strict=True)]]
    cut = append_columns(chosen, [T.StructField("windows", T.ArrayType(window))], make, also=["__dt_mark"]).where("size(windows) > 0")
    sample = cut.dropDuplicates(["__dt_mark"]).select("__dt_mark", "windows").collect()  # at most about sample_rows rows of five passages
    sample.sort(key=lambda r: r[0])
    windows = [(w.text, w.s, w.e, w.file) for r in sample for w in r.windows]
    if not windows:
        return None
    return train(*lessons(windows))


def with_secrets(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Adds n_assign, n_access, n_hex, base_sha256 (of the patterns' spans) and spans (those and the field's, kind:start:end in code points) to every row.

    The field is fitted on the table unless given. Its spans are added where they don't meet one of the patterns'. Null and empty texts have no spans; equal
    texts have equal ones; other columns stay as they are."""
    field = field or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(None if field is None else (field.weights, field.moves, field.starts))

    def make():
        known = shared.value and Field(*shared.value)

        def compute(texts):
            texts = [t or "" for t in texts]
            added = tagged_spans(texts, known) if known else [[] for _ in texts]
            rows = []
            for text, more in zip(texts, added, strict=True):
                base = base_spans(text)
                ends, reach = [], 0
                for _, _, e in base:
                    reach = max(reach, e)
                    ends.append(reach)
                starts = np.array([s for s, _, _ in base])
                clear = []
                for s, e in more:
                    k = int(np.searchsorted(starts, e))
                    if k == 0 or ends[k - 1] <= s:
                        clear.append((s, 3, e))
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(utf8(shown(base))).hexdigest(), shown(sorted(base + clear))))
            return list(zip(*rows, strict=True))

        return compute

    return append_columns(docs, FIELDS, make)

"""Exact token counts of every prefix of a text, for a byte-level BPE tokenizer file.

A text falls into units: a run of white space with the word, number or punctuation that it leads to. The tokens of a
prefix never depend on what comes after it, and those of a unit not on the units around it, so a prefix costs the
tokens of the units before the cut plus those of the cut unit. Inside a pre-token the counts come from dynamic
programming over byte prefixes: the last token of prefix i is the only vocabulary entry t, ending at i, whose encoding
is itself and which the encoder leaves next to the last token of the prefix before it; count[i] = count[i - len(t)] + 1.

Counts are kept as one signed byte per character: what that character adds to the count (it can be negative, when it
lets tokens merge). Running sums give the count of any prefix, so truncation to a budget never encodes again."""

from __future__ import annotations

import json
from itertools import accumulate, pairwise
from math import inf

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimtrail.llm.common import append_columns

# The pre-tokenizer pattern of this kind of vocabulary.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
UNIT = regex.compile(r"\p{White_Space}*+(?:(?<! )'(?:s|t|re|ve|m|ll|d)|\p{L}++|\p{N}++|[^\p{White_Space}\p{L}\p{N}]++)|\p{White_Space}++")
SPACES = regex.compile(r"\p{White_Space}+")
BLANK_AFTER_SPACE = regex.compile(r"\p{White_Space} ")
#: Distinct units in one generation of a worker's memory; two are kept.
MEMO_UNITS = 500_000
#: A longer unit isn't remembered.
MEMO_CHARS = 64


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


class PrefixCounter:
    """Counts for one tokenizer file; `special` strings are one token each wherever they stand in a text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        raw = lambda s: bytes(byte_of[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        names = set(self.special)
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(spec["model"]["merges"])}
        self.vocabulary = {raw(t) for t in spec["model"]["vocab"] if t not in names}
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.blank_led, self.led = {}, {}  # steps of " " + text, and of text alone: a young and an old generation
        self.old_blank_led, self.old_led = {}, {}
        self.pieces: dict[str, list[int]] = {}
        self.trees: dict[bytes, tuple | None] = {}
        self.edges: dict[tuple[bytes, int], list[tuple[bytes, float]]] = {}
        self.apart: dict[int, bool] = {}
        self.tokens = sorted(self.vocabulary)
        self.ends: dict[int, dict] = {}
        for number, t in enumerate(self.tokens):
            node = self.ends
            for byte in reversed(t):
                node = node.setdefault(byte, {})
            node[-1] = number

    def tree(self, t: bytes) -> tuple | None:
        """(left, right, rank) of the merge that makes t when t alone is encoded; () for a byte, None if t doesn't come out whole."""
        if t not in self.trees:
            parts, last = [t[i : i + 1] for i in range(len(t))], ()
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), inf))
                pair = parts[best], parts[best + 1]
                if pair not in self.rank:
                    break
                last = (*pair, self.rank[pair])
                parts[best : best + 2] = [pair[0] + pair[1]]
            self.trees[t] = last if len(parts) == 1 and t in self.vocabulary else None
        return self.trees[t]

    def edge(self, t: bytes, side: int) -> list[tuple[bytes, float]]:
        """The parts at the right (1) or left (0) end of t while it is put together, each with the rank of the merge that takes it up."""
        found = self.edges.get((t, side))
        if found is None:
            found, node, rank = [], t, inf
            while True:
                found.append((node, rank))
                made = self.tree(node)
                if not made:
                    break
                node, rank = made[side], made[2]
            found.reverse()
            self.edges[t, side] = found
        return found

    def stay_apart(self, a: bytes, b: bytes) -> bool:
        """Whether a followed by b is encoded as these two: at no time does a merge across the border come first."""
        right, left = self.edge(a, 1), self.edge(b, 0)
        i = j = 0
        while True:
            (r, up_a), (l, up_b) = right[i], left[j]
            across = self.rank.get((r, l), inf)
            if across < up_a and across <= up_b and across < inf:
                return False
            if up_a == up_b == inf:
                return True
            if up_a <= up_b:
                i += 1
            else:
                j += 1

    def pre_token(self, data: bytes) -> list[int]:
        """Token count of every byte prefix of a pre-token, from 0 on."""
        counts, last = [0], [0]
        ends, apart, tokens, i = self.ends, self.apart, self.tokens, 0
        for byte in data:
            node, j = ends[byte], i
            i += 1
            while True:
                number = node.get(-1)
                if number is not None:
                    if j == 0:
                        fits = self.tree(tokens[number]) is not None
                    else:
                        pair = last[j] << 20 | number
                        fits = apart.get(pair)
                        if fits is None:
                            if len(apart) >= MEMO_UNITS:
                                apart.clear()
                            fits = apart[pair] = self.tree(tokens[number]) is not None and self.stay_apart(tokens[last[j]], tokens[number])
                    if fits:
                        counts.append(counts[j] + 1)
                        last.append(number)
                        break
                j -= 1
                node = node.get(data[j]) if j >= 0 else None
                if node is None:
                    raise ValueError(f"no token ends at byte {i} of {data!r}")
        return counts

    def piece(self, text: str) -> list[int]:
        """Token count of every prefix of a pre-token, by characters."""
        found = self.pieces.get(text)
        if found is None:
            data = text.encode("utf-8", "surrogatepass")
            found = self.pre_token(data)
            if len(data) != len(text):
                found = [0, *(found[e] for e in accumulate(len(c.encode("utf-8", "surrogatepass")) for c in text))]
            if len(text) <= MEMO_CHARS:
                if len(self.pieces) >= MEMO_UNITS:
                    self.pieces.clear()
                self.pieces[text] = found
        return found

    def unit(self, text: str) -> bytes:
        """Signed steps, one for each character, of a text that begins and ends where units do."""
        at, done, before = [0], 0, ""
        for piece in PRE_TOKEN.findall(text):
            counts = self.piece(piece)
            start = len(at)
            at += [done + n for n in counts[1:]]
            if before and SPACES.match(piece) and SPACES.fullmatch(before):
                # A prefix that stops after this character has it in one pre-token with the white space before.
                at[start] = at[start - len(before) - 1] + self.piece(before + piece[0])[-1]
            if piece in ("'re", "'ve", "'ll"):
                at[-2] = done + 2  # cut to two characters, these are two pre-tokens
            done += counts[-1]
            before = piece
        return bytes([(b - a) & 255 for a, b in pairwise(at)])

    def after_blank(self, text: str) -> bytes:
        """Steps of " " + text, remembered."""
        found = self.old_blank_led.get(text)
        if found is None:
            found = self.unit(" " + text)
        if len(text) <= MEMO_CHARS:
            if len(self.blank_led) >= MEMO_UNITS:
                self.old_blank_led, self.blank_led = self.blank_led, {}
            self.blank_led[text] = found
        return found

    def alone(self, text: str) -> bytes:
        found = self.old_led.get(text)
        if found is None:
            found = self.unit(text)
        if len(text) <= MEMO_CHARS:
            if len(self.led) >= MEMO_UNITS:
                self.old_led, self.led = self.led, {}
            self.led[text] = found
        return found

    def plain(self, text: str) -> bytes:
        if not text:
            return b""
        if BLANK_AFTER_SPACE.search(text):
            led, alone = self.led, self.alone
            return b"".join([led.get(u) or alone(u) for u in UNIT.findall(text)])
        first, *others = text.split(" ")  # here every blank begins a unit
        led, after_blank = self.blank_led, self.after_blank
        return b"".join([self.unit(first), *[led.get(u) or after_blank(u) for u in others]])

    def steps(self, text: str | None) -> bytes:
        """One signed byte for each character: what it adds to the token count."""
        if not text:
            return b""
        if self.split is None or not self.split.search(text):
            return self.plain(text)
        out, at = bytearray(), 0
        for m in self.split.finditer(text):
            before = text[at : m.start()]
            out += self.plain(before)
            # Cut inside a special string, the text is ordinary up to the cut, from where the last unit began.
            head = UNIT.findall(before)[-1:] or [""]
            have = total = sum(np.frombuffer(self.plain(head[0]), np.int8).tolist())
            for i in range(1, len(m[0])):
                now = int(np.frombuffer(self.plain(head[0] + m[0][:i]), np.int8).sum())
                out += np.int8(now - have).tobytes()
                have = now
            out += np.int8(total + 1 - have).tobytes()
            at = m.end()
        return bytes(out + self.plain(text[at:]))


def total(steps: bytes) -> int:
    return int(np.frombuffer(steps, dtype=np.int8).sum(dtype=np.int64))


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def with_prefix_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds prefix_steps (binary, one signed byte for each character of the text), n_tokens and n_bytes (UTF-8).

    Null and empty texts have no steps and no tokens. Rows, ties and other columns stay as they are."""

    def make():
        encode = counter(path)

        def compute(texts):
            steps = [encode.steps(t) for t in texts]
            return [steps, [total(s) for s in steps], [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]]

        return compute

    return append_columns(docs, [T.StructField("prefix_steps", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_bytes", T.LongType())], make, text)


@F.pandas_udf(T.LongType())
def _characters_within(steps, budget):
    import pandas as pd

    out = []
    for s, most in zip(steps, budget, strict=True):
        fits = np.flatnonzero(np.cumsum(np.frombuffer(s, dtype=np.int8), dtype=np.int64) <= most)
        out.append(int(fits[-1]) + 1 if len(fits) else 0)
    return pd.Series(out, dtype="int64")


@F.pandas_udf(T.LongType())
def _tokens_at(steps, cut):
    import pandas as pd

    return pd.Series([int(np.frombuffer(s[:n], dtype=np.int8).sum(dtype=np.int64)) for s, n in zip(steps, cut, strict=True)], dtype="int64")


def characters_within(budget: Column | int, steps: str = "prefix_steps") -> Column:
    """Length of the longest prefix that takes at most `budget` tokens; no text is encoded again."""
    return _characters_within(F.col(steps), F.lit(budget) if isinstance(budget, int) else budget)


def tokens_at(cut: Column | int, steps: str = "prefix_steps") -> Column:
    """Exact token count of the prefix of `cut` characters."""
    return _tokens_at(F.col(steps), F.lit(cut) if isinstance(cut, int) else cut)

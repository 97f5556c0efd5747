"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

The lattice of a text has a node between any two characters and an edge for every vocabulary piece that stands there;
characters without a piece of their own take the edge of their bytes. Blanks only begin pieces, so the lattice falls
apart before every run of blanks, and each unit (blanks and the word after them) has a forward filter of its own: the
total weight of all paths to each node. A segmentation is drawn from the end of a unit backwards, each piece with its
share of the weight that reaches the node. The units that are new in a batch are filtered together with numpy and
kept for later batches in a memo of bounded size; all draws of a batch are made together. Random numbers are a hash of seed, row key, unit number and draw number, so a row's
segmentation is the same whatever the partitions, batches or retries are.

A piece weighs (rank + 1) ** -alpha; the model file gives ranks, not probabilities. Literal U+2581 characters go as
bytes, so that decoding gives every text back."""

from __future__ import annotations

import hashlib
import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dimtrail.llm.common import append_columns

ALPHA = 1.0
SEED = 42
BLANK = "▁"
UNIT = re.compile(" +[^ ]*")
#: Text of one batch: the lattice of a megabyte takes about a hundred.
BATCH_BYTES = 1 << 20
#: Edges that a memo holds before it is given up, at 16 to 32 bytes each.
MEMO_EDGES = 3 << 20
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Memo:
    """Filtered units of earlier batches, in arrays that grow; given up as a whole when it is full."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.units = self.edges = self.nodes = 0
        self.held = [np.empty(0, t) for t in (np.int64, np.uint64, np.int32, np.int32)]

    def full(self) -> bool:
        return self.edges >= MEMO_EDGES

    def add(self, last: np.ndarray, reach: np.ndarray, piece: np.ndarray, back: np.ndarray) -> None:
        """Units after those there are; their nodes get the next numbers."""
        made = (last + self.nodes, reach + (np.uint64(self.nodes) << np.uint64(32)), piece, np.where(back < 0, -1, back + self.nodes))
        for k, (at, new) in enumerate(zip((self.units, *[self.edges] * 3), made, strict=True)):
            if at + len(new) > len(self.held[k]):
                grown = np.empty(2 * (at + len(new)), self.held[k].dtype)
                grown[:at] = self.held[k][:at]
                self.held[k] = grown
            self.held[k][at : at + len(new)] = new
        self.units += len(last)
        self.edges += len(reach)
        self.nodes += int(last[-1]) + 1

    def arrays(self) -> list[np.ndarray]:
        return [a[:n] for a, n in zip(self.held, (self.units, *[self.edges] * 3), strict=True)]


class Lattice:
    def __init__(self, path: str, alpha: float = ALPHA):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes] = []
        self.byte_id = [0] * 256
        pieces, first = [], None
        for n in range(model.get_piece_size()):
            piece = model.id_to_piece(n)
            if model.is_byte(n):
                value = int(_BYTE.fullmatch(piece)[1], 16)
                self.byte_id[value] = n
                self.bytes_of.append(bytes([value]))
            elif model.is_control(n) or model.is_unknown(n):
                self.bytes_of.append(b"")
            else:
                first = n if first is None else first
                pieces.append((piece.replace(BLANK, " "), n))
                self.bytes_of.append(pieces[-1][0].encode())
        self.weight = (np.maximum(np.arange(model.get_piece_size()) - first, 0) + 2.0) ** -alpha
        self.byte_weight = (model.get_piece_size() - first + 2.0) ** -alpha
        step: dict[int, int] = {}  # trie node << 21 | character: next node
        ends = [-1]
        for piece, n in pieces:
            node = 0
            for c in piece:
                nxt = step.setdefault(node << 21 | ord(c), len(ends))
                if nxt == len(ends):
                    ends.append(-1)
                node = nxt
            ends[node] = n
        keys = np.array(sorted(step), dtype=np.int64)
        self.step_key, self.step_to = np.append(keys, -1), np.array([*[step[k] for k in keys.tolist()], 0])
        self.ends = np.array(ends)
        self.longest = max(len(p) for p, _ in pieces)
        self.byte_lengths = np.array([len(b) for b in self.bytes_of])
        self.byte_starts = np.cumsum(self.byte_lengths) - self.byte_lengths
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.memo = Memo()

    def edges(self, chars: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First character, length, piece and weight of every edge; left: characters to the end of the unit. A character of bytes has the piece -1 - character."""
        at, node, found = np.arange(len(chars)), np.zeros(len(chars), np.int64), []
        for n in range(1, self.longest + 1):
            inside = left[at] >= n
            at, node = at[inside], node[inside]
            key = node << 21 | chars[at + n - 1]
            place = np.searchsorted(self.step_key[:-1], key)
            fits = self.step_key[place] == key
            at, node = at[fits], self.step_to[place[fits]]
            piece = self.ends[node]
            whole = piece >= 0
            found.append((at[whole], np.full(int(whole.sum()), n), piece[whole], self.weight[piece[whole]]))
            if n == 1:
                lone = np.ones(len(chars), bool)
                lone[at[whole]] = False
                lone = np.flatnonzero(lone)
                size = 1 + (chars[lone] > 0x7F) + (chars[lone] > 0x7FF) + (chars[lone] > 0xFFFF)
                found.append((lone, np.ones(len(lone), np.int64), -1 - chars[lone], self.byte_weight**size))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def filtered(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Last node of each unit; and of the edges, by the node they end at: reach (node number and running share of the node's weight as a 32-bit fraction), piece and node before, -1 at the unit's start.

        Weights are summed as logarithms, so units may be of any length, and a unit's shares are the same whatever
        units come with it."""
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.array([len(u) for u in units], np.int64)
        unit = np.repeat(np.arange(len(units)), sizes)
        begin = np.cumsum(sizes) - sizes
        offset = np.arange(len(chars)) - begin[unit]
        at, length, piece, weight = self.edges(chars, sizes[unit] - offset)
        order = np.argsort(at + unit[at] + length, kind="stable")  # every unit has one node more than characters
        at, length, piece, weight = at[order], length[order], piece[order], np.log(weight[order])
        start = at + unit[at]
        end = start + length
        head = begin + np.arange(len(units))
        depth = offset[at] + length
        longest = int(sizes.max(initial=0))
        by_depth = np.argsort(depth.astype(np.int16) if longest < 1 << 15 else depth, kind="stable")
        bounds = np.searchsorted(depth[by_depth], np.arange(1, longest + 2))
        total, share = np.zeros(len(chars) + len(units)), np.empty(len(end))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            part = by_depth[lo:hi]
            node = end[part]
            first = np.flatnonzero(np.diff(node, prepend=-1))
            x = total[start[part]] + weight[part]
            most = np.maximum.reduceat(x, first)
            count = np.diff(first, append=len(part))
            x = np.exp(x - np.repeat(most, count))
            whole = np.add.reduceat(x, first)
            total[node[first]] = most + np.log(whole)
            share[part] = x / np.repeat(whole, count)
        first = np.flatnonzero(np.diff(end, prepend=-1))
        count = np.diff(first, append=len(end))
        for k in range(1, int(count.max(initial=1))):
            here = first[count > k] + k
            share[here] += share[here - 1]
        reach = np.minimum(share * 2.0**32, 2.0**32 - 1).astype(np.uint64)
        reach[first + count - 1] = 1 << 32
        reach += end.astype(np.uint64) << np.uint64(32)
        return head + sizes, reach, piece, np.where(start == head[unit[at]], -1, start)

    def sample(self, texts: list[str | None], keys: list[int | None], seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts one after another, and where each text's begin (and the end)."""
        if self.memo.full():
            self.memo = Memo()
        number = self.memo.number
        known = len(number)
        which, counts = [], []
        for t in texts:
            if not t:
                counts.append(0)
                continue
            if "  " in t or t[0] == " ":
                units = UNIT.findall(" " + t)
            else:
                units = [" " + w for w in t.split(" ")]
            which += [number.setdefault(u, len(number)) for u in units]
            counts.append(len(units))
        counts, which = np.array(counts, dtype=np.int64), np.array(which, dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(counts)])
        if not len(which):
            return np.zeros(0, np.int32), first
        if len(number) > known:
            self.memo.add(*self.filtered(list(islice(number, known, None))))
        last, reach, piece, back = self.memo.arrays()
        row_seed = mix(np.array([hash_key(k) for k in keys], dtype=np.uint64) ^ np.uint64(seed))
        unit_seed = np.repeat(row_seed, counts) + np.arange(len(which), dtype=np.uint64) - np.repeat(first[:-1].astype(np.uint64), counts)
        live, drawn, step = np.argsort(which), [], 0  # by unit, so that draws look at the memo in its order
        here, unit_seed = last[which[live]], mix(unit_seed * np.uint64(0x9E3779B97F4A7C15))[live]
        lengths = np.zeros(len(which), dtype=np.int64)
        while len(live):
            u = mix(unit_seed + np.uint64(step)) >> np.uint64(32)
            edge = np.searchsorted(reach, here.astype(np.uint64) << np.uint64(32) | u, side="right")
            drawn.append((live, piece[edge]))
            lengths[live] += 1
            here = back[edge]
            on = np.flatnonzero(here >= 0)
            live, here, unit_seed = live[on], here[on], unit_seed[on]
            step += 1
        ends = np.cumsum(lengths)
        ids = np.empty(int(ends[-1]), dtype=np.int64)
        for k, (units, chosen) in enumerate(drawn):
            ids[ends[units] - 1 - k] = chosen
        offsets = np.concatenate([[0], ends])[first]
        if (ids < 0).any():
            ids, offsets = self._spelled(ids, offsets)
        return ids.astype(np.int32), offsets

    def _spelled(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the pieces of their bytes."""
        lone = np.flatnonzero(ids < 0)
        spelled = {c: [self.byte_id[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in np.unique(-1 - ids[lone]).tolist()}
        parts, done = [], 0
        extra = np.zeros(len(ids) + 1, np.int64)
        for i in lone.tolist():
            own = spelled[-1 - int(ids[i])]
            parts += [ids[done:i], np.array(own)]
            extra[i + 1] = len(own) - 1
            done = i + 1
        return np.concatenate([*parts, ids[done:]]), offsets + np.cumsum(extra)[offsets]

    def same_texts(self, ids: np.ndarray, offsets: np.ndarray, texts: list[str | None]) -> np.ndarray:
        """Whether the ids of each text decode to it."""
        length = self.byte_lengths[ids]
        ends = np.concatenate([[0], np.cumsum(length)])
        spelled = self.all_bytes[np.arange(ends[-1]) + np.repeat(self.byte_starts[ids] - ends[:-1], length)]
        want = [b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        if spelled.tobytes() == b"".join(want) and (np.diff(ends[offsets]) == [len(w) for w in want]).all():
            return np.ones(len(texts), bool)
        return np.array([spelled[lo:hi].tobytes() == w for lo, hi, w in zip(ends[offsets[:-1]], ends[offsets[1:]], want, strict=True)])

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: the blank that begins every non-empty encoding is taken off."""
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_key(key) -> int:
    """A row key as 64 bits; null has a number of its own."""
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "little")


_LATTICES: dict = {}


def lattice(path: str, alpha: float = ALPHA) -> Lattice:
    if (path, alpha) not in _LATTICES:
        _LATTICES[path, alpha] = Lattice(path, alpha)
    return _LATTICES[path, alpha]


def with_pieces(docs: DataFrame, path: str, alpha: float = ALPHA, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """Adds pieces (array of ids): a segmentation drawn for the row's key, the same in every run.

    A null or empty text has no pieces. Rows with equal key and text have equal pieces; other columns stay as they are."""

    def make():
        model = lattice(path, alpha)

        def compute(texts, keys):
            ids, offsets = model.sample(texts, keys, seed)
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]

        return compute

    return append_columns(docs, [T.StructField("pieces", T.ArrayType(T.IntegerType()))], make, also=[key], slice_bytes=BATCH_BYTES)


def with_decoded(encoded: DataFrame, path: str, column: str = "decoded", pieces: str = "pieces") -> DataFrame:
    """Adds the text that the pieces stand for; no or null pieces give ''."""
    at = T.StructType([*[f for f in encoded.schema.fields if f.name != column], T.StructField(column, T.StringType())])

    def run(batches):
        model = lattice(path)
        for batch in batches:
            made = pa.array([model.decode(ids or []) for ids in batch.column(batch.schema.get_field_index(pieces)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(f.name)) for f in at.fields[:-1]], made], names=at.names)

    return encoded.mapInArrow(run, at)


def with_round_trip(docs: DataFrame, path: str, alpha: float = ALPHA, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """Adds n_pieces, pieces_sha256 (of the ids as little-endian 32-bit numbers) and lossless (whether decoding gives the text back), without keeping the pieces."""

    def make():
        model = lattice(path, alpha)

        def compute(texts, keys):
            ids, offsets = model.sample(texts, keys, seed)
            own = ids.astype("<i4", copy=False)
            sums = [hashlib.sha256(own[lo:hi]).hexdigest() for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return [pa.array(np.diff(offsets)), sums, pa.array(model.same_texts(ids, offsets, texts))]

        return compute

    fields = [T.StructField("n_pieces", T.LongType()), T.StructField("pieces_sha256", T.StringType()), T.StructField("lossless", T.BooleanType())]
    return append_columns(docs, fields, make, also=[key], slice_bytes=BATCH_BYTES)

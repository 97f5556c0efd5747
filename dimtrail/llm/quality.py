"""Quality classifier from weak labels.

Heuristic labellers vote good (1), bad (-1) or nothing (0) on every text. Their votes overlap and err; expectation-
maximisation over the counts of vote patterns estimates how often each labeller votes what on good and on bad texts, and
so the probability that a pattern's texts are good. There are at most 3 ** labellers patterns, whatever the input. These
posterior labels train a linear scorer on hashed features, which then judges every text.

Counts and patterns come from all texts. The scorer is fitted on about TRAIN_ROWS texts, half of them probably good and
half probably bad, chosen by a hash of id and text; their feature vectors have a fixed size."""

from __future__ import annotations

import zlib
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dimtrail.llm.common import append_columns, lower_ascii, utf8

TRAIN_ROWS = 4000
HALF = 2048
#: The scorer's limit; short clean texts have few features and come out between this and a half.
KEEP = 0.25
EM_ROUNDS = 200
# Frequent function words of the languages in use.
FUNCTION_WORDS = frozenset(w.encode() for w in "the of and to in a is that it for on was be with as this by are an from at or not der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es le la les de des et un une du en que qui dans pour par sur pas au avec ce il est el los las y se por con para su al lo como más o pero sus".split())
SYMBOLS = np.frombuffer(b"#$%&*@^~<>{}[]\\=+_`", np.uint8)

#: Shape classes of bytes: 0 blank, 1 line feed, 2 lower case, 3 upper case, 4 digit, 5 full stop or comma, 6 ! or ?, 7 quotes and brackets, 8 bar, 9 symbols, 10 other ASCII, 11 part of a longer character.
CLASSES = np.full(256, 10, np.uint8)
CLASSES[128:] = 11
for _class, _chars in ((0, b" \t\r"), (1, b"\n"), (2, bytes(range(97, 123))), (3, bytes(range(65, 91))), (4, b"0123456789"), (5, b".,;:"), (6, b"!?"), (7, b"\"'()"), (8, b"|"), (9, SYMBOLS.tobytes())):
    CLASSES[np.frombuffer(_chars, np.uint8)] = _class

LABELLERS = ("shouting", "exclaiming", "symbols", "bars", "function_words", "punctuation", "stutter", "variety", "squeeze", "sentences", "word_length", "size")
#: Labellers on shares of words keep silent below this many words.
FEW_WORDS = 15
#: Texts are compressed in pieces of this size, so that long ones aren't favoured.
PIECE = 2048


def _vote(bad: bool, good: bool) -> int:
    return -1 if bad else int(bool(good))


def votes(text: str | None) -> tuple[int, ...]:
    """One vote for each of LABELLERS; a text without words gets only bad votes on size, nothing else."""
    data = utf8(text)
    words = lower_ascii(data).split()
    if not words:
        return (0,) * 11 + (-1,)
    n, many = len(words), len(words) >= FEW_WORDS
    of = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower = of[65:91].sum(), of[97:123].sum() + of[0xC3]
    visible = len(data) - of[32] - of[9:14].sum()
    marks = of[33:128].sum() - of[48:58].sum() - upper - of[97:123].sum()
    known = len([w for w in words if w in FUNCTION_WORDS]) / n
    per_stop = n / (of[46] + of[33] + of[63] + 1)
    same = sum(map(eq, words, words[1:])) / n
    variety = len(set(words)) / n**0.9
    squeezed = sum(len(zlib.compress(data[i : i + PIECE], 1)) for i in range(0, len(data), PIECE)) / len(data) if many else 1.0
    return (
        _vote(upper > 0.3 * (upper + lower) and upper > 5, upper < 0.15 * (upper + lower)),
        _vote(data.count(b"!!") > 0.1 * n, b"!!" not in data),
        _vote(of[SYMBOLS].sum() > 0.2 * n, of[SYMBOLS].sum() < 0.05 * n),
        _vote(data.count(b" | ") > 0.1 * n, of[124] == 0),
        _vote(many and known < 0.06, many and known > 0.12),
        _vote(marks > 0.12 * visible and many, marks < 0.08 * visible),
        _vote(same > 0.15 and many, many and same < 0.05),
        _vote(many and variety < 0.3, many and variety > 0.5),
        _vote(many and squeezed < 0.3, many and squeezed > 0.4),
        _vote(many and (per_stop > 60 or per_stop < 1.5), many and 4 < per_stop < 40),
        _vote(visible > 14 * n and many, 2 * n < visible < 9 * n),
        _vote(n < 2, n > 8),
    )


def pattern_of(text: str | None) -> int:
    """The votes as one number in base 3."""
    return sum((v + 1) * 3**i for i, v in enumerate(votes(text)))


def votes_of(pattern: int) -> list[int]:
    return [pattern // 3**i % 3 - 1 for i in range(len(LABELLERS))]


def label_model(counts: dict[int, int], rounds: int = EM_ROUNDS) -> tuple[dict[int, float], np.ndarray]:
    """Probability of good for each pattern, and each labeller's vote shares on bad and good texts (labeller x class x vote)."""
    patterns = sorted(counts)
    table = np.array([votes_of(p) for p in patterns], dtype=int).reshape(-1, len(LABELLERS)) + 1
    n = np.array([counts[p] for p in patterns], float)
    good = np.array([0.95, 0.4, 0.1])[np.minimum((table == 0).sum(axis=1), 2)]  # to begin with: two bad votes are much, one is little
    shares = np.full((len(LABELLERS), 2, 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([(1 - good) * n, good * n])
        for i in range(len(LABELLERS)):
            for c in range(2):
                own = np.bincount(table[:, i], weight[c], 3) + 1.0
                own[1] = 0  # silence is no evidence
                shares[i, c] = own / own.sum()
        prior = (weight.sum(axis=1) + 1) / (n.sum() + 2)
        ratio = np.log(np.maximum(shares[:, 1], 1e-12) / np.maximum(shares[:, 0], 1e-12))
        odds = np.log(prior[1] / prior[0]) + sum(ratio[i, table[:, i]] for i in range(len(LABELLERS)))
        good = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(patterns, good.tolist(), strict=True)), shares


def features(text: str | None) -> np.ndarray:
    """Hashed counts of byte quadruples and of shape triples, damped, each half of length 1; zeros for an empty text."""
    data = np.frombuffer(lower_ascii(utf8(text)), np.uint8)
    shape = CLASSES[np.frombuffer(utf8(text), np.uint8)]
    out = np.zeros(2 * HALF, np.float32)
    if len(data) >= 4:
        x = data.astype(np.uint32)
        code = (x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:]) * np.uint32(2654435761)
        out[:HALF] = np.bincount(code >> np.uint32(21), minlength=HALF)
    if len(data) >= 3:
        s = shape.astype(np.uint32)
        out[HALF:] = np.bincount(s[:-2] * 144 + s[1:-1] * 12 + s[2:], minlength=HALF)
    np.log1p(out, out=out)
    for half in (out[:HALF], out[HALF:]):
        size = np.sqrt(half @ half)
        if size:
            half /= size
    return out


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer on soft labels, the last for the constant."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, first, second = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    for k in range(1, rounds + 1):
        slope = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y).astype(np.float32) / max(len(y), 1) + ridge * w
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w = w - 0.05 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return w


def with_pattern(docs: DataFrame) -> DataFrame:
    """Adds pattern, the votes as one number, to every row; null and empty texts have that of a bad vote on size alone, equal texts have equal ones."""

    def make():
        return lambda texts: [[pattern_of(t) for t in texts]]

    return append_columns(docs, [T.StructField("pattern", T.IntegerType())], make)


class QualityModel:
    """Label model and scorer fitted on a documents table."""

    def __init__(self, posterior: dict[int, float], shares: np.ndarray, weights: np.ndarray):
        self.posterior, self.shares, self.weights = posterior, shares, weights


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Fits on all rows' vote patterns and about train_rows feature vectors. An empty table gives a scorer that says 0.5."""
    rows = with_pattern(docs.select("doc_id", "text")).groupBy("pattern").count().collect()  # at most 3 ** labellers rows
    counts = {r["pattern"]: r["count"] for r in rows}
    posterior, shares = label_model(counts)
    sides = [sum(n for p, n in counts.items() if (posterior[p] >= 0.5) == side) for side in (False, True)]
    share = [min(1.0, train_rows / 2 / max(n, 1)) for n in sides]

    def make():
        def compute(texts, marks):
            out, label = [], []
            for t, mark in zip(texts, marks, strict=True):
                good = posterior[pattern_of(t)] if mark < max(share) else 0.0
                use = mark < share[good >= 0.5]
                out.append(features(t).astype(np.float16).tobytes() if use else None)
                label.append(good)
            return [out, label]

        return compute

    mark = (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)).alias("__dt_mark")
    chosen = append_columns(docs.select("text", mark).where(F.col("__dt_mark") < max(share)), [T.StructField("x", T.BinaryType()), T.StructField("y", T.DoubleType())], make, also=["__dt_mark"]).where("x is not null")
    sample = chosen.dropDuplicates(["__dt_mark"]).select("x", "y").collect()  # a row that is repeated very often comes once
    if not sample:
        return QualityModel(posterior, shares, np.zeros(2 * HALF + 1, np.float32))
    sample.sort(key=lambda r: (r.y, bytes(r.x)))  # the same fit whatever order the rows come in
    x = np.stack([np.frombuffer(r.x, np.float16) for r in sample]).astype(np.float32)
    return QualityModel(posterior, shares, fit_scorer(x, np.array([r.y for r in sample])))


def with_quality(docs: DataFrame, model: QualityModel | None = None, keep: float = KEEP) -> DataFrame:
    """Adds votes, weak_label (the label model's probability of good), score (the scorer's) and keep (score >= keep) to every row.

    Null and empty texts have no features and only a bad vote on size; they are scored 0 and not kept. Equal texts are judged alike; other columns stay as they are."""
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.posterior, model.weights))

    def make():
        posterior, w = shared.value

        def compute(texts):
            patterns = [pattern_of(t) for t in texts]
            scores = [float(1 / (1 + np.exp(-np.clip(features(t) @ w[:-1] + w[-1], -30, 30)))) if t and not t.isspace() else 0.0 for t in texts]
            return [[votes_of(p) for p in patterns], [posterior.get(p) for p in patterns], scores, [s >= keep for s in scores]]

        return compute

    fields = [T.StructField("votes", T.ArrayType(T.IntegerType())), T.StructField("weak_label", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType())]
    return append_columns(docs, fields, make)

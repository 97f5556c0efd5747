"""SimHash fingerprints of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dimtrail.llm.common import append_columns, lower_ascii, utf8

SHINGLE_WORDS = 4
SEED = 42
_SPREAD = 1 << np.arange(64, dtype=np.uint64)


def simhash(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint: bit b is 1 if it is set in over half of the shingles' XXH64; 0 for a text without words.

    A text of fewer words than a shingle counts as one shingle of all of them; repeated shingles count each time."""
    found = lower_ascii(utf8(text)).split()  # at blanks and bytes 9 to 13
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    shingles = max(1, len(found) - words + 1)
    if words == 4 and shingles > 1:
        made = [digest(b"%b %b %b %b" % s, SEED) for s in zip(found, found[1:], found[2:], found[3:])]
    else:
        made = [digest(b" ".join(found[i : i + words]), SEED) for i in range(shingles)]
    hashes = np.array(made, dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_SPREAD[2 * ones > len(hashes)].sum(dtype=np.uint64))


def with_fingerprint(docs: DataFrame, column: str = "fp") -> DataFrame:
    """Adds the fingerprint as a signed long of the same bits to every row; null and empty texts have 0, equal texts equal ones."""

    def make():
        def compute(texts):
            return [np.array([simhash(t) for t in texts], dtype=np.uint64).view(np.int64).tolist()]

        return compute

    return append_columns(docs, [T.StructField(column, T.LongType())], make)

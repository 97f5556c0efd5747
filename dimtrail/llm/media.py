"""PNG columns: texts stored as 8-bit RGB images, read back chunk by chunk, with cosine-transform hashes.

Images are WIDTH pixels wide, so a row is ROW bytes. Encoding picks a filter for every row (none, sub or up, by the
least sum of absolute differences); decoding tests the signature and every chunk's checksum, inflates the data and undoes
all five filters with numpy."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from dimtrail.llm.common import append_columns, utf8

WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
LEVEL = 6
#: Side of the reduced grey image and of the low-frequency square that is hashed.
SIDE, LOW = 32, 8
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Rows filtered or unfiltered at once.
STRIP = 8192

FIELDS = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("feature", T.StringType()),
]
MEDIA = T.StructField("media", T.BinaryType())


def payload(text: str | None) -> bytes:
    """The UTF-8 bytes with blanks up to a positive multiple of ROW."""
    data = utf8(text)
    return data + b" " * (-len(data) % ROW if data else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(data: bytes) -> bytes:
    """An RGB image of the bytes, whose number is a positive multiple of ROW."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, ROW)
    packer, packed, above = zlib.compressobj(LEVEL), [], np.zeros((1, ROW), np.uint8)
    for lo in range(0, len(rows), STRIP):
        part = rows[lo : lo + STRIP]
        left = np.pad(part[:, :-CHANNELS], ((0, 0), (CHANNELS, 0)))
        tries = np.stack([part, part - left, part - np.concatenate([above, part[:-1]])])
        best = np.abs(tries.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
        lines = np.empty((len(part), ROW + 1), np.uint8)
        lines[:, 0], lines[:, 1:] = best, tries[best, np.arange(len(part))]
        packed.append(packer.compress(lines.tobytes()))
        above = part[-1:]
    packed.append(packer.flush())
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", b"".join(packed)) + _chunk(b"IEND", b"")


def unfilter(lines: np.ndarray, step: int) -> np.ndarray:
    """Pixel bytes of filtered lines, each led by its filter number; step: bytes of a pixel."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    width = out.shape[1]
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for lo, hi in zip([0, *edges], [*edges, len(out)], strict=True):
        kind, part = kinds[lo], out[lo:hi]
        above = out[lo - 1] if lo else np.zeros(width, np.uint8)
        if kind == 1:
            part[:] = np.cumsum(part.reshape(hi - lo, -1, step), axis=1, dtype=np.uint8).reshape(hi - lo, width)
        elif kind == 2:
            part[0] += above
            np.cumsum(part, axis=0, dtype=np.uint8, out=part)
        elif kind in (3, 4):
            for row in part:
                up, a, c = above.astype(np.int16), np.zeros(step, np.int16), np.zeros(step, np.int16)
                for x in range(0, width, step):
                    b = up[x : x + step]
                    if kind == 3:
                        guess = (a + b) // 2
                    else:
                        p = a + b - c
                        pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                        guess = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
                    row[x : x + step] += guess.astype(np.uint8)
                    a, c = row[x : x + step].astype(np.int16), b
                above = row
        elif kind > 4:
            raise ValueError(f"unknown filter {kind}")
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Height x width x channels of an 8-bit grey, RGB or RGBA image without interlace; anything damaged is an error."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, size, parts, ended = 8, None, [], False
    while at < len(data) and not ended:
        length, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + length]
        if len(body) < length or struct.unpack(">I", data[at + 8 + length : at + 12 + length])[0] != zlib.crc32(kind + body):
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            width, height, depth, color, *methods = struct.unpack(">IIBBBBB", body)
            if depth != 8 or color not in (0, 2, 6) or any(methods):
                raise ValueError("only 8-bit grey, RGB and RGBA without interlace")
            size = height, width, {0: 1, 2: 3, 6: 4}[color]
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + length
    if size is None or not ended:
        raise ValueError("cut off")
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(size[0], -1)
    return unfilter(lines, size[2]).reshape(size)


def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * SIDE))


COSINES = _cosines()


def _means(image: np.ndarray, axis: int) -> np.ndarray:
    """SIDE means over the axis, of whole samples; a shorter axis repeats samples."""
    n = image.shape[axis]
    edges = np.arange(SIDE) * n // SIDE
    counts = np.maximum(np.diff([*edges, n]), 1)
    if n < SIDE:
        return np.take(image, edges, axis)
    shape = [1] * image.ndim
    shape[axis] = SIDE
    return np.add.reduceat(image, edges, axis) / counts.reshape(shape)


def cosine_hash(image: np.ndarray) -> str:
    """64 bits in hex: which low-frequency coefficients of the reduced grey image exceed their median (the mean's own coefficient doesn't vote)."""
    grey = image.sum(axis=2, dtype=np.int64) if image.ndim == 3 else image.astype(np.int64)
    low = COSINES @ _means(_means(grey, 0), 1) @ COSINES.T
    flat = low.ravel().round(6)
    bits = flat > np.median(flat[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def with_media(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """Adds media (binary PNG), the digests of what is read back from it, and feature, for every row.

    A null or empty text is one row of blanks. Equal texts have equal values; rows and other columns stay as they are."""

    def make():
        def compute(texts):
            rows = []
            for t in texts:
                data = payload(t)
                stored = encode_png(data)
                image = decode_png(stored)
                back = image.tobytes()
                if back != data:
                    raise ValueError("the stored image does not give its payload back")
                row = (len(utf8(t)), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), cosine_hash(image))
                rows.append((*row, stored) if keep_media else row)
            return list(zip(*rows, strict=True))

        return compute

    return append_columns(docs, [*FIELDS, MEDIA] if keep_media else FIELDS, make)

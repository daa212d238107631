"""Media columns: 8-bit grey PNG files in binary columns, and low-frequency cosine-transform hashes.

Files are built from their chunks with zlib; every row gets the filter with the least sum of
absolute residuals among none, sub and up. Reading checks the signature, the order and CRC of every
chunk and the zlib checksum, and undoes all five filters with numpy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import append_arrow

# Fixed values of the file format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)
#: Ancillary private chunk with the number of bytes before padding.
LENGTH_CHUNK = b"byTe"
#: Samples per row, compression level, bytes of an IDAT chunk, side of the pooled image and of the kept low frequencies.
WIDTH, LEVEL, IDAT_BYTES, SIDE, LOW = 64, 3, 1 << 16, 32, 8


class PngError(ValueError):
    """A file that breaks the format or one of its checksums."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _filtered(img: np.ndarray) -> bytes:
    """The rows, each behind its filter byte."""
    h, w = img.shape
    made = np.empty((3, h, w), np.uint8)
    made[0] = img
    made[1, :, 0] = img[:, 0]
    np.subtract(img[:, 1:], img[:, :-1], out=made[1, :, 1:])
    made[2, 0] = img[0]
    np.subtract(img[1:], img[:-1], out=made[2, 1:])
    cost = np.minimum(made, 0 - made).sum(axis=2, dtype=np.int32)
    best = cost.argmin(axis=0)
    out = np.empty((h, w + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = made[best, np.arange(h)]
    return out.tobytes()


def encode_png(payload: bytes, n_bytes: int | None = None, width: int = WIDTH, level: int = LEVEL) -> bytes:
    """A grey PNG whose samples are the bytes of `payload`, a positive multiple of `width`."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must fill one or more rows")
    img = np.frombuffer(payload, np.uint8).reshape(-1, width)
    data = zlib.compress(_filtered(img), level)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(img), 8, 0, 0, 0, 0))]
    if n_bytes is not None:
        parts.append(_chunk(LENGTH_CHUNK, struct.pack(">Q", n_bytes)))
    parts += [_chunk(b"IDAT", data[i : i + IDAT_BYTES]) for i in range(0, len(data), IDAT_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Samples of (height, 1 + width) filtered grey rows; runs of rows with one filter go together."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    starts = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]])
    above = np.zeros(out.shape[1], np.uint8)
    for s, e in zip(starts, np.r_[starts[1:], len(out)], strict=True):
        kind, part = kinds[s], out[s:e]
        if kind == SUB:
            np.cumsum(part, axis=1, dtype=np.uint8, out=part)
        elif kind == UP:
            part[0] += above
            np.cumsum(part, axis=0, dtype=np.uint8, out=part)
        elif kind in (AVERAGE, PAETH):
            for row in part:
                _by_sample(row, above, kind)
                above = row
        elif kind != NONE:
            raise PngError(f"unknown filter {kind}")
        above = part[-1]
    return out


def _by_sample(row: np.ndarray, above: np.ndarray, kind: int) -> None:
    left = corner = 0
    for i, (x, up) in enumerate(zip(row.tolist(), above.tolist(), strict=True)):
        if kind == AVERAGE:
            guess = (left + up) // 2
        else:
            a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            guess = left if a <= b and a <= c else up if b <= c else corner
        left, corner = (x + guess) & 255, up
        row[i] = left


@dataclass
class Png:
    samples: np.ndarray
    n_bytes: int | None


def decode_png(data: bytes) -> Png:
    """Samples of an 8-bit grey PNG without interlace; raises PngError for a broken one, for critical chunks
    that are unknown and for chunks out of order."""
    if data[:8] != SIGNATURE:
        raise PngError("no PNG signature")
    at, idat, head, n_bytes, ended, before = 8, [], None, None, False, b""
    while at < len(data):
        if ended or at + 12 > len(data):
            raise PngError("bytes after the end, or a cut chunk")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) < n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise PngError(f"checksum of {kind!r}")
        if (head is None) != (kind == b"IHDR"):
            raise PngError("IHDR must come first and once")
        if kind == b"IHDR":
            if n != 13:
                raise PngError("IHDR must have 13 bytes")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            if idat and before != kind:
                raise PngError("IDAT chunks must follow one another")
            idat.append(body)
        elif kind == LENGTH_CHUNK:
            (n_bytes,) = struct.unpack(">Q", body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise PngError(f"unknown critical chunk {kind!r}")
        at, before = at + 12 + n, kind
    if not ended or head is None or head[2:] != (8, 0, 0, 0, 0):
        raise PngError("not a whole 8-bit grey image")
    width, height = head[:2]
    try:
        rows = zlib.decompress(b"".join(idat))
    except zlib.error as e:
        raise PngError(str(e)) from e
    if len(rows) != height * (width + 1):
        raise PngError("wrong number of samples")
    return Png(unfilter(np.frombuffer(rows, np.uint8).reshape(height, width + 1)), n_bytes)


def _cosines(side: int, low: int) -> np.ndarray:
    """First `low` rows of the orthonormal type-II cosine transform of `side` samples."""
    k, x = np.arange(low)[:, None], np.arange(side)[None, :]
    c = np.cos(np.pi * (2 * x + 1) * k / (2 * side)) * np.sqrt(2 / side)
    c[0] /= np.sqrt(2)
    return c


def dct_hash(img: np.ndarray) -> str:
    """16 hex digits: which low-frequency coefficients of the pooled image exceed their median."""
    h, w = img.shape
    rows = np.minimum(np.arange(SIDE) * h // SIDE, h - 1)
    cols = np.minimum(np.arange(SIDE) * w // SIDE, w - 1)
    pooled = np.add.reduceat(np.add.reduceat(img, cols, axis=1, dtype=np.int64), rows, axis=0)
    size = np.maximum(np.diff(np.r_[rows, h]), 1)[:, None] * np.maximum(np.diff(np.r_[cols, w]), 1)[None, :]
    c = _cosines(SIDE, LOW)
    low = (c @ (pooled / size) @ c.T).round(6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def with_media(docs: DataFrame, text_col: str = "text", width: int = WIDTH, keep: list[str] | None = None) -> DataFrame:
    """Adds `media` (binary): a PNG of each whole text in UTF-8, padded with zero bytes to full rows.

    A null text is stored as the empty one, one row of zeros. Every row has its own file; an input
    column named media is replaced. There is no shuffle.
    """

    def store(texts: list[str | None]) -> list:
        out = []
        for t in texts:
            data = (t or "").encode("utf-8", "surrogatepass")
            full = max(1, -(-len(data) // width)) * width
            out.append(encode_png(data.ljust(full, b"\0"), len(data), width))
        return [out]

    return append_arrow(docs, [text_col], store, [T.StructField("media", T.BinaryType())], keep)


def media_features(df: DataFrame, media_col: str = "media", tail: int = 64, keep: list[str] | None = None) -> DataFrame:
    """Adds what the stored files hold: n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature.

    Everything is computed from the samples that are read back. Null media give nulls; a broken file
    fails the task with PngError, as silently wrong training data would be worse.
    """
    fields = [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]

    def features(files: list[bytes | None]) -> list:
        rows = []
        for x in files:
            if x is None:
                rows.append((None,) * 7)
                continue
            png = decode_png(x)
            data = png.samples.tobytes()
            rows.append(
                (
                    len(data) if png.n_bytes is None else png.n_bytes,
                    len(data),
                    hashlib.sha256(data).hexdigest(),
                    zlib.crc32(data[-tail:]),
                    len(x),
                    hashlib.sha256(x).hexdigest(),
                    dct_hash(png.samples),
                )
            )
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in fields]

    return append_arrow(df, [media_col], features, fields, [c for c in (keep or df.columns) if keep or c != media_col])


def text_media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two steps in a row: files in a binary column, then their features; one row per input row."""
    return media_features(with_media(docs.select(F.col(id_col), F.col(text_col)), text_col, keep=[id_col]), keep=[id_col])

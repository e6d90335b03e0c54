"""Media columns: any bytes as a grey PNG in a binary column, read back with checks, and a cosine-transform hash.

Defined results: a null payload counts as empty bytes; empty bytes become one row of 255s; a payload of any length is one
image; repeated rows, with null ids too, each give a row, and equal payloads give equal images and features; an empty
table gives no rows; extra columns, of whatever names, are left alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Pixels in a row of the image.
WIDTH = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(data: bytes, width: int = WIDTH, level: int = 1, adaptive: bool = False) -> bytes:
    """8-bit grey PNG of len(data) / width rows. Adaptive: each row takes the filter none, sub or up of least
    magnitude, so that reading undoes filters row by row; without, text packs a little better."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, width)
    body = np.zeros((len(rows), width + 1), np.uint8)
    body[:, 1:] = rows
    if adaptive:
        left, above = np.zeros_like(rows), np.zeros_like(rows)
        left[:, 1:], above[1:] = rows[:, :-1], rows[:-1]
        size = lambda x: np.minimum(x, -x).sum(1, dtype=np.int64)  # noqa: E731  of each byte as a signed number
        cost = size(rows)
        for k, other in ((1, rows - left), (2, rows - above)):
            better = (c := size(other)) < cost
            body[better, 0], body[better, 1:] = k, other[better]
            cost = np.minimum(c, cost)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(body, level)) + _chunk(b"IEND", b"")


def decode_png(png: bytes) -> np.ndarray:
    """Rows x width of an 8-bit grey, not interlaced PNG. ValueError on a bad signature, checksum, header or filter."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, shape = 8, [], None
    while at < len(png):
        size, kind = struct.unpack_from(">I4s", png, at)
        body = png[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", png, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"bad checksum in {kind!r}")
        at += 12 + size
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("only 8-bit grey images are read")
            shape = height, width
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
    if shape is None:
        raise ValueError("no header")
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[0], shape[1] + 1)
    return unfilter(raw[:, 0], raw[:, 1:])


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undoes PNG's five row filters for one byte per pixel; runs of one filter are undone together."""
    if len(kinds) and kinds.max() > 4:
        raise ValueError("unknown filter")
    if not kinds.any():
        return rows
    out = rows.copy()
    sub = kinds == 1
    out[sub] = np.cumsum(rows[sub], axis=1, dtype=np.uint8)
    starts = np.flatnonzero(np.diff(kinds, prepend=255))
    for s, e in zip(starts, [*starts[1:], len(kinds)], strict=True):
        above = out[s - 1] if s else np.zeros(rows.shape[1], np.uint8)
        if kinds[s] == 2:
            out[s:e] = above + np.cumsum(rows[s:e], axis=0, dtype=np.uint8)
        elif kinds[s] > 2:
            for r in range(s, e):
                above = out[r - 1] if r else above
                out[r] = _serial(int(kinds[r]), rows[r], above)
    return out


def _serial(kind: int, row: np.ndarray, above: np.ndarray) -> list[int]:
    done, a, c = [], 0, 0
    for x, b in zip(row.tolist(), above.tolist(), strict=True):
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
            guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
        a, c = (x + guess) & 255, b
        done.append(a)
    return done


def _cosines(n: int, keep: int) -> np.ndarray:
    k, x = np.arange(keep)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


_LOW = _cosines(32, 8)
_BLOCKS: dict[int, np.ndarray] = {}


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine coefficients of the 32 x 32 block means exceed their median."""
    h, w = image.shape
    if w not in _BLOCKS:
        _BLOCKS[w] = (np.arange(w)[:, None] * 32 // w == np.arange(32)).astype(np.float32)
    col = image.astype(np.float32) @ _BLOCKS[w]  # whole numbers under 2 ** 24: exact
    edges = np.arange(33) * h // 32
    sums = np.concatenate([np.zeros((1, 32)), np.cumsum(col, axis=0, dtype=np.float64)])
    low, high = np.minimum(edges[:-1], h - 1), np.maximum(edges[1:], np.minimum(edges[:-1], h - 1) + 1)
    means = (sums[high] - sums[low]) / ((high - low)[:, None] * (w / 32))
    coefficients = _LOW @ means @ _LOW.T
    flat = np.round(coefficients.ravel(), 6)
    return np.packbits(flat > np.sort(flat[1:])[31]).tobytes()


def padded(data: bytes, width: int = WIDTH) -> bytes:
    """255s up to a positive multiple of the width."""
    return data + b"\xff" * (-len(data) % width or (0 if data else width))


def store(df: DataFrame, key: str, payload: str = "text", level: int = 1, into: str = "media", adaptive: bool = True) -> DataFrame:
    """(key, n_bytes, media): every payload as a PNG in a binary column, written to shared storage and read again."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({
                key: b[key], "n_bytes": [len(x) for x in b["payload"]],
                "media": [encode_png(padded(bytes(x)), level=level, adaptive=adaptive) for x in b["payload"]],
            })

    return common.written(common.map_rows(df, key, {"payload": common.utf8(payload)}, run, "n_bytes long, media binary"), into)


def describe(media: DataFrame, key: str) -> DataFrame:
    """Reads the stored images: sizes, digests, checksum of the last 32 pixels and the cosine hash."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, n, png in zip(b[key], b["n_bytes"], b["media"], strict=True):
                image = decode_png(bytes(png))
                data = image.tobytes()
                out.append((k, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(png),
                            hashlib.sha256(png).hexdigest(), cosine_hash(image).hex()))
            yield pd.DataFrame(out, columns=names)

    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return common.map_rows(media, key, {"n_bytes": F.col("n_bytes"), "media": F.col("media")}, run,
                           "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return describe(store(docs, "doc_id"), "doc_id")

"""Operator 8, media columns: losslessly stored samples, read back with checks, and a cosine hash.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, become an 8-bit
grey-scale PNG that is 64 samples wide.  The writer tries the row filters none, sub and up on the
picture and keeps what has the least sum of absolute differences; the reader takes any of the five
filters, tests the signature, every chunk's CRC, the zlib checksum, the header and the number of
samples, and undoes the filters with numpy.  Pictures are written to a table as a binary column, and
everything else is derived from what is read back from there.  The feature is the sign pattern, against its median, of
the 8 x 8 lowest frequencies of the two-dimensional cosine transform, without the constant term.

Edge cases: null and empty texts store 64 zero bytes (n_bytes 0); equal texts give equal values in
every column; a null or repeated doc_id is carried through, one result row per input row; an empty
table gives an empty result; other columns are ignored; very long texts are handled in row blocks.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank, durable

WIDTH = 64
LOW = 8
#: Fixed values of the format: its signature and the colour type of grey-scale pictures.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GREY = 0
LEVEL = 3
BLOCK_ROWS = 1 << 15

STORED = "doc_id long, n_bytes long, media binary"
COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, hash binary, media binary"


class BadMedia(ValueError):
    """The stored form fails one of its own checks."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(samples: np.ndarray, kind: int | None = None) -> bytes:
    """A PNG of the rows of `samples` (uint8); `kind` forces a filter of 0, 1 and 2."""
    height, width = samples.shape
    sub = np.diff(samples, axis=1, prepend=np.uint8(0))
    up = np.diff(samples, axis=0, prepend=np.zeros((1, width), np.uint8))
    forms = (samples, sub, up)
    if kind is None:
        kind = int(np.argmin([int(np.abs(f.view(np.int8).astype(np.int16)).sum()) for f in forms]))
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0], rows[:, 1:] = kind, forms[kind]
    header = struct.pack(">IIBBBBB", width, height, 8, GREY, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise BadMedia("signature")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise BadMedia("cut off")
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) != size or data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise BadMedia(f"checksum of {kind!r}")
        yield kind, body
        at += 12 + size


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Samples from filtered rows, one byte a sample."""
    if (kinds == kinds[0]).all() and kinds[0] in (0, 1, 2):
        if kinds[0] == 0:
            return rows
        return np.cumsum(rows, axis=2 - int(kinds[0]), dtype=np.uint8)
    out = np.zeros_like(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    for y, kind in enumerate(kinds):
        row = rows[y]
        if kind == 0:
            done = row.copy()
        elif kind == 1:
            done = np.cumsum(row, dtype=np.uint8)
        elif kind == 2:
            done = row + above
        elif kind in (3, 4):
            done, left, corner = np.empty_like(row), 0, 0
            for x in range(len(row)):
                b = int(above[x])
                if kind == 3:
                    guess = (left + b) // 2
                else:
                    near = left + b - corner
                    guess = min((left, b, corner), key=lambda v, near=near: abs(near - v))
                left, corner = (int(row[x]) + guess) & 255, b
                done[x] = left
        else:
            raise BadMedia(f"filter {kind}")
        out[y] = above = done
    return out


def decode(data: bytes) -> np.ndarray:
    """Samples of an 8-bit grey-scale PNG without interlace."""
    size, body, ended = None, [], False
    for kind, chunk in _chunks(data):
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            ended = True
    if size is None or not ended or size[2:] != (8, GREY, 0, 0, 0):
        raise BadMedia("header")
    width, height = size[:2]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    except zlib.error as e:
        raise BadMedia(str(e)) from e
    if raw.size != height * (width + 1):
        raise BadMedia("number of samples")
    raw = raw.reshape(height, width + 1)
    return unfilter(raw[:, 0], raw[:, 1:])


@functools.lru_cache(64)
def _waves(n: int) -> np.ndarray:
    """The LOW lowest cosine waves over n places, as rows."""
    return np.cos(np.pi / n * (np.arange(n) + 0.5) * np.arange(LOW)[:, None])


def feature(samples: np.ndarray) -> str:
    """16 hex digits: which of the low frequencies are above their median."""
    height, width = samples.shape
    total = np.zeros((LOW, width))
    for y in range(0, height, BLOCK_ROWS):
        part = samples[y : y + BLOCK_ROWS].astype(np.float64)
        if height <= 4096:
            waves = _waves(height)[:, y : y + len(part)]
        else:
            waves = np.cos(np.pi / height * (np.arange(y, y + len(part)) + 0.5) * np.arange(LOW)[:, None])
        total += waves @ part
    low = np.round(total @ _waves(width).T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def payload(text: str | None) -> tuple[int, np.ndarray]:
    """The number of UTF-8 bytes and the padded samples, 64 a row."""
    data = (text or "").encode("utf-8", "surrogatepass")
    size = max(WIDTH, -(-len(data) // WIDTH) * WIDTH)
    return len(data), np.frombuffer(data.ljust(size, b"\0"), np.uint8).reshape(-1, WIDTH)


def _store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        made = [(n, encode(samples)) for n, samples in map(payload, pdf["text"])]
        yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_bytes": [n for n, _ in made], "media": [m for _, m in made]})


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for media in pdf["media"]:
            samples = decode(media)
            data, low = samples.tobytes(), feature(samples)
            rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), low, bytes.fromhex(low)))
        found = pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")[2:-1]], index=pdf.index)
        yield pd.concat([pdf.drop(columns="media"), found, pdf[["media"]]], axis=1).astype({"doc_id": "Int64"})


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the picture of every row's text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank("text").alias("text")).mapInPandas(_store, STORED)


def described(pictures: DataFrame) -> DataFrame:
    """What the pictures of a table like `encoded`'s hold."""
    return pictures.mapInPandas(_read, COLUMNS)


def stored(docs: DataFrame) -> DataFrame:
    """One row per document with its picture and what was read back from the table it was written to."""
    return described(durable(encoded(docs)))

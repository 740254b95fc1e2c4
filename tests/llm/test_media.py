import hashlib
import struct
import zlib

import numpy as np
import pytest

from caseloom.llm import media


def paeth(a, b, c):
    p = a + b - c
    return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]


def filtered(samples, kinds):
    out = np.zeros_like(samples)
    for y, kind in enumerate(kinds):
        for x in range(samples.shape[1]):
            a = int(samples[y, x - 1]) if x else 0
            b = int(samples[y - 1, x]) if y else 0
            c = int(samples[y - 1, x - 1]) if x and y else 0
            guess = (0, a, b, (a + b) // 2, paeth(a, b, c))[kind]
            out[y, x] = (int(samples[y, x]) - guess) % 256
    return out


@pytest.mark.parametrize("kinds", [[0] * 6, [1] * 6, [2] * 6, [3] * 6, [4] * 6, [0, 1, 2, 3, 4, 2]])
def test_unfilter_undoes_every_filter(kinds):
    samples = np.random.default_rng(sum(kinds)).integers(0, 256, (6, 64), dtype=np.uint8)
    assert (media.unfilter(np.array(kinds, np.uint8), filtered(samples, kinds)) == samples).all()


@pytest.mark.parametrize("kind", [None, 0, 1, 2])
def test_round_trip(kind):
    samples = np.random.default_rng(1).integers(0, 256, (17, 64), dtype=np.uint8)
    data = media.encode(samples, kind)
    assert (media.decode(data) == samples).all()
    # a structure any reader knows
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (64, 17)


def test_damage_is_noticed():
    data = bytearray(media.encode(np.arange(640, dtype=np.int64).astype(np.uint8).reshape(10, 64)))
    for at in (0, 20, len(data) // 2, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(media.BadMedia):
            media.decode(bytes(bad))
    with pytest.raises(media.BadMedia):
        media.decode(bytes(data[:-12]))


def test_feature_is_the_cosine_transforms():
    samples = np.random.default_rng(2).integers(0, 256, (30, 64), dtype=np.uint8)
    y, x = np.arange(30), np.arange(64)
    low = np.array([[(samples * np.outer(np.cos(np.pi / 30 * (y + 0.5) * u), np.cos(np.pi / 64 * (x + 0.5) * v))).sum() for v in range(8)] for u in range(8)])
    bits = low.ravel() > np.median(low.ravel()[1:])
    bits[0] = False
    assert media.feature(samples) == np.packbits(bits).tobytes().hex()


def check(docs, rows):
    want = sorted((hashlib.sha256(p).hexdigest(), len(p), len((t or "").encode()), zlib.crc32(p[-64:])) for t in docs for p in [(t or "").encode() + b"\0" * ((-len((t or "").encode())) % 64 or (0 if t else 64))])
    assert sorted((r.payload_sha256, r.payload_bytes, r.n_bytes, r.tail_crc32) for r in rows) == want
    by = {}
    for r in rows:
        assert r.hash.hex() == r.feature and media.decode(r.media).size == r.payload_bytes
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert by.setdefault(r.payload_sha256, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_rows(spark, data, nasty, nothing):
    docs = spark.read.parquet(f"{data}/sf0.001/documents.parquet")
    check([r.text for r in docs.collect()], media.stored(docs).collect())
    check([r.text for r in nasty.collect()], media.stored(nasty).collect())
    assert media.stored(nothing).count() == 0


def test_damaged_column_is_noticed(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    bad = media.encoded(docs).selectExpr("doc_id", "n_bytes", "unhex(concat(substr(hex(media), 1, 90), '00', substr(hex(media), 93))) AS media")
    with pytest.raises(Exception, match="BadMedia"):
        media.described(bad).collect()

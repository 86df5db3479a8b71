from __future__ import annotations

import hashlib
import io
import zlib

import numpy as np
import pytest
from edge import ODD, documents

from terravane.llm import media


def test_text_features(spark):
    rows = media.text_features(documents(spark, ODD)).collect()
    want = []
    for d, t in ODD:
        raw = (t or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = b"P5\n64 %d\n255\n" % (len(padded) // 64) + padded
        want.append((str(d), len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(stored), hashlib.sha256(stored).hexdigest()))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        assert by.setdefault(r.payload_sha256, (r.feature, r.tile)) == (r.feature, r.tile) and len(r.feature) == 16
        assert np.load(io.BytesIO(r.tile)).shape == (16, 16)


def test_empty_table(spark):
    assert media.text_features(documents(spark, []).limit(0)).collect() == []


def test_codecs():
    r = np.random.default_rng(1)
    x = r.integers(0, 256, (5, 7), dtype=np.uint8)
    assert (media.decode(media.encode_pgm(x)) == x).all()
    assert (media.decode(media.encode_bmp(x)) == x).all()
    c = r.integers(0, 256, (2, 3, 3), dtype=np.uint8)
    assert (media.decode(b"P6 # note\n3 2\n255\n" + c.tobytes()) == c).all()
    assert (media.decode(b"P3\n3 2 255\n" + b" ".join(b"%d" % v for v in c.ravel())) == c).all()
    assert media.decode(b"P2 2 1 15\n0 15").tolist() == [[0, 255]]
    assert media.decode(b"P1 3 1\n1 0 1").tolist() == [[0, 255, 0]]
    assert media.decode(b"P4 3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P5 1 1 65535\n\xff\xff").tolist() == [[255]]


@pytest.mark.parametrize("bad", [b"", b"GIF89a", b"P5", b"P5 3 3 255\n12", b"BM123", b"P5 0 1 255\n", media.encode_bmp(np.zeros((4, 4), np.uint8))[:-1]])
def test_damaged(bad):
    with pytest.raises(ValueError):
        media.decode(bad)


def plain_resize(x, height, width):
    """Area means by overlaps, cell by cell."""
    h, w = x.shape
    out = np.zeros((height, width))
    for i in range(height):
        for j in range(width):
            a, b, c, d = i * h / height, (i + 1) * h / height, j * w / width, (j + 1) * w / width
            total = 0.0
            for y in range(h):
                for z in range(w):
                    total += x[y, z] * max(0, min(b, y + 1) - max(a, y)) * max(0, min(d, z + 1) - max(c, z))
            out[i, j] = total / ((b - a) * (d - c))
    return out


@pytest.mark.parametrize("shape", [(1, 64), (3, 5), (20, 64), (9, 8)])
def test_area_means(shape, monkeypatch):
    x = np.random.default_rng(2).integers(0, 256, shape, dtype=np.uint8)
    assert np.allclose(media.resize(x, 8, 9), plain_resize(x, 8, 9))
    monkeypatch.setattr(media, "BAND", 2)
    assert np.allclose(media.resize(x, 8, 9), plain_resize(x, 8, 9))


def test_features_of_images(spark):
    x = np.arange(256, dtype=np.uint8).reshape(16, 16)
    df = spark.createDataFrame([(1, bytearray(media.encode_pgm(x)), "k"), (2, bytearray(b"no image"), "k"), (3, None, "k"), (4, bytearray(media.encode_bmp(x)), "k")], "id long, media binary, feature string")
    got = {r.id: r for r in media.features(df, "media", "id").collect()}
    assert got[1].feature == "ffffffffffffffff" == got[4].feature and got[2].feature is None and got[3].tile is None and got[1].height == 16

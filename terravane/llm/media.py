"""Media columns: images as bytes, decoded to numpy arrays, with NPY tiles and difference hashes.

Netpbm (P1 to P6) and uncompressed BMP are decoded; samples are area-resized by integral images. Any bytes
can be stored losslessly as grey samples of a PGM image.

Edge cases: a null or empty payload is stored as one row of zero samples; equal payloads give equal media and
features, whatever their ids; payloads of any length are stored whole; repeated rows give repeated
results; an empty table gives an empty result; further columns are ignored; bytes that are no image, or
damaged, raise ValueError in decode() and give null features in features().
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rows whose column sums are held at once.
BAND = 1 << 14
_word = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """A grey image (height, width) of 8-bit samples."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """The same as a BMP with a grey palette."""
    h, w = samples.shape
    row = (w + 3) // 4 * 4
    body = np.zeros((h, row), np.uint8)
    body[:, :w] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    at = 14 + 40 + 1024
    return struct.pack("<2sIHHI", b"BM", at + body.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, body.size, 2835, 2835, 256, 0) + palette.tobytes() + body.tobytes()


def _netpbm(b: bytes) -> np.ndarray:
    kind, at = int(chr(b[1])), 2
    sizes = []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _word.match(b, at)
        if not m:
            raise ValueError("the header ends early")
        sizes.append(int(m[1]))
        at = m.end()
    w, h, most = (*sizes, 1)[:3]
    if w < 1 or h < 1 or not 0 < most < 65536:
        raise ValueError("bad sizes")
    planes = 3 if kind in (3, 6) else 1
    n = w * h * planes
    if kind == 1:
        x = np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", b[at:])[:n], np.uint8) - 48
    elif kind < 4:
        x = np.array(re.sub(rb"#[^\n]*", b"", b[at:]).split()[:n], np.int64)
    elif kind == 4:
        row = (w + 7) // 8
        if len(b) < at + 1 + row * h:
            raise ValueError("samples are missing")
        x = np.unpackbits(np.frombuffer(b, np.uint8, row * h, at + 1).reshape(h, row), axis=1)[:, :w].ravel()
    else:
        width = 1 + (most > 255)
        if len(b) < at + 1 + n * width:
            raise ValueError("samples are missing")
        x = np.frombuffer(b, ">u2" if width == 2 else np.uint8, n, at + 1)
    if len(x) < n:
        raise ValueError("samples are missing")
    if kind in (1, 4):
        x = (1 - x) * 255
    elif most != 255:
        x = (x.astype(np.int64) * 255 + most // 2) // most
    return np.clip(x, 0, 255).astype(np.uint8).reshape((h, w, 3) if planes == 3 else (h, w))


def _bmp(b: bytes) -> np.ndarray:
    if len(b) < 54:
        raise ValueError("the header ends early")
    at, size, w, h, _, bits, packed = struct.unpack_from("<I I i i H H I", b, 10)
    if packed or bits not in (8, 24, 32) or w < 1 or h == 0:
        raise ValueError("only uncompressed images of 8, 24 or 32 bits are read")
    row = (w * bits // 8 + 3) // 4 * 4
    if len(b) < at + row * abs(h):
        raise ValueError("samples are missing")
    x = np.frombuffer(b, np.uint8, row * abs(h), at).reshape(abs(h), row)[:, : w * bits // 8]
    x = x[::-1] if h > 0 else x
    if bits == 8:
        n = struct.unpack_from("<I", b, 46)[0] or 256
        palette = np.zeros((256, 3), np.uint8)
        palette[:n] = np.frombuffer(b, np.uint8, 4 * n, 14 + size).reshape(n, 4)[:, 2::-1]
        if (palette == palette[:, :1]).all():
            return palette[:, 0][x]
        return palette[x]
    return x.reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def decode(b: bytes) -> np.ndarray:
    """(height, width) of grey or (height, width, 3) of colour samples, 8 bits each."""
    if b[:2] == b"BM":
        return _bmp(b)
    if len(b) > 2 and b[:1] == b"P" and b[1:2] in b"123456":
        return _netpbm(b)
    raise ValueError("neither Netpbm nor BMP")


def grey(x: np.ndarray) -> np.ndarray:
    return x if x.ndim == 2 else ((x.astype(np.uint32) * np.array([299, 587, 114], np.uint32)).sum(axis=2) // 1000).astype(np.uint8)


def _at(sums: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Running sums (first row zero) between their rows, in proportion."""
    low = np.minimum(edges.astype(np.int64), len(sums) - 2)
    part = (edges - low)[:, None]
    return sums[low] * (1 - part) + sums[low + 1] * part


def resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means of a grey image, from its integral image, of which only the wanted columns are kept."""
    h, w = x.shape
    columns = np.zeros((h + 1, width + 1))
    edges = np.arange(width + 1) * (w / width)
    for k in range(0, h, BAND):
        sums = np.zeros((w + 1, len(x[k : k + BAND])), np.int64)
        np.cumsum(x[k : k + BAND].T, axis=0, dtype=np.int64, out=sums[1:])
        columns[k + 1 : k + BAND + 1] = _at(sums, edges).T
    integral = _at(np.cumsum(columns, axis=0), np.arange(height + 1) * (h / height))
    return np.diff(np.diff(integral, axis=0), axis=1) / ((h / height) * (w / width))


def difference_hash(x: np.ndarray) -> str:
    """64 bits: is each of 8 by 8 area means less than its right neighbour."""
    small = np.round(resize(x, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(x: np.ndarray, size: int = 16) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(resize(x, size, size)), 0, 255).astype(np.uint8))
    return out.getvalue()


def features(media: DataFrame, column: str = "media", *keep: str) -> DataFrame:
    """keep, height, width, tile (NPY) and feature (difference hash) of images in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(b.num_columns - 1):
                try:
                    x = grey(decode(m.as_py() or b""))
                    rows.append((x.shape[0], x.shape[1], npy_tile(x), difference_hash(x)))
                except (ValueError, struct.error):
                    rows.append((None,) * 4)
            made = [pa.array(x, k) for x, k in zip(zip(*rows) if rows else [()] * 4, (pa.int32(), pa.int32(), pa.binary(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [*b.schema.names[:-1], "height", "width", "tile", "feature"])

    slim = media.select(*keep, F.col(column).alias("__media"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{schema + ', ' if schema else ''}height int, width int, tile binary, feature string")


def padded(b: bytes, unit: int = 64) -> bytes:
    return b + bytes(max(unit, -(-len(b) // unit) * unit) - len(b))


def text_media(docs: DataFrame, width: int = 64) -> DataFrame:
    """doc_id, n_bytes and media: every text's UTF-8 bytes as a grey image, written to the shared folder and read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, media = [], []
            for t in b.column(1):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                size.append(len(raw))
                media.append(encode_pgm(np.frombuffer(padded(raw, width), np.uint8).reshape(-1, width)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")
    return stored(made, "media", compression="zstd")


def text_features(docs: DataFrame, width: int = 64) -> DataFrame:
    """What the stored media give when they are read back: digests of payload and media, tile and feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for b in batches:
            rows = []
            for m in b.column(2):
                media = m.as_py()
                x = decode(media)
                payload = x.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(x), npy_tile(x)))
            made = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"
    return text_media(docs, width).mapInArrow(run, schema)

"""Media columns: Netpbm and BMP images as numpy arrays, resized by area, as NPY tiles with hashes.

Decoders take Netpbm (PBM, PGM and PPM, raw and plain, with comments, samples of 8 or 16 bits
scaled to 8) and uncompressed 8- and 24-bit BMP. The resize is the exact mean over each target cell's area, from an integral image
with bilinear reading at fractional borders. The difference hash compares horizontal neighbours.

Null media give null columns; bytes that no decoder takes raise ValueError in the functions
and give a null feature and no tiles in media_features(). Repeated rows and extra columns
change nothing. An empty table gives an empty one.
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
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, column, documents, drop, slices, written

WIDTH, THUMB, TILE = 64, 16, 8
# A number of a Netpbm header, after white space and comments.
NUMBER = re.compile(rb"(?:\s+|#[^\r\n]*[\r\n])+(\d{1,9})")


def encode_netpbm(a: np.ndarray) -> bytes:
    """uint8 array, (h, w) as P5 or (h, w, 3) as P6."""
    h, w = a.shape[:2]
    return f"P{5 if a.ndim == 2 else 6}\n{w} {h}\n255\n".encode() + np.ascontiguousarray(a, np.uint8).tobytes()


def encode_bmp(a: np.ndarray) -> bytes:
    """uint8 array, (h, w) with a grey palette or (h, w, 3) as BGR; rows bottom-up, padded to 4 bytes."""
    h, w = a.shape[:2]
    rows = a[::-1].reshape(h, -1) if a.ndim == 2 else a[::-1, :, ::-1].reshape(h, -1)
    body = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4))).tobytes()
    palette = b"" if a.ndim == 3 else b"".join(bytes((i, i, i, 0)) for i in range(256))
    at = 54 + len(palette)
    return struct.pack("<2sIHHI", b"BM", at + len(body), 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if a.ndim == 2 else 24, 0, len(body), 2835, 2835, len(palette) // 4, 0) + palette + body


def decode(media: bytes) -> np.ndarray:
    """The image as uint8, (h, w) or (h, w, 3)."""
    if media[:2] == b"BM":
        return _bmp(media)
    return _netpbm(media)


def _netpbm(media: bytes) -> np.ndarray:
    kind, at, numbers = media[:2], 2, []
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ValueError("neither Netpbm nor BMP")
    bits, plain = kind in (b"P1", b"P4"), kind in (b"P1", b"P2", b"P3")
    for _ in range(2 if bits else 3):
        m = NUMBER.match(media, at)
        if not m:
            raise ValueError("broken Netpbm header")
        numbers.append(int(m[1]))
        at = m.end()
    # One white space ends the header; a comment may stand before it.
    m = re.compile(rb"(?:#[^\r\n]*)?\s").match(media, at)
    if not m and at < len(media):
        raise ValueError("broken Netpbm header")
    at = m.end() if m else at
    w, h = numbers[:2]
    most = 1 if bits else numbers[2]
    if not 1 <= most <= 65535:
        raise ValueError("the largest sample must lie in 1..65535")
    colours = 3 if kind in (b"P3", b"P6") else 1
    n = w * h * colours
    if plain:
        body = re.sub(rb"#[^\r\n]*", b" ", media[at:])
        words = [body[i : i + 1] for i in range(len(body)) if not body[i : i + 1].isspace()] if bits else body.split()
        if len(words) < n or not all(x.isdigit() and len(x) < 10 for x in words[:n]):
            raise ValueError("a plain raster holds other than its samples")
        a = np.array([int(x) for x in words[:n]], np.int64)
    elif bits:
        a = np.unpackbits(np.frombuffer(media, np.uint8, (w + 7) // 8 * h, at).reshape(h, -1), axis=1)[:, :w].ravel() if n else np.zeros(0, np.uint8)
    else:
        a = np.frombuffer(media, np.uint8 if most < 256 else ">u2", n, at)
    if n and a.max() > most:
        raise ValueError("a sample is over the largest")
    if bits:
        a = 1 - a
    a = a.astype(np.uint8) if most == 255 else ((a.astype(np.int64) * 255 + most // 2) // most).astype(np.uint8)
    return a.reshape((h, w, 3) if colours == 3 else (h, w))


def _bmp(media: bytes) -> np.ndarray:
    at, size, w, h = struct.unpack_from("<IIii", media, 10)
    bits, packed = struct.unpack_from("<HI", media, 28)
    if packed or bits not in (8, 24):
        raise ValueError("only uncompressed 8- and 24-bit BMP")
    if w <= 0 or h == 0:
        raise ValueError("a BMP without pixels")
    row = (w * bits // 8 + 3) // 4 * 4
    a = np.frombuffer(media, np.uint8, row * abs(h), at).reshape(abs(h), row)[:, : w * bits // 8]
    a = a[::-1] if h > 0 else a
    if bits == 24:
        return a.reshape(abs(h), w, 3)[:, :, ::-1].copy()
    palette = np.frombuffer(media, np.uint8, at - 14 - size, 14 + size).reshape(-1, 4)[:, 2::-1]
    if a.max() >= len(palette):
        raise ValueError("a pixel beyond the palette")
    rgb = palette[a]
    return rgb[:, :, 0].copy() if (palette == palette[:, :1]).all() else rgb


def area_resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the areas of a height x width grid laid over the image, as float64."""
    if a.ndim == 3:
        return np.stack([area_resize(a[:, :, k], height, width) for k in range(a.shape[2])], axis=2)
    h, w = a.shape
    integral = np.zeros((h + 1, w + 1), np.float64)
    np.cumsum(np.cumsum(a, axis=0, dtype=np.float64), axis=1, out=integral[1:, 1:])

    def at(size: int, cells: int):
        x = np.arange(cells + 1) * size / cells
        lo = np.minimum(x.astype(np.int64), size - 1)
        return lo, x - lo

    y, fy = at(h, height)
    x, fx = at(w, width)
    rows = integral[y] * (1 - fy)[:, None] + integral[y + 1] * fy[:, None]
    grid = rows[:, x] * (1 - fx) + rows[:, x + 1] * fx
    return np.diff(np.diff(grid, axis=0), axis=1) * (height * width / (h * w))


def grey(a: np.ndarray) -> np.ndarray:
    return a if a.ndim == 2 else (a @ np.array([299, 587, 114]) + 500) // 1000


def difference_hash(a: np.ndarray) -> str:
    """16 hex digits: in an 8 x 9 resize, whether each cell is darker than its right neighbour."""
    small = np.round(area_resize(grey(a), 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(a: np.ndarray) -> bytes:
    f = io.BytesIO()
    np.save(f, a, allow_pickle=False)
    return f.getvalue()


def tiles(a: np.ndarray, thumb: int = THUMB, tile: int = TILE) -> list[bytes]:
    """The thumb x thumb resize, rounded to uint8, as NPY files of tile x tile, row by row."""
    small = np.clip(np.rint(area_resize(a, thumb, thumb)), 0, 255).astype(np.uint8)
    return [npy(small[y : y + tile, x : x + tile]) for y in range(0, thumb, tile) for x in range(0, thumb, tile)]


def text_payload(text: str | None) -> tuple[int, bytes]:
    """A text's UTF-8 length, and the text padded with bytes 0 to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0")


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a P5 image of 64 columns."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [text_payload(t) for t in column(b, "text")]
            yield arrow([column(b, "doc_id"), [n for n, _ in got], [encode_netpbm(np.frombuffer(p, np.uint8).reshape(-1, WIDTH)) for _, p in got]], schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame, keys: list[str], column_name: str = "media") -> DataFrame:
    """keys, then width, height, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, tiles."""
    kinds = {"width": pa.int32(), "height": pa.int32(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "tiles": pa.list_(pa.binary())}

    def one(m: bytes | None) -> tuple:
        if m is None:
            return (None,) * len(kinds)
        stored = len(m), hashlib.sha256(m).hexdigest()
        try:
            a = decode(m)
        except (ValueError, struct.error):
            return None, None, None, None, None, *stored, None, None
        p = a.tobytes()
        feature, t = (difference_hash(a), tiles(a)) if a.size else (None, None)
        return a.shape[1], a.shape[0], len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), *stored, feature, t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = list(zip(*map(one, column(b, "_media"))))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keys))] + [pa.array(c, k) for c, k in zip(got, kinds.values())], names=[*keys, *kinds])

    types = dict(media.dtypes)
    return media.select(*keys, F.col(column_name).alias("_media")).mapInArrow(
        run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tiles array<binary>"
    )


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are stored as images in a table, read back, decoded, and their tiles and hashes stored too."""
    stored = written(text_media(documents(spark, sf_dir)), "media")
    features = written(media_features(stored, ["doc_id", "n_bytes"]), "tiles")
    drop(stored)
    return features.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", F.size("tiles").alias("n_tiles"))

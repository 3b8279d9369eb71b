"""Media columns: Netpbm and BMP images as numpy arrays, area resizing, NPY tiles and difference hashes.

Images stay binary columns of tables. Each image is decoded, resized and hashed inside one Arrow batch of a task, so
memory is bounded by the batch and nothing is shuffled.

Edge cases: a null text counts as the empty one (one row of spaces); bytes that are no image, or a damaged one, give
null features; samples of other depths are scaled to 8 or 16 bits; repeated rows give repeated results; very long texts
are images of many rows, one at a time in memory beside their batch; an empty table gives an empty result; columns
besides id and content are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import io
import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, table, whole_text, written

#: Pixels in a row of an image that carries a payload: 64 RGB pixels are 192 bytes, a multiple of four as BMP needs.
WIDTH = 64
ROW = WIDTH * 3
#: Tile edge in pixels.
TILE = 8
SLICE = 256


# ---- containers ----

def write_netpbm(pixels: np.ndarray) -> bytes:
    """8-bit samples as a binary Netpbm file: P5 for (h, w), P6 for (h, w, 3)."""
    h, w = pixels.shape[:2]
    return b"P%d\n%d %d\n255\n" % (5 if pixels.ndim == 2 else 6, w, h) + pixels.tobytes()


def write_bmp(pixels: np.ndarray) -> bytes:
    """(h, w, 3) RGB samples as an uncompressed 24-bit BMP: rows bottom-up, blue first, padded to four bytes."""
    h, w = pixels.shape[:2]
    row = -(-w * 3 // 4) * 4
    body = np.zeros((h, row), dtype=np.uint8)
    body[:, : w * 3] = pixels[::-1, :, ::-1].reshape(h, w * 3)
    size = 54 + body.size
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", size, 0, 0, 54, 40, w, h, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


_token = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])*([^\s#]+)")


def _scaled(samples: np.ndarray, top: int) -> np.ndarray:
    """Samples from 0 to top as 0 to 255 in 8 bits, or 0 to 65535 in 16 where top is over 255."""
    if not 0 < top < 1 << 16 or samples.min(initial=0) < 0 or samples.max(initial=0) > top:
        raise ValueError("samples beyond their maximum")
    full = 65535 if top > 255 else 255
    return samples.astype(np.uint16 if top > 255 else np.uint8) if top == full else ((samples.astype(np.int64) * full + top // 2) // top).astype(np.uint16 if top > 255 else np.uint8)


def read_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as samples of 8 or 16 bits: (h, w), or (h, w, 3) for colour. A set bit of a bitmap is black, 0."""
    kind, at, head = int(data[1:2]), 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _token.match(data, at)
        if m is None:
            raise ValueError("a Netpbm header ends early")
        head.append(int(m[1]))
        at = m.end()
    w, h, top = (*head, 1)[:3] if kind in (1, 4) else head
    shape = (h, w, 3) if kind in (3, 6) else (h, w)
    n = math.prod(shape)
    if min(shape) < 1 or n > 8 * len(data):
        raise ValueError("the samples are cut off")
    if kind in (2, 3):
        text = re.sub(rb"#[^\r\n]*", b"", data[at:])
        return _scaled(np.array([int(x) for x in text.split()[:n]], np.int64).reshape(shape), top)
    if kind == 1:
        bits = re.sub(rb"#[^\r\n]*|\s", b"", data[at:])[:n]
        return np.where(np.frombuffer(bits, np.uint8) == 49, 0, 255).astype(np.uint8).reshape(shape)
    at += 1  # one white space ends the header
    if kind == 4:
        packed = np.frombuffer(data, np.uint8, h * -(-w // 8), at).reshape(h, -1)
        return np.where(np.unpackbits(packed, axis=1)[:, :w] == 1, 0, 255).astype(np.uint8)
    return _scaled(np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at).reshape(shape), top)


def read_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 16, 24 or 32 bits a pixel, also with masks of bits, as (h, w, 3) RGB samples."""
    start, head = struct.unpack_from("<II", data, 10)
    if head == 12:
        w, h, _, bits = struct.unpack_from("<HHHH", data, 18)
        packing, entry = 0, 3
    else:
        w, h, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
        entry = 4
    if bits not in (8, 16, 24, 32) or packing not in ((0, 3) if bits in (16, 32) else (0,)) or w < 1 or not h:
        raise ValueError("this kind of BMP isn't read")
    row = -(-w * bits // 32) * 4
    body = np.frombuffer(data, np.uint8, abs(h) * row, start).reshape(abs(h), row)[:, : w * bits // 8]
    if bits == 8:
        colours = (start - 14 - head) // entry
        palette = np.frombuffer(data, np.uint8, colours * entry, 14 + head).reshape(colours, entry)
        pixels = palette[body][:, :, 2::-1]
    elif bits == 24:
        pixels = body.reshape(abs(h), w, 3)[:, :, ::-1]
    else:
        masks = struct.unpack_from("<III", data, 54) if packing == 3 else (0x7C00, 0x3E0, 0x1F) if bits == 16 else (0xFF0000, 0xFF00, 0xFF)
        if not all(masks):
            raise ValueError("a colour has no bits")
        words = np.ascontiguousarray(body).view(f"<u{bits // 8}").astype(np.int64)
        pixels = np.stack([(words & m) // (m & -m) * 255 // (m // (m & -m)) for m in masks], axis=2).astype(np.uint8)
    return pixels[::-1] if h > 0 else pixels


def decode_image(data: bytes | None) -> np.ndarray | None:
    """The pixels of a Netpbm or BMP file; None if it is neither or damaged."""
    try:
        if data and data[:2] == b"BM":
            return read_bmp(data)
        if data and re.match(rb"P[1-6]\s", data):
            return read_netpbm(data)
    except (ValueError, struct.error, IndexError, OverflowError):
        pass
    return None


# ---- features ----

def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each target pixel is the mean over its area, with fractions of pixels at its edges.

    The integral image holds the sums over all rectangles from the origin. Between its whole positions it is linear
    along each axis, so reading it at fractional edges gives exact area sums, and four reads give one pixel.
    """
    h, w = pixels.shape[:2]
    sums = np.zeros((h + 1, w + 1, *pixels.shape[2:]))
    np.cumsum(np.cumsum(pixels, axis=0, dtype=np.float64), axis=1, out=sums[1:, 1:])

    def at_edges(a: np.ndarray, n: int, axis: int) -> np.ndarray:
        edges = np.linspace(0, a.shape[axis] - 1, n + 1)
        low = np.minimum(edges.astype(np.int64), a.shape[axis] - 2)
        part = (edges - low).reshape([-1 if i == axis else 1 for i in range(a.ndim)])
        first = a.take(low, axis)
        return first + part * (a.take(low + 1, axis) - first)

    cells = np.diff(np.diff(at_edges(at_edges(sums, height, 0), width, 1), axis=0), axis=1)
    return cells * (height * width / (h * w))


def grey(pixels: np.ndarray) -> np.ndarray:
    """Brightness by the Rec. 601 weights."""
    return pixels if pixels.ndim == 2 else pixels @ np.array([0.299, 0.587, 0.114])


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits, one for each step to the right in a 9 by 8 resized image: 1 where it gets brighter."""
    small = grey(area_resize(pixels, 8, 9))
    return np.packbits((small[:, 1:] > small[:, :-1] + 1e-9).ravel()).tobytes().hex()


def npy_tile(pixels: np.ndarray, edge: int = TILE) -> bytes:
    """An edge by edge tile as a NPY file of 8-bit samples."""
    out = io.BytesIO()
    np.save(out, np.rint(area_resize(pixels, edge, edge) / (257 if pixels.dtype.itemsize > 1 else 1)).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


# ---- DataFrame operators ----

def payload_of(text: str) -> bytes:
    """UTF-8, then spaces up to a positive multiple of 192 bytes."""
    data = text.encode("utf-8", "surrogatepass")
    return data + b" " * (max(ROW, -(-len(data) // ROW) * ROW) - len(data))


def texts_to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text as the samples of an image, BMP for an even number of rows, else Netpbm."""
    id_type = docs.schema[id_col].dataType

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                sizes, media = [], []
                for text in batch.column(1).to_pylist():
                    data = payload_of(text)
                    pixels = np.frombuffer(data, np.uint8).reshape(-1, WIDTH, 3)
                    sizes.append(len(text.encode("utf-8", "surrogatepass")))
                    media.append(write_netpbm(pixels) if len(pixels) % 2 else write_bmp(pixels))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    schema = f"`{id_col}` {id_type.simpleString()}, n_bytes long, media binary"
    return docs.select(named(id_col).alias(id_col), whole_text(text_col).alias("text")).mapInArrow(store, schema)


def media_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Decodes each image; returns its id, what its samples and stored bytes are, its tile and its difference hash."""
    id_type = media.schema[id_col].dataType
    fields = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tile", pa.binary())]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                rows = []
                for data in batch.column(1).to_pylist():
                    pixels = decode_image(data)
                    if pixels is None or not pixels.size:
                        rows.append((None, None, None, None if data is None else len(data), None if data is None else hashlib.sha256(data).hexdigest(), None, None))
                        continue
                    payload = pixels.tobytes()
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(pixels), npy_tile(pixels)))
                columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True))], names=[id_col, *(n for n, _ in fields)])

    schema = f"`{id_col}` {id_type.simpleString()}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"
    return media.select(named(id_col).alias(id_col), named(media_col).alias("media")).mapInArrow(features, schema)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents stored as an image, read back and described; tile is a NPY file."""
    stored = written(texts_to_media(table(spark, sf_dir, "documents")).withColumnRenamed("n_bytes", "bytes_before"), "media")
    # the unpadded length travels beside the image, as an image of padded samples can't tell it
    both = stored.select(F.struct("doc_id", "bytes_before").alias("key"), "media")
    out = media_features(both, "key")
    return out.select(F.col("key.doc_id").alias("doc_id"), F.col("key.bytes_before").alias("n_bytes"), *(c for c in out.columns if c != "key"))

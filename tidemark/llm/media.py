"""Media columns: Netpbm and BMP files as numpy arrays, resized by area, written as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import texts


def read_netpbm(data: bytes) -> tuple[np.ndarray, int]:
    """(height, width) or (height, width, 3) samples of a PBM, PGM or PPM file, plain or raw, and the greatest that its
    header allows; bitmaps have 1 for white. A sample beyond that, or one that is no number, is an error."""
    kind = int(data[1:2]) if data[:1] == b"P" and data[1:2].isdigit() else 0
    gap = rb"(?:\s|#[^\n\r]*[\n\r])"
    head = re.match(rb"P[1-6]" + (rb"%b+(\d+)" % gap) * (2 if kind in (1, 4) else 3), data)
    if not head:
        raise ValueError("not a Netpbm file")
    width, height = int(head[1]), int(head[2])
    most = 1 if kind in (1, 4) else int(head[3])
    if not 0 < most < 1 << 16:
        raise ValueError("a greatest sample that Netpbm doesn't have")
    shape = (height, width, 3) if kind in (3, 6) else (height, width)
    n = height * width * (3 if kind in (3, 6) else 1)
    if kind == 1:  # digits may stand together
        found = list(re.sub(rb"#[^\n\r]*|\s", b"", data[head.end() :])[:n])
        body = np.array(found, np.int64) - 48
    elif kind in (2, 3):
        found = re.sub(rb"#[^\n\r]*", b"", data[head.end() :]).split()[:n]
        body = np.array([int(x) if x.isdigit() and len(x) < 10 else -1 for x in found], np.int64)
    elif kind == 4:
        line = -(-width // 8)
        body = np.unpackbits(np.frombuffer(data, np.uint8, height * line, head.end() + 1).reshape(height, line), axis=1)[:, :width].reshape(-1)
    else:
        body = np.frombuffer(data, ">u2" if most > 255 else np.uint8, n, head.end() + 1)
    if len(body) != n:
        raise ValueError("Netpbm file ends too soon")
    if n and (body.min() < 0 or body.max() > most):
        raise ValueError("a sample beyond the greatest one")
    return (1 - body if kind in (1, 4) else body).astype(np.uint16 if most > 255 else np.uint8).reshape(shape), most


def write_pgm(a: np.ndarray) -> bytes:
    """A raw PGM file of (height, width) bytes."""
    return b"P5\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + np.ascontiguousarray(a, np.uint8).tobytes()


def _channel(cells: np.ndarray, mask: int) -> np.ndarray:
    """What a mask's bits hold, spread over 0 to 255."""
    if not mask:
        return np.zeros(cells.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    return np.rint(((cells & np.uint32(mask)) >> np.uint32(low)) * (255.0 / (mask >> low))).astype(np.uint8)


def read_bmp(data: bytes) -> np.ndarray:
    """(height, width) or (height, width, 3) bytes of an uncompressed BMP of 1, 4, 8 (palette), 16, 24 or 32 bits, with its
    own masks if it has them; top line first."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP file")
    (start,), (size,) = struct.unpack_from("<I", data, 10), struct.unpack_from("<I", data, 14)
    width, height, _, depth, packing = struct.unpack_from("<iiHHI", data, 18)
    if size < 40 or width <= 0 or not height or depth not in (1, 4, 8, 16, 24, 32) or packing not in ((0, 3) if depth in (16, 32) else (0,)):
        raise ValueError("a BMP of a kind that isn't read")
    line, high = (width * depth + 31) // 32 * 4, abs(height)
    lines = np.frombuffer(data, np.uint8, line * high, start).reshape(high, line)
    if height > 0:
        lines = lines[::-1]
    if depth == 24:
        return np.ascontiguousarray(lines[:, : width * 3].reshape(high, width, 3)[:, :, ::-1])
    if depth > 8:
        masks = struct.unpack_from("<III", data, 54) if packing == 3 else ((0x7C00, 0x3E0, 0x1F) if depth == 16 else (0xFF0000, 0xFF00, 0xFF))
        cells = np.ascontiguousarray(lines[:, : width * depth // 8]).view("<u2" if depth == 16 else "<u4").astype(np.uint32)
        return np.stack([_channel(cells, m) for m in masks], axis=2)
    bits = np.unpackbits(lines, axis=1).reshape(high, -1, depth)[:, :width]
    places = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2)
    colours = np.frombuffer(data, np.uint8, (struct.unpack_from("<I", data, 46)[0] or 1 << depth) * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    picture = colours[places]
    return picture[:, :, 0] if (colours == colours[:, :1]).all() else picture


def picture(data: bytes) -> tuple[np.ndarray, int]:
    """Samples of a file of any kind that is read, and the greatest that they may be."""
    return (read_bmp(data), 255) if data[:2] == b"BM" else read_netpbm(data)


def decode(data: bytes) -> np.ndarray:
    return picture(data)[0]


def grey(a: np.ndarray) -> np.ndarray:
    return a if a.ndim == 2 else a @ np.array([0.299, 0.587, 0.114])


def resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean of the area under each new cell, by interpolated integral images, one axis after the other."""
    out = np.asarray(a, np.float64)
    for axis, n in ((0, height), (1, width)):
        size = out.shape[axis]
        total = np.concatenate([np.zeros_like(out.take([0], axis)), np.cumsum(out, axis)], axis)
        edges = np.arange(n + 1) * (size / n)
        low = np.minimum(edges.astype(np.int64), size - 1)
        part = (edges - low).reshape([-1 if i == axis else 1 for i in range(2)])
        sums = total.take(low, axis) * (1 - part) + total.take(low + 1, axis) * part
        out = np.diff(sums, axis=axis) / (size / n)
    return out


def difference_hash(a: np.ndarray) -> str:
    """16 hex digits: whether each of 8 x 9 cells is darker than the one to its right."""
    small = np.round(resize(grey(a), 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


TILES = "tile binary, height int, width int, feature string, error string"


def tiles(rows: DataFrame, id_col: str, media_col: str, side: int = 32) -> DataFrame:
    """One row per input row: id, an NPY tile of side x side grey bytes, the picture's size, its difference hash, error.

    Samples are spread from their own greatest value to 255. Null media give nulls and no error; media that can't be decoded
    give nulls and say why, and never fail the job. Repeated rows are each done; extra columns are left out; an empty table
    gives an empty result."""

    def made(batches):
        for batch in batches:
            out = []
            for x in batch.column("media"):
                try:
                    if x.as_py() is None:
                        out.append((None, None, None, None, None))
                        continue
                    a, most = picture(x.as_py())
                    if not a.size:
                        raise ValueError("no samples")
                    out.append((npy(np.clip(np.rint(resize(grey(a), side, side) * (255.0 / most)), 0, 255).astype(np.uint8)), a.shape[0], a.shape[1], difference_hash(a), None))
                except (ValueError, OverflowError, struct.error, IndexError) as e:
                    out.append((None, None, None, None, str(e)[:200]))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["id", "tile", "height", "width", "feature", "error"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(made, f"id {kind}, {TILES}").withColumnRenamed("id", id_col)


def stored(payload: bytes, width: int = 64) -> bytes:
    """A payload whose length is a multiple of width, as a raw PGM picture of that width: each byte is a sample."""
    return write_pgm(np.frombuffer(payload, np.uint8).reshape(-1, width))


def payload_of(text: bytes, unit: int = 64) -> bytes:
    return text.ljust(max(unit, -(-len(text) // unit) * unit), b"\0")


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string"


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", side: int = 32) -> DataFrame:
    """Stores each text's bytes as a PGM picture of 64 columns, reads that back and describes what it read.

    One row per input row; a null text counts as empty, and an empty one gives a line of 64 zero samples."""

    def made(batches):
        for batch in batches:
            out = []
            for text in texts(batch):
                media = stored(payload_of(text))
                a = decode(media)
                back = a.tobytes()
                tile = npy(np.clip(np.rint(resize(a, side, side)), 0, 255).astype(np.uint8))
                out.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(a), hashlib.sha256(tile).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * 8
            types = [pa.string() if "string" in x else pa.int64() for x in DIGEST.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["id", *(x.split()[0] for x in DIGEST.split(", "))])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(made, f"id {kind}, {DIGEST}").withColumnRenamed("id", id_col)

"""Media columns: Netpbm and BMP images decoded to numpy, resized by area, tiled and hashed.

Images are decoded to uint8 or uint16 arrays of (height, width) or (height, width, channels).
The area resize averages the source over each target cell, with fractional edges, from a
summed-area table that is built and read a block of rows at a time, so that a very tall image
never needs a table of its own size. A tile is the resized image as an NPY file; its difference
hash has a bit for each pair of horizontal neighbours.

Defined results: a null text or payload is stored as an empty one; null, truncated or unknown
media give null features and the reason in ``error``; equal payloads give equal rows, and rows
repeat as often as in the input. Columns of the input other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from karstmap.llm.common import by_batch, utf8

PAYLOAD_WIDTH = 64
BLOCK_ROWS = 1 << 14


def encode_netpbm(image: np.ndarray) -> bytes:
    """8- or 16-bit PGM (two axes) or PPM (three channels), binary form."""
    kind, top = (b"P5" if image.ndim == 2 else b"P6"), (255 if image.dtype == np.uint8 else 65535)
    head = kind + f"\n{image.shape[1]} {image.shape[0]}\n{top}\n".encode()
    return head + (image if top == 255 else image.astype(">u2")).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """8-bit grey BMP with a grey palette, or 24-bit colour, rows from the bottom up."""
    height, width = image.shape[:2]
    depth = 8 if image.ndim == 2 else 24
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if depth == 8 else b""
    line = width * depth // 8
    stride = (line + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :line] = (image if depth == 8 else image[:, :, ::-1]).reshape(height, line)[::-1]
    start = 54 + len(palette)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + rows.size, 0, 0, start, 40, width, height, 1, depth, 0, rows.size, 2835, 2835, len(palette) // 4, 0)
    return head + palette + rows.tobytes()


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """The numbers after the magic, skipping comments, and the place after the last one."""
    found: list[int] = []
    at = 2
    while len(found) < count:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("broken header")
        found.append(int(data[at:end]))
        at = end
    return found, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """PBM, PGM and PPM, plain and binary. PBM bits become 0 (black) and 255 (white)."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    bits, plain, channels = kind in (b"P1", b"P4"), kind < b"P4", 3 if kind in (b"P3", b"P6") else 1
    numbers, at = _header(data, 2 if bits else 3)
    width, height = numbers[:2]
    top = 1 if bits else numbers[2]
    if not 0 < top < 65536:
        raise ValueError("sample range")
    count = width * height * channels
    if plain:
        body = b"\n".join(line.split(b"#")[0] for line in data[at:].split(b"\n"))
        values = [int(chr(x)) for x in body if x in b"01"] if bits else [int(x) for x in body.split()]
        flat = np.array(values[:count], np.uint16 if top > 255 else np.uint8)
    elif bits:
        stride = (width + 7) // 8
        raw = np.frombuffer(data, np.uint8, offset=at + 1)[: stride * height]
        if raw.size < stride * height:
            raise ValueError("truncated")
        flat = np.unpackbits(raw.reshape(height, stride), axis=1)[:, :width].reshape(-1)
    else:
        kind_of = np.dtype(">u2" if top > 255 else np.uint8)
        if len(data) - at - 1 < count * kind_of.itemsize:
            raise ValueError("truncated")
        flat = np.frombuffer(data, kind_of, count, at + 1)
        flat = flat.astype(np.uint16) if top > 255 else flat
    if flat.size < count:
        raise ValueError("truncated")
    if bits:
        flat = np.where(flat, 0, 255).astype(np.uint8)
    return flat.reshape((height, width, 3) if channels == 3 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits; a grey palette gives two axes."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not BMP")
    start, size, width, height, _, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
    colours = struct.unpack_from("<I", data, 46)[0]
    if packing or depth not in (8, 24, 32) or width <= 0:
        raise ValueError("unsupported BMP")
    line, tall = width * depth // 8, abs(height)
    stride = (line + 3) // 4 * 4
    if len(data) < start + stride * tall:
        raise ValueError("truncated")
    rows = np.frombuffer(data, np.uint8, stride * tall, start).reshape(tall, stride)[:, :line]
    rows = rows[::-1] if height > 0 else rows
    if depth > 8:
        return np.ascontiguousarray(rows.reshape(tall, width, depth // 8)[:, :, 2::-1])
    palette = np.frombuffer(data, np.uint8, 4 * (colours or 256), 14 + size).reshape(-1, 4)[:, 2::-1]
    if (palette == palette[:, :1]).all():
        return palette[:, 0][rows]
    return palette[rows]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _cells(size: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole and fractional part of each cell's border on an axis of that many samples."""
    edge = np.arange(cells + 1) * size
    return edge // cells, (edge % cells) / cells


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source over each target cell, as float64 of the target's shape."""
    source = image.reshape(image.shape[0], image.shape[1], -1)
    tall, wide, channels = source.shape
    if not tall or not wide:
        raise ValueError("empty image")
    (y, fy), (x, fx) = _cells(tall, height), _cells(wide, width)
    need = np.unique(np.concatenate([y, np.minimum(y + 1, tall)]))
    kept = np.zeros((need.size, wide + 1, channels))
    above = np.zeros((wide + 1, channels))
    for top in range(0, tall, BLOCK_ROWS):
        block = np.zeros((min(BLOCK_ROWS, tall - top), wide + 1, channels))
        np.cumsum(source[top : top + BLOCK_ROWS], axis=1, dtype=np.float64, out=block[:, 1:])
        np.cumsum(block, axis=0, out=block)
        block += above
        first, last = np.searchsorted(need, [top + 1, top + len(block)], side="left")
        last += last < need.size and need[last] == top + len(block)
        kept[first:last] = block[need[first:last] - top - 1]
        above = block[-1].copy()
    at = np.searchsorted(need, y)
    below = np.searchsorted(need, np.minimum(y + 1, tall))
    lines = kept[at] + (kept[below] - kept[at]) * fy[:, None, None]
    right = np.minimum(x + 1, wide)
    corner = lines[:, x] + (lines[:, right] - lines[:, x]) * fx[None, :, None]
    total = corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]
    mean = total / (tall / height * (wide / width))
    return mean[:, :, 0] if image.ndim == 2 else mean


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of a colour image by the BT.601 weights; a grey image as it is."""
    return image if image.ndim == 2 else image[:, :, :3] @ np.array([0.299, 0.587, 0.114])


def npy_tile(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def difference_hash(tile: np.ndarray) -> str:
    """Hex of the bits 'darker than the right neighbour', row by row."""
    flat = grey(tile)
    return np.packbits(np.round(flat[:, :-1], 6) < np.round(flat[:, 1:], 6)).tobytes().hex()


def features(data: bytes, rows: int = 8, columns: int = 9) -> tuple[np.ndarray, bytes, str]:
    """The decoded image, its NPY tile of rows x columns and its difference hash."""
    image = decode(data)
    tile = area_resize(image, rows, columns)
    return image, npy_tile(np.clip(np.rint(tile), 0, 65535).astype(image.dtype)), difference_hash(tile)


def payload_of(text: bytes | None) -> bytes:
    """The bytes with zeros up to a positive multiple of PAYLOAD_WIDTH."""
    data = text or b""
    return data + b"\0" * (-len(data) % PAYLOAD_WIDTH or PAYLOAD_WIDTH * (not data))


def media_columns(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", rows: int = 8, columns: int = 9) -> DataFrame:
    """id_col, height, width, channels, tile_npy, feature and error of each image in media_col."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: list[tuple] = []
        for data in batch.column(media_col).to_pylist():
            try:
                if data is None:
                    raise ValueError("no media")
                image, tile, feature = features(data, rows, columns)
                found.append((*image.shape[:2], 1 if image.ndim == 2 else image.shape[2], tile, feature, None))
            except (ValueError, struct.error, IndexError) as e:
                found.append((None, None, None, None, None, str(e) or "broken media"))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.string()]
        out = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(id_col), *out], [id_col, "height", "width", "channels", "tile_npy", "feature", "error"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, media_col).mapInArrow(by_batch(run), f"`{id_col}` {kind}, height long, width long, channels int, tile_npy binary, feature string, error string")


def stored_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", form: str = "pgm", rows: int = 8, columns: int = 9) -> DataFrame:
    """Each text stored as an 8-bit grey image of PAYLOAD_WIDTH columns (form: pgm or bmp), read back, measured and hashed."""
    encode = {"pgm": encode_netpbm, "bmp": encode_bmp}[form]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: list[tuple] = []
        for text in utf8(batch, text_col):
            media = encode(np.frombuffer(payload_of(text), np.uint8).reshape(-1, PAYLOAD_WIDTH))
            image, tile, feature = features(media, rows, columns)
            back = image.tobytes()
            found.append((len(text or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, tile))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        out = [pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(id_col), *out], [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_npy"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(by_batch(run), f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_npy binary")

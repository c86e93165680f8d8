"""Bit strings: columns of up to 62 bits, numpy arrays of any length and cells of 1 to 32 bits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def bit(code: Column, length: Column, place: Column) -> Column:
    """Bit at a place from the left of a code of that length."""
    return F.getbit(code, (length - 1 - place).cast("int"))


def rendered(code: Column, length: Column) -> Column:
    """A code as 0s and 1s, the most significant bit first."""
    return F.lpad(F.bin(code), length.cast("int"), "0")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pack_bits(bits: np.ndarray) -> bytes:
    return np.packbits(bits.astype(np.uint8)).tobytes()


def unpack_bits(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=count)


def pack_cells(values: np.ndarray, width: int) -> bytes:
    """Cells of width bits, the least significant bit first."""
    shifts = np.arange(width, dtype=np.uint64)
    return np.packbits(((values.astype(np.uint64)[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_cells(data: bytes, width: int, count: int) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=width * count, bitorder="little").reshape(count, width)
    return flat.astype(np.uint64) @ (np.uint64(1) << np.arange(width, dtype=np.uint64))

"""Hashes of keys: md5 ones that any SQL engine repeats, and mixers for numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def as_text(key: str | Column) -> Column:
    """A key column as text; binary keys are read as UTF-8, so a text and its bytes are one key."""
    return (F.col(key) if isinstance(key, str) else key).cast("string")


def signature(key: str | Column, seed: int = 0) -> Column:
    """The 128-bit signature of a key as hex."""
    return F.md5(F.concat(F.lit(f"{seed}:"), as_text(key)))


def word(sig: Column, part: int) -> Column:
    """One of the four 32-bit words of a signature as a number."""
    return F.conv(F.substring(sig, 8 * part + 1, 8), 16, 10).cast("bigint")


def scaled(hash32: Column, size: Column | int) -> Column:
    """A 32-bit hash scaled to 0 .. size - 1."""
    return F.shiftright(hash32 * (F.lit(size) if isinstance(size, int) else size).cast("bigint"), 32)


def bucket_of(key: str | Column, buckets: Column | int, seed: int = 0) -> Column:
    return scaled(word(signature(key, seed), 0), buckets)


def bloom_places(key: str | Column, bits: int, hashes: int, seed: int = 1) -> Column:
    """The places of a key in a Bloom filter: (a + i * b) mod bits of two words of its signature, b odd."""
    size = F.lit(bits).cast("bigint")

    def places(w: Column) -> Column:
        odd = w["b"].bitwiseOR(F.lit(1).cast("bigint"))
        return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(w["a"] + i.cast("bigint") * odd, size))

    def words(sig: Column) -> Column:
        return F.struct(word(sig, 0).alias("a"), word(sig, 1).alias("b"))

    # an expression inside a lambda is worked out at each call, so signature and words are bound first
    bound = F.transform(F.array(signature(key, seed)), words)
    return F.element_at(F.transform(bound, places), 1)


def wide(key: str | Column) -> list[Column]:
    """Two 64-bit hashes of a key, for the compact tier."""
    return [F.xxhash64(as_text(key)).alias("h1"), F.xxhash64(F.lit("k"), as_text(key)).alias("h2")]


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer of unsigned numbers with a seed."""
    x = x + np.uint64((seed + 1) * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spread(x: np.ndarray, size: int) -> np.ndarray:
    """The upper 32 bits scaled to 0 .. size - 1."""
    return (((x >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)

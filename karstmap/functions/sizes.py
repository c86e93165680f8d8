"""Sizing rules of buckets, solutions and filters, for numbers and, where a rule is needed on rows, for columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values that results depend on.
EXPANSION = 1.089
EQUATIONS_PER_BUCKET = 3500
XOR_OVERHEAD, XOR_EXTRA = 1.23, 32
FUSE_OVERHEAD, FUSE_ARITY, FUSE_LEAST_KEYS = 1.075, 4, 11
BUCKET_METADATA_BYTES = 17


def target_buckets(equations: Column, keys: Column) -> Column:
    """About EQUATIONS_PER_BUCKET equations each, but 100 to 1000 keys."""
    whole = lambda c, by: F.floor(c / by).cast("bigint")
    return F.least(F.greatest(whole(equations, EQUATIONS_PER_BUCKET), whole(keys, 1000) + 1), whole(keys, 100) + 1)


def packed_buckets(equations: Column, keys: Column) -> Column:
    """The same for packed rows, which have no upper bound."""
    whole = lambda c, by: F.floor(c / by).cast("bigint")
    return F.greatest(whole(equations, EQUATIONS_PER_BUCKET), whole(keys, 1000) + 1)


def solution_bits(equations: Column, longest: Column) -> Column:
    return (F.ceil(equations * F.lit(EXPANSION)) + longest).cast("bigint")


def xor_cells(keys: int) -> int:
    return XOR_EXTRA + int(XOR_OVERHEAD * keys)


def fuse_factor(keys: int) -> float:
    """Cells for each key of a four-wise binary fuse filter."""
    return FUSE_OVERHEAD if keys <= 1 else max(FUSE_OVERHEAD, 0.77 + 0.305 * math.log(600_000) / math.log(keys))


def fuse_layout(keys: int) -> tuple[int, int, int]:
    """Segment length, segments that a key may begin in, and cells."""
    length = min(1 << max(0, math.floor(math.log(keys) / math.log(2.91) - 0.5)), 1 << 18)
    cells = int(keys * fuse_factor(max(keys, 2)))
    begins = max(1, -(-cells // length) - (FUSE_ARITY - 1))
    return length, begins, (begins + FUSE_ARITY - 1) * length


def fingerprint_bits(error_rate: float) -> int:
    """Bits that keep false positives under the rate; 8 for a rate that isn't between 0 and 1."""
    return max(1, min(32, math.ceil(-math.log2(error_rate)))) if 0 < error_rate < 1 else 8


def bloom_size(keys: int, error_rate: float) -> tuple[int, int]:
    """Bits and hashes of a Bloom filter tuned to an error rate."""
    bits = max(1, math.ceil(math.log2(math.e) ** 2 * math.log2(1 / error_rate) * keys))
    return bits, best_hashes(bits, keys)


def best_hashes(bits: int, keys: int) -> int:
    return round(bits * math.log(2) / max(1, keys))

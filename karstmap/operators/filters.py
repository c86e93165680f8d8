"""Membership prefilters: Bloom as a DataFrame, XOR and binary fuse as cells.

A Bloom filter's bits are md5 places, so any engine can check them; membership is a column expression over
a broadcast of bounded size, or a join where the filter is larger. XOR and fuse filters are built by
peeling in numpy, a shard of at most about ``SHARD_KEYS`` keys at a time, so a filter of any size is
a table of shards. No filter has false negatives.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karstmap.functions.bits import pack_cells, unpack_cells
from karstmap.functions.hashing import as_text, bloom_places, mix, spread, wide
from karstmap.functions.sizes import FUSE_LEAST_KEYS, bloom_size, fuse_layout, xor_cells
from karstmap.sources import storage

SHARD_KEYS, ATTEMPTS = 50_000, 40
LITERAL_BITS = 1 << 23  #: a Bloom filter of at most 1 MB is a literal of the plan


@dataclass(frozen=True)
class FilterConfig:
    """Base of the prefilter configurations."""


@dataclass(frozen=True)
class AutoFilterConfig(FilterConfig):
    """The bound picks a filter or none."""


@dataclass(frozen=True)
class BloomFilterConfig(FilterConfig):
    bits_per_element: int = 10
    num_hashes: int = 7

    def __post_init__(self) -> None:
        if self.bits_per_element <= 0 or self.num_hashes <= 0:
            raise ValueError("bits_per_element and num_hashes must be positive")


@dataclass(frozen=True)
class _FingerprintConfig(FilterConfig):
    fingerprint_bits: int = 8

    def __post_init__(self) -> None:
        if not 1 <= self.fingerprint_bits <= 32:
            raise ValueError("fingerprint_bits must be from 1 to 32")


@dataclass(frozen=True)
class XORFilterConfig(_FingerprintConfig):
    pass


@dataclass(frozen=True)
class BinaryFuseFilterConfig(_FingerprintConfig):
    pass


class BloomFilter:
    """Bits at the md5 places of the keys."""

    kind = "bloom"

    def __init__(self, bits: DataFrame, size_bits: int, num_hashes: int, num_elements: int):
        self.bits, self.size_bits, self.num_hashes, self.num_elements = bits, size_bits, num_hashes, num_elements

    @classmethod
    def fixed(cls, keys: DataFrame, size_bits: int, num_hashes: int, key: str = "key", count: int | None = None) -> BloomFilter:
        """bits: the set places, one row each; count: how many keys, where that is known."""
        own = keys.select(F.explode(bloom_places(key, size_bits, num_hashes)).alias("bit")).distinct()
        return cls(own, size_bits, num_hashes, keys.count() if count is None else count)

    @classmethod
    def autotuned(cls, keys: DataFrame, error_rate: float, key: str = "key") -> BloomFilter:
        count = keys.count()
        size, hashes = bloom_size(count, error_rate)
        return cls.fixed(keys, size, max(1, hashes), key, count)

    @classmethod
    def of(cls, minority: DataFrame, config: BloomFilterConfig, key: str = "key") -> BloomFilter:
        count = minority.count()
        return cls.fixed(minority, max(1, config.bits_per_element * count), config.num_hashes, key, count)

    def words(self) -> DataFrame:
        """word and its 32 bits as a number."""
        shift = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("bit", F.lit(32)).cast("int"))
        return self.bits.groupBy(F.floor(F.col("bit") / 32).cast("bigint").alias("word")).agg(F.bit_or(shift).alias("bits"))

    def survivors(self, df: DataFrame, key: str = "key") -> DataFrame:
        """Rows whose key may be in the filter."""
        return self.marked(df, key).where("__in").drop("__in")

    def marked(self, df: DataFrame, key: str = "key", name: str = "__in") -> DataFrame:
        """df with a boolean: the key may be in the filter."""
        if self.size_bits <= LITERAL_BITS:
            return df.withColumn(name, self.contains(key))
        places = F.explode(F.array_distinct(bloom_places("__key", self.size_bits, self.num_hashes)))
        keys = df.select(F.col(key).alias("__key")).distinct()
        missing = keys.select("__key", places.alias("bit")).join(self.bits, "bit", "left_anti").select("__key").distinct().withColumn("__out", F.lit(True))
        return df.join(missing, df[key].eqNullSafe(missing["__key"]), "left").withColumn(name, F.col("__out").isNull()).drop("__key", "__out")

    def contains(self, key: str | Column) -> Column:
        """For filters of at most LITERAL_BITS bits: the test as an expression over the bits as a literal."""
        if self.size_bits > LITERAL_BITS:
            raise ValueError("the filter is too large for a literal; use marked()")
        words = [0] * -(-self.size_bits // 32)
        for row in self.words().collect():
            words[row["word"]] = row["bits"]
        held = F.from_json(F.lit(json.dumps(words)), "array<bigint>")  # folded into one array, whose elements are found at once
        return F.forall(bloom_places(key, self.size_bits, self.num_hashes), lambda p: F.getbit(F.element_at(held, (F.floor(p / 32) + 1).cast("int")), F.pmod(p, F.lit(32)).cast("int")) == 1)

    def stats(self) -> dict:
        return {"type": self.kind, "size_bytes": -(-self.size_bits // 8), "num_elements": self.num_elements, "num_hashes": self.num_hashes, "size_bits": self.size_bits, "fingerprint_bits": None}


def peel(places: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Keys and the free cell of each, in the order in which they come off; None if some never do.

    places holds each key's cells, with different ones in a row. All cells of degree one come off at
    once; a key that two of them hold is taken by one.
    """
    alive = np.ones(len(places), bool)
    flat, owner = places.ravel(), np.repeat(np.arange(len(places)), places.shape[1])
    degree = np.bincount(flat, minlength=cells)
    held = np.zeros(cells, np.int64)
    np.bitwise_xor.at(held, flat, owner)
    keys, at = [], []
    ready = np.flatnonzero(degree == 1)
    while ready.size:
        own = held[ready]
        own, first = np.unique(own, return_index=True)
        ready = ready[first]
        keys.append(own)
        at.append(ready)
        alive[own] = False
        gone = places[own].ravel()
        np.subtract.at(degree, gone, 1)
        np.bitwise_xor.at(held, gone, np.repeat(own, places.shape[1]))
        ready = np.unique(gone)
        ready = ready[degree[ready] == 1]
    if alive.any():
        return None
    return (np.concatenate(keys), np.concatenate(at)) if keys else (np.zeros(0, np.int64),) * 2


class Fingerprints:
    """A shard of an XOR or fuse filter: cells whose xor at a key's places is its fingerprint."""

    def __init__(self, kind: str, width: int, keys: int):
        self.kind, self.width, self.keys = kind, width, keys
        if kind == "xor":
            self.third = max(1, xor_cells(keys) // 3)
            self.cells = 3 * self.third
        else:
            self.length, self.begins, self.cells = fuse_layout(max(keys, 1))

    def places(self, h: np.ndarray, seed: int) -> np.ndarray:
        if self.kind == "xor":
            return np.stack([i * self.third + spread(mix(h, 8 * seed + i), self.third) for i in range(3)], axis=1)
        first = spread(mix(h, 8 * seed), self.begins)
        inside = [(mix(h, 8 * seed + 1 + i) & np.uint64(self.length - 1)).astype(np.int64) for i in range(4)]
        return np.stack([(first + i) * self.length + inside[i] for i in range(4)], axis=1)

    def marks(self, h: np.ndarray, seed: int) -> np.ndarray:
        return mix(h, 8 * seed + 7) & np.uint64((1 << self.width) - 1)

    def build(self, h: np.ndarray) -> tuple[int, bytes]:
        """Seed and cells for distinct 64-bit hashes."""
        for seed in range(ATTEMPTS):
            places = self.places(h, seed)
            if (order := peel(places, self.cells)) is not None:
                values, marks = np.zeros(self.cells, np.uint64), self.marks(h, seed)
                for key, cell in zip(order[0][::-1].tolist(), order[1][::-1].tolist(), strict=True):
                    values[cell] = marks[key] ^ np.bitwise_xor.reduce(values[places[key]]) ^ values[cell]
                return seed, pack_cells(values, self.width)
        raise RuntimeError(f"no {self.kind} filter found in {ATTEMPTS} attempts")

    def test(self, h: np.ndarray, seed: int, cells: bytes) -> np.ndarray:
        values = unpack_cells(cells, self.width, self.cells)
        return np.bitwise_xor.reduce(values[self.places(h, seed)], axis=1) == self.marks(h, seed)


class ShardedFilter:
    """shards: shard, keys, seed and cells; a key's shard comes from its first hash."""

    def __init__(self, shards: DataFrame, kind: str, width: int, count: int, num_elements: int):
        self.shards, self.kind, self.width, self.count, self.num_elements = shards, kind, width, count, num_elements

    @classmethod
    def of(cls, minority: DataFrame, config: FilterConfig, key: str = "key", shard_keys: int = SHARD_KEYS) -> ShardedFilter:
        kind, width = ("xor" if isinstance(config, XORFilterConfig) else "binary_fuse"), config.fingerprint_bits
        hashes = minority.select(*wide(key)).distinct()
        n = hashes.count()
        if kind == "binary_fuse" and 0 < n < FUSE_LEAST_KEYS:
            raise ValueError(f"a binary fuse filter needs none or at least {FUSE_LEAST_KEYS} keys")
        count = max(1, -(-n // shard_keys))

        def build(group: pa.Table) -> pa.Table:
            h = np.unique(np.asarray(group.column("h2")).astype(np.uint64))
            seed, cells = Fingerprints(kind, width, len(h)).build(h)
            return pa.table({"shard": group.column("shard")[:1].cast(pa.int64()), "keys": pa.array([len(h)], pa.int64()), "seed": pa.array([seed], pa.int32()), "cells": pa.array([cells], pa.binary())})

        sharded = hashes.withColumn("shard", F.pmod("h1", F.lit(count)).cast("bigint"))
        shards = sharded.groupBy("shard").applyInArrow(build, "shard bigint, keys bigint, seed int, cells binary").persist()
        return cls(shards, kind, width, count, n)

    def marked(self, df: DataFrame, key: str = "key", name: str = "__in") -> DataFrame:
        """df with a boolean: the key may be in the filter. Each shard meets the distinct keys of its own."""
        kind, width = self.kind, self.width

        def test(keys: pa.Table, shards: pa.Table) -> pa.Table:
            h = np.asarray(keys.column("h2")).astype(np.uint64)
            found = np.zeros(len(h), bool)
            if len(h) and len(shards):
                row = shards.slice(0, 1).to_pylist()[0]
                found = Fingerprints(kind, width, row["keys"]).test(h, row["seed"], row["cells"])
            return pa.table({"__text": keys.column("__text"), name: pa.array(found)})

        text = df.select(as_text(key).alias("__text")).where("__text is not null").distinct()
        keys = text.select("__text", *wide("__text")).withColumn("shard", F.pmod("h1", F.lit(self.count)).cast("bigint"))
        tested = keys.groupBy("shard").cogroup(self.shards.groupBy("shard")).applyInArrow(test, f"__text string, `{name}` boolean")
        return df.join(tested, as_text(df[key]) == tested["__text"], "left").drop("__text").withColumn(name, F.coalesce(name, F.lit(False)))

    def survivors(self, df: DataFrame, key: str = "key") -> DataFrame:
        return self.marked(df, key).where("__in").drop("__in")

    def stats(self) -> dict:
        size = self.shards.agg(F.coalesce(F.sum(F.octet_length("cells")), F.lit(0))).first()[0]
        return {"type": self.kind, "size_bytes": size, "num_elements": self.num_elements, "num_hashes": None, "size_bits": None, "fingerprint_bits": self.width}


def saved(made: BloomFilter | ShardedFilter) -> tuple[dict, DataFrame]:
    """What describes a filter, and its table."""
    if isinstance(made, BloomFilter):
        return {"kind": "bloom", "size_bits": made.size_bits, "num_hashes": made.num_hashes, "num_elements": made.num_elements}, made.bits
    return {"kind": made.kind, "width": made.width, "count": made.count, "num_elements": made.num_elements}, made.shards


def read(own: dict, table: DataFrame) -> BloomFilter | ShardedFilter:
    """The filter of a description and a table."""
    if own["kind"] == "bloom":
        return BloomFilter(table, own["size_bits"], own["num_hashes"], own["num_elements"])
    return ShardedFilter(table, own["kind"], own["width"], own["count"], own["num_elements"])


def save(made: BloomFilter | ShardedFilter, path: str) -> None:
    """A filter by itself."""
    own, table = saved(made)
    storage.save(table.sparkSession, path, {"kind": "filter", "filter": own}, {"cells": table})


def load(spark: SparkSession, path: str) -> BloomFilter | ShardedFilter:
    """A filter of any kind; an error where something else lies."""
    manifest, tables = storage.load(spark, path, "filter")
    return read(manifest["filter"], tables["cells"])


MAKERS: dict[type, Callable] = {BloomFilterConfig: BloomFilter.of, XORFilterConfig: ShardedFilter.of, BinaryFuseFilterConfig: ShardedFilter.of}


def make_filter(minority: DataFrame, config: FilterConfig | None, key: str = "key") -> BloomFilter | ShardedFilter | None:
    """The filter of a configuration over the minority's keys."""
    if config is None:
        return None
    if type(config) not in MAKERS:
        raise ValueError(f"unknown filter configuration {config!r}")
    return MAKERS[type(config)](minority, config, key)

"""Generated test and benchmark data, each row a function of its number and a seed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAJORITY = (1 << 32) - 1


def draw(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) from a hash of its parts, the same on every run and engine partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 53)) / float(1 << 53)


def csv_tiers(spark: SparkSession, path: str) -> DataFrame:
    """metric, count and start, the counts of all tiers before it, of a CSV of (metric, count)."""
    tiers = spark.read.csv(path, header=True, schema="metric double, count bigint")
    before = Window.orderBy(F.desc("metric")).rowsBetween(Window.unboundedPreceding, -1)  # one row a tier
    return tiers.withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0)))


def distinct_rows(spark: SparkSession, rows: int, width: int, vocabulary: int, kind: str = "uniform", skew: float = 1.0, seed: int = 42, tiers: list[tuple[float, int]] | None = None, shortest: int | None = None) -> DataFrame:
    """key and values: rows of width distinct ids (of shortest to width, if given), uniform, by a truncated Zipf law or by tiers of (weight, count)."""
    if width > vocabulary:
        raise ValueError("rows can't have more distinct values than there are")

    def shares() -> np.ndarray:
        if kind == "uniform":
            p = np.ones(vocabulary)
        elif kind == "zipf":
            p = np.arange(1, vocabulary + 1, dtype=float) ** -skew
        elif kind == "tiers":
            p = np.concatenate([np.full(n, w) for w, n in tiers or []])
        else:
            raise ValueError(f"unknown distribution {kind!r}")
        return p / p.sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p = np.log(shares())
        for batch in batches:
            out = []
            for i in batch.column("id").to_pylist():
                rng = np.random.default_rng((seed, i))
                size = width if shortest is None else int(rng.integers(shortest, width + 1))
                # the largest of log p plus Gumbel noise are a draw without replacement
                keys = log_p + rng.gumbel(size=len(log_p))
                best = np.argpartition(-keys, size - 1)[:size]
                out.append(best[np.argsort(-keys[best])].tolist())
            yield pa.RecordBatch.from_arrays([pa.array([f"key{i}" for i in batch.column("id").to_pylist()]), pa.array(out, pa.list_(pa.int64()))], ["key", "values"])

    shares()
    return spark.range(rows).mapInArrow(run, "key string, values array<bigint>")


def alpha_mix(spark: SparkSession, rows: int, alpha: float, kind: str = "unique", seed: int = 42, skew: float = 1.5) -> DataFrame:
    """key and value: the share alpha of MAJORITY, and a minority that is unique, zipf, uniform_100 or two_value."""
    u = draw(seed + 1, "id")
    minority = {
        "unique": F.col("id") + 1,
        "two_value": F.lit(1),
        "uniform_100": F.floor(u * 100) + 1,
        "zipf": F.least(F.floor(F.pow(1 - u, F.lit(-1 / (skew - 1)))), F.lit(MAJORITY - 1)),
    }
    if kind not in minority:
        raise ValueError(f"unknown minority {kind!r}")
    value = F.when(draw(seed, "id") < alpha, F.lit(MAJORITY)).otherwise(minority[kind]).cast("bigint")
    return spark.range(rows).select(F.concat(F.lit("key"), F.col("id").cast("string")).alias("key"), value.alias("value"))

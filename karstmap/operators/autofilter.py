"""The closed-form choice of a prefilter: a bound on the bits per key that each candidate saves."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karstmap.functions.sizes import EXPANSION, FUSE_LEAST_KEYS, FUSE_OVERHEAD, XOR_OVERHEAD
from karstmap.operators.filters import AutoFilterConfig, BinaryFuseFilterConfig, BloomFilterConfig, FilterConfig, XORFilterConfig

MAX_BITS = 8  #: fingerprints of 1 to so many bits; Bloom filters of 1 to so many bits a key and hashes
KINDS = ("xor", "binary_fuse", "bloom")


def lower_bound(alpha: Column, eps: Column, bits: Column, distinct_ratio: Column) -> Column:
    """Bits per key that a filter of that error rate and size saves at least."""
    return EXPANSION * alpha * (1 - eps) - distinct_ratio - bits * (1 - alpha)


def candidate_grid(spark: SparkSession) -> DataFrame:
    """ord, kind, bits and hashes: 8 XOR, 8 binary fuse and 64 Bloom filters, in the order in which ties are won."""
    rows = [(i * MAX_BITS + b, kind, b, 0) for i, kind in enumerate(KINDS[:2]) for b in range(1, MAX_BITS + 1)]
    rows += [(2 * MAX_BITS + (k - 1) * MAX_BITS + b, "bloom", b, k) for k in range(1, MAX_BITS + 1) for b in range(1, MAX_BITS + 1)]
    return spark.createDataFrame(rows, "ord int, kind string, bits int, hashes int")


def candidates(stats: DataFrame) -> DataFrame:
    """The rows of dominance() with every candidate and its lb; each statistics row meets the 80 candidates."""
    n = F.col("n_minority").cast("double")
    fuse = F.when(n <= 1, FUSE_OVERHEAD).otherwise(F.greatest(F.lit(FUSE_OVERHEAD), 0.77 + 0.305 * math.log(600_000) / F.log(F.greatest(n, F.lit(2.0)))))
    bits, hashes = F.col("bits").cast("double"), F.col("hashes").cast("double")
    eps = F.when(F.col("kind") == "bloom", F.pow(1 - F.exp(-hashes / bits), hashes)).otherwise(F.pow(F.lit(2.0), -bits))
    size = F.when(F.col("kind") == "xor", XOR_OVERHEAD * bits).when(F.col("kind") == "binary_fuse", fuse * bits).otherwise(bits)
    grid = F.broadcast(candidate_grid(stats.sparkSession))  # 80 rows
    return stats.join(grid).withColumn("eps", eps).withColumn("lb", lower_bound(F.col("alpha"), F.col("eps"), size, F.col("distinct_ratio")))


def choices(stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The columns of by with kind, bits, hashes and lb of the best candidate; kind is none where no filter pays."""
    best = F.min(F.struct((-F.round("lb", 12)).alias("l"), "ord", "kind", "bits", "hashes")).alias("b")
    grouped = candidates(stats).groupBy(*(by or []), "alpha", "n_minority").agg(best)
    pays = (F.col("b.l") < 0) & (F.col("alpha") < 1) & (F.col("n_minority") >= FUSE_LEAST_KEYS)
    pick = lambda c, none: F.when(pays, F.col(f"b.{c}")).otherwise(F.lit(none)).alias(c)
    return grouped.select(*(by or []), pick("kind", "none"), pick("bits", 0), pick("hashes", 0), (-F.col("b.l")).alias("lb"))


def chosen(stats: DataFrame) -> FilterConfig | None:
    """The configuration that the bound picks for one row of statistics."""
    row = choices(stats).first()
    if row is None or row["kind"] == "none":
        return None
    return {"xor": XORFilterConfig, "binary_fuse": BinaryFuseFilterConfig}[row["kind"]](row["bits"]) if row["kind"] != "bloom" else BloomFilterConfig(row["bits"], row["hashes"])


def resolved(config: FilterConfig | None, stats: DataFrame) -> FilterConfig | None:
    return chosen(stats) if isinstance(config, AutoFilterConfig) else config

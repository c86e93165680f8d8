"""Lookups in the relational tier: joins that return a value for each probe row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karstmap.functions.hashing import as_text


def minority(pairs: DataFrame, mcv: object, value: str = "value") -> DataFrame:
    """Pairs whose value isn't the most common one."""
    return pairs.where(~F.col(value).eqNullSafe(F.lit(mcv)))


def column_minority(pairs: DataFrame, tops: DataFrame, value: str = "value") -> DataFrame:
    """Pairs (with pos) whose value isn't the most common one of their column; tops: pos and mcv, a row a column."""
    return pairs.join(tops, "pos").where(~F.col(value).eqNullSafe(F.col("mcv"))).select(*pairs.columns)


def sentinels(pairs: DataFrame, mcv: object, value: str = "value") -> DataFrame:
    """pairs with value as 1 for keys that a filter has to hold and 0 for those of the most common value."""
    return pairs.withColumn(value, F.when(F.col(value).eqNullSafe(F.lit(mcv)), 0).otherwise(1))


def joined(probe: DataFrame, index: DataFrame, key: str, index_key: str = "key", value: str = "value", out: str = "value") -> DataFrame:
    """probe with the value of its key, null for keys that the index lacks; Catalyst picks the join."""
    own = index.select(as_text(index_key).alias("__key"), F.col(value).alias(out))
    return probe.join(own, as_text(probe[key]) == own["__key"], "left").drop("__key")


def joined_or(probe: DataFrame, index: DataFrame, mcv: object, key: str, out: str = "value") -> DataFrame:
    """The same over an index without its most common value, which stands for all keys that are missing."""
    return joined(probe, index, key, out=out).withColumn(out, F.coalesce(F.col(out), F.lit(mcv)))


def hash_map(pairs: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """The baseline: the last of repeated keys wins, in the order of the value."""
    return pairs.groupBy(key).agg(F.max(value).alias(value))


def at(index: DataFrame, wanted: object, key: str = "key") -> DataFrame:
    """The rows of one key; the predicate reaches the scan."""
    return index.where(F.col(key) == F.lit(wanted))

"""Immutable key to value and key to array maps over DataFrames, near the entropy of their values."""

from karstmap.operators.filters import AutoFilterConfig, BinaryFuseFilterConfig, BloomFilter, BloomFilterConfig, ShardedFilter, XORFilterConfig
from karstmap.operators.permute import EntropyPermutationConfig, GlobalSortPermutationConfig, permuted
from karstmap.plans.build import Index, build, from_lists, load
from karstmap.sources.storage import DeserializationError

__all__ = [
    "AutoFilterConfig", "BinaryFuseFilterConfig", "BloomFilter", "BloomFilterConfig", "DeserializationError", "EntropyPermutationConfig",
    "GlobalSortPermutationConfig", "Index", "ShardedFilter", "XORFilterConfig", "build", "from_lists", "load", "permuted",
]

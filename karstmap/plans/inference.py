"""What kind of values a table holds, and whether the options given to a build fit them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_U32, MAX_U64 = (1 << 32) - 1, (1 << 64) - 1
KINDS = ("uint32", "uint64", "char10", "char12", "string")
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class ValueKind:
    """kind, and whether the values are single or the rows of an array column (fixed or ragged)."""

    kind: str
    layout: str  # scalar, fixed or ragged


def element_type(df: DataFrame, value: str) -> T.DataType:
    kind = df.schema[value].dataType
    return kind.elementType if isinstance(kind, T.ArrayType) else kind


def cells(df: DataFrame, value: str) -> DataFrame:
    """One row a value, as column v."""
    return df.select(F.explode(value).alias("v")) if isinstance(df.schema[value].dataType, T.ArrayType) else df.select(F.col(value).alias("v"))


def value_summary(df: DataFrame, value: str = "value", max_to_infer: int | None = None) -> DataFrame:
    """One row: the bounds that the kind follows from."""
    own = cells(df.limit(max_to_infer) if max_to_infer else df, value)
    kind = element_type(df, value)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(F.col("v").cast("binary"))
        return own.agg(F.count("*").alias("n"), F.count("v").alias("present"), F.min(size).alias("low"), F.max(size).alias("high"))
    return own.agg(F.count("*").alias("n"), F.count("v").alias("present"), F.min("v").alias("low"), F.max("v").alias("high"))


def kind_of(type_: T.DataType, low: object, high: object) -> str:
    """The kind for an element type and its bounds: values for numbers, bytes for strings."""
    if isinstance(type_, (T.StringType, T.BinaryType)):
        return {10: "char10", 12: "char12"}.get(low if low == high else None, "string")
    if isinstance(type_, INTEGERS) or isinstance(type_, T.DecimalType) and type_.scale == 0:
        if low is not None and low < 0:
            raise ValueError("values must not be negative")
        if high is not None and high > MAX_U64:
            raise ValueError("values must be below 2^64")
        return "uint32" if high is None or high <= MAX_U32 else "uint64"
    raise ValueError(f"unsupported value type {type_.simpleString()}")


def infer(df: DataFrame, value: str = "value", max_to_infer: int | None = None) -> ValueKind:
    layout = "scalar"
    if isinstance(df.schema[value].dataType, T.ArrayType):
        sizes = df.agg(F.min(F.size(value)).alias("a"), F.max(F.size(value)).alias("b")).first()
        if sizes["a"] is None:
            raise ValueError("keys and values must not be empty")
        layout = "fixed" if sizes["a"] == sizes["b"] else "ragged"
        if not sizes["b"]:
            raise ValueError("Subarray must not be empty.")
    row = value_summary(df, value, max_to_infer).first()
    if not row["n"]:
        raise ValueError("keys and values must not be empty")
    if row["present"] < row["n"]:
        raise ValueError("values must not be null")
    return ValueKind(kind_of(element_type(df, value), row["low"], row["high"]), layout)


def forced(kind: ValueKind, wanted: str) -> ValueKind:
    """The wanted kind where values of the inferred one fit it: any text is a string, and small numbers are 64-bit ones."""
    if wanted not in KINDS:
        raise ValueError(f"unknown kind {wanted!r}")
    fits = {"uint64": ("uint32", "uint64"), "string": ("char10", "char12", "string")}.get(wanted, (wanted,))
    if kind.kind not in fits:
        raise ValueError(f"values of kind {kind.kind} aren't {wanted}")
    return ValueKind(wanted, kind.layout)


def check_key(df: DataFrame, key: str) -> None:
    kind = df.schema[key].dataType
    if not isinstance(kind, (T.StringType, T.BinaryType, *INTEGERS)):
        raise TypeError(f"keys must be strings, bytes or integers, not {kind.simpleString()}")


def repeated_keys(df: DataFrame, key: str = "key") -> DataFrame:
    """key and n of keys that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def check_options(layout: str, kind: str, *, permutation: object = None, shared_codebook: bool = False, shared_filter: bool = False, strategy: str | None = None, explicit_filter: bool = False) -> None:
    """Options that would have no effect are errors."""
    if strategy not in (None, "packed"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if layout == "scalar" and (permutation or shared_codebook or shared_filter or strategy):
        raise ValueError("permutation, shared_codebook, shared_filter and strategy need array values")
    if strategy == "packed" and (permutation or shared_codebook or shared_filter or explicit_filter):
        raise ValueError("the packed strategy takes no prefilter, permutation or shared options")
    if layout == "ragged" and shared_filter:
        raise ValueError("shared_filter needs rows of one length")
    if permutation and kind == "string":
        raise ValueError("strings of varying length can't be permuted")

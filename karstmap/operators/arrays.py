"""Array values: fixed, ragged and packed layouts, their cells, groups and codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karstmap.operators import dictionary


def cells(df: DataFrame, key: str = "key", values: str = "values") -> DataFrame:
    """key, pos and value: one row a cell; a ragged row has cells only up to its length."""
    return df.select(key, F.posexplode(values).alias("pos", "value"))


def rows(cells_: DataFrame, key: str = "key", values: str = "values") -> DataFrame:
    """The inverse of cells()."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return cells_.groupBy(key).agg(F.transform(pairs, lambda x: x["value"]).alias(values))


def lengths(df: DataFrame, key: str = "key", values: str = "values") -> DataFrame:
    return df.select(key, F.size(values).cast("bigint").alias("length"))


def column_sizes(df: DataFrame, values: str = "values") -> DataFrame:
    """pos and n_keys: how many rows reach each position."""
    return df.select(F.posexplode(values).alias("pos", "v")).groupBy(F.col("pos").cast("int").alias("pos")).agg(F.count("*").alias("n_keys"))


def padded(df: DataFrame, values: str = "values", width: int | None = None) -> DataFrame:
    """Rows of one length, with zeros after their own cells."""
    width = width if width is not None else df.agg(F.max(F.size(values))).first()[0]
    kind = df.schema[values].dataType.elementType.simpleString()
    return df.withColumn(values, F.concat(values, F.array_repeat(F.lit(0).cast(kind), F.lit(width) - F.size(values))))


def column_groups(hist: DataFrame) -> DataFrame:
    """mcv and positions: the columns that share a most common value."""
    return dictionary.most_common(hist, ["pos"]).groupBy("mcv").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def group_minority(df: DataFrame, groups: DataFrame, key: str = "key", values: str = "values") -> DataFrame:
    """mcv, key and is_minority: whether any of a group's columns differs from its value; groups are as many as columns at most."""
    own = F.transform("positions", lambda p: F.element_at(values, p + 1))
    return df.join(F.broadcast(groups)).select("mcv", key, F.exists(own, lambda v: ~v.eqNullSafe(F.col("mcv"))).alias("is_minority"))


def bucket_subgroups(counts: DataFrame, ratio: int = 2) -> DataFrame:
    """pos, n_buckets and subgroup: columns by bucket count, a new group where one has over ratio times its group's least."""
    ordered = F.array_sort(F.collect_list(F.struct("n_buckets", "pos")))
    start = F.struct(F.lit(-1).cast("bigint").alias("least"), F.lit(0).alias("g"), F.array().cast("array<struct<pos:int,n_buckets:bigint,subgroup:int>>").alias("out"))

    def step(acc, x):
        new = (acc["least"] < 0) | (x["n_buckets"] > acc["least"] * ratio)
        group = F.when(new, acc["g"] + 1).otherwise(acc["g"])
        return F.struct(
            F.when(new, x["n_buckets"]).otherwise(acc["least"]).alias("least"),
            group.alias("g"),
            F.array_append(acc["out"], F.struct(x["pos"].cast("int").alias("pos"), x["n_buckets"].cast("bigint").alias("n_buckets"), group.alias("subgroup"))).alias("out"),
        )

    folded = counts.agg(F.aggregate(ordered, start, step)["out"].alias("out"))  # one row a column
    return folded.select(F.inline("out"))


STOP = -1  #: the place of the packed layout's end, which is no value


def packed_histogram(df: DataFrame, values: str = "values") -> DataFrame:
    """symbol (null for the end), freq: pooled cells and one end a row; the end is a symbol of its own, never a value."""
    own = dictionary.pooled_histogram(df, values)
    kind = own.schema["symbol"].dataType.simpleString()
    ends = df.agg(F.count("*").alias("freq")).select(F.lit(None).cast(kind).alias("symbol"), "freq").where("freq > 0")
    return own.unionByName(ends)


def packed_rows(df: DataFrame, book: DataFrame, key: str = "key", values: str = "values") -> DataFrame:
    """key, code (0s and 1s: the cells' codes and the end's) and n_bits."""
    ended = df.select(key, F.posexplode(F.concat(values, F.array(F.lit(None).cast(df.schema[values].dataType.elementType)))).alias("pos", "value"))
    coded = dictionary.encoded(ended, book).select(key, "pos", F.lpad(F.bin("code"), F.col("code_len"), "0").alias("bits"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "bits"))), lambda x: x["bits"]), "")
    return coded.groupBy(key).agg(joined.alias("code")).withColumn("n_bits", F.length("code").cast("bigint"))


def most_bits(packed: DataFrame, book: DataFrame) -> DataFrame:
    """max_total_bits: what a reader of packed rows must hold, the longest row's bits and one more code."""
    longest = book.agg(F.max("code_len").alias("longest"))
    return packed.agg(F.max("n_bits").alias("bits")).join(F.broadcast(longest)).select((F.col("bits") + F.col("longest")).alias("max_total_bits"))


def unpacked_rows(packed: DataFrame, book: DataFrame, key: str = "key", values: str = "values") -> DataFrame:
    """The inverse of packed_rows: codes are read one after another by a canonical code's first codes, then joined with their symbols."""
    firsts = book.groupBy("code_len").agg(F.min("code").alias("first"), F.count("*").alias("n"))
    table = firsts.agg(F.sort_array(F.collect_list(F.struct("code_len", "first", "n"))).alias("t"))  # one row of at most 62 lengths
    bits = F.split("code", "")
    empty = F.array().cast("array<struct<code_len:int,code:bigint>>")
    start = F.struct(F.lit(0).cast("bigint").alias("code"), F.lit(0).alias("len"), empty.alias("out"))

    def step(acc, b):
        code, length = acc["code"] * 2 + b.cast("bigint"), acc["len"] + 1
        hit = F.exists("t", lambda t: (t["code_len"] == length) & (code >= t["first"]) & (code < t["first"] + t["n"]))
        return F.struct(F.when(hit, F.lit(0).cast("bigint")).otherwise(code).alias("code"), F.when(hit, 0).otherwise(length).alias("len"), F.when(hit, F.array_append(acc["out"], F.struct(length.alias("code_len"), code.alias("code")))).otherwise(acc["out"]).alias("out"))

    read = packed.join(F.broadcast(table)).select(key, F.posexplode(F.aggregate(bits, start, step)["out"]).alias("pos", "x"))
    symbols = dictionary.decoded(read.select(key, "pos", "x.code_len", "x.code"), book).where("value is not null")
    # rows with no cells have their end alone
    return packed.select(key).join(rows(symbols, key, values), key, "left").withColumn(values, F.coalesce(values, F.array()))


def arena_offsets(bits: DataFrame) -> DataFrame:
    """group, bucket, pos, words and offset: where each solution begins in its group, in whole 64-bit words."""
    order = Window.partitionBy("group").orderBy("bucket", "pos").rowsBetween(Window.unboundedPreceding, -1)
    words = F.floor((F.col("bits") + 63) / 64).cast("bigint")
    return bits.withColumn("words", words).withColumn("offset", F.coalesce(F.sum("words").over(order), F.lit(0)))

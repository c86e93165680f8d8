"""Building, saving and asking indexes: key to value and key to array maps.

An index has two tiers. The relational one keeps keys and values as a table sorted into buckets, without
the most common value where a prefilter pays; it answers by joins and knows missing keys. The compact
one keeps no keys: solved bit strings near the entropy of the values. Arrays are stored by cell, with
the key and position as the cell's key; each column has a code of its own unless one is shared, and ragged rows have their
length as a value of its own.
"""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karstmap.functions import sizes
from karstmap.functions.hashing import as_text, bucket_of
from karstmap.operators import arrays, autofilter, compact, dictionary, filters, lookup, permute
from karstmap.plans import inference
from karstmap.sources import storage

KEYS_PER_BUCKET = 100_000  #: of the relational tier, for pruning by bucket
POS = "\x1f"  #: between an array's key and a cell's position


@dataclass
class Part:
    """One coded map: the shape of its code, its symbols, its most common value and filter, and its tables.

    With columns, each column of an array has a code and a most common value of its own (mcv is a table of pos and mcv); shape
    then counts the symbols of all codes. Probes of such a part have pos beside the cell's key.
    """

    tier: str
    shape: dictionary.CodeShape
    book: DataFrame
    buckets: int
    table: DataFrame
    mcv: object = None
    filter: object = None
    keys: int = 0
    stored_keys: int = 0
    columns: dict[int, dictionary.CodeShape] | None = None

    def or_common(self, found: DataFrame, out: str, stored: Column | bool = True) -> DataFrame:
        """found with the most common value where none was found or the key isn't stored."""
        if self.columns is None:
            top = F.lit(self.mcv)
        else:
            found, top = found.join(self.mcv, "pos", "left"), F.col("mcv")
        return found.withColumn(out, F.when(F.lit(True) & stored, F.coalesce(F.col(out), top)).otherwise(top)).drop(*([] if self.columns is None else ["mcv"]))

    def lookup(self, probe: DataFrame, key: str, out: str) -> DataFrame:
        if self.tier == "relational":
            found = lookup.joined(probe, self.table, key, out=out)
            return self.or_common(found, out) if self.filter is not None else found
        places = compact.lookup(self.table, probe, self.shape, self.buckets, key, self.columns)
        if self.columns is None:
            symbols = self.book.select((F.lit(self.shape.symbols - 1) - F.col("rank")).alias("place"), F.col("symbol").alias(out))
            known = places.join(symbols, "place", "left").select("text", out)
        else:
            known = places.join(self.book.select("pos", "place", F.col("symbol").alias(out)), ["pos", "place"], "left").select("text", out)
        found = probe.join(known, as_text(probe[key]) == known["text"], "left").drop("text")
        if self.filter is None:
            return found
        return self.or_common(self.filter.marked(found, key, "__in"), out, F.col("__in")).drop("__in")


def build_part(pairs: DataFrame, prefilter: filters.FilterConfig | None, tier: str, by_column: bool = False) -> Part:
    """A part over pairs (key, value) with unique keys; by_column: pairs have pos too, and each of its values a code and a most common value of its own.

    One filter serves all columns, as their cells' keys differ; what it is chosen by are the sums over the columns.
    """
    by = ["pos"] if by_column else []
    hist = dictionary.histogram(pairs, by=by).persist()
    stats = dictionary.dominance(hist, by)
    if by_column:
        sums = stats.agg(*(F.sum(c).alias(c) for c in ("n_keys", "n_unique", "top", "n_minority")))
        stats = sums.select("*", (F.col("top") / F.col("n_keys")).alias("alpha"), (F.col("n_unique") / F.col("n_keys")).alias("distinct_ratio"))
    config = autofilter.resolved(prefilter, stats)
    common, row = dictionary.most_common(hist, by), stats.first()
    total = row["n_keys"]
    top = common.select(*by, "mcv").persist() if by_column else common.first()["mcv"] if total else None
    made, kept, constant = None, pairs, False
    if config is not None:
        rare = lookup.column_minority(pairs, top) if by_column else lookup.minority(pairs, top)
        constant = row["n_minority"] == 0
        made = filters.make_filter(rare, config)
        kept = rare if tier == "relational" else made.survivors(pairs)
        hist = dictionary.histogram(kept, by=by).persist()
    if constant:
        hist = hist.limit(0)
        kept = kept.limit(0)
    columns = dictionary.column_shapes(hist) if by_column else None
    shape = dictionary.CodeShape.sum(columns.values()) if by_column else dictionary.CodeShape.of(hist)
    own = (dictionary.column_codebook(hist, columns) if by_column else dictionary.codebook(hist, shape)).persist()
    if tier == "relational":
        stored_keys = kept.count()
        buckets = 1 + stored_keys // KEYS_PER_BUCKET
        table = kept.select(as_text("key").alias("key"), "value").withColumn("bucket", bucket_of("key", buckets))
        return Part(tier, shape, own, buckets, table, top, made, total, stored_keys, columns)
    coded = dictionary.encoded(kept, own).select("key", "code", "code_len").persist()
    sums = coded.agg(F.count("*").alias("n"), F.coalesce(F.sum("code_len"), F.lit(0)).alias("bits")).first()
    buckets = compact.bucket_count(sums["bits"])
    return Part(tier, shape, own, buckets, compact.build(coded, shape, buckets).persist(), top, made, total, sums["n"], columns)


@dataclass
class Index:
    """A built map. layout: scalar, fixed, ragged or packed."""

    layout: str
    kind: str
    tier: str
    part: Part
    lengths: Part | None = None
    width: int = 0
    extra: dict = field(default_factory=dict)

    def is_multiset(self) -> bool:
        return self.layout != "scalar"

    @property
    def spark(self) -> SparkSession:
        return self.part.table.sparkSession

    def lookup(self, probe: DataFrame, key: str = "key", out: str = "value") -> DataFrame:
        """probe with the value of each row's key. Keys that weren't built: null in the relational tier without a prefilter, else unspecified."""
        if self.layout == "scalar":
            return self.part.lookup(probe, key, out)
        text = probe.select(as_text(key).alias("__probe")).where("__probe is not null").distinct()
        if self.lengths is None:
            sized = text.withColumn("__n", F.lit(self.width))
        else:
            sized = self.lengths.lookup(text, "__probe", "__n").withColumn("__n", F.least(F.greatest(F.coalesce("__n", F.lit(0)), F.lit(0)), F.lit(self.width)))
        asked = sized.where("__n > 0").select("__probe", F.explode(F.sequence(F.lit(0), (F.col("__n") - 1).cast("int"))).alias("pos"))
        asked = asked.withColumn("pos", F.col("pos").cast("int")).withColumn("__cell", F.concat("__probe", F.lit(POS), F.col("pos").cast("string")))
        cells = self.part.lookup(asked, "__cell", "value").where("value is not null")
        found = arrays.rows(cells, "__probe", out)
        if self.lengths is not None:
            empty = F.array().cast(found.schema[out].dataType)
            found = sized.join(found, "__probe", "left").select("__probe", F.when(F.col("__n") == 0, empty).otherwise(F.col(out)).alias(out))
        return probe.join(found, as_text(probe[key]) == found["__probe"], "left").drop("__probe")

    def at(self, wanted: object, out: str = "value") -> DataFrame:
        """key and the value of one key: of the index only its bucket is read."""
        text = wanted.decode() if isinstance(wanted, bytes) else str(wanted)
        probe = self.spark.createDataFrame([(text,)], "key string")
        if self.layout != "scalar" or self.tier != "relational" or self.part.filter is not None:
            return self.lookup(probe, out=out)
        bucket = bucket_of(F.lit(text), self.part.buckets)
        return self.part.table.where((F.col("bucket") == bucket) & (F.col("key") == text)).select("key", F.col("value").alias(out))

    def query_batch(self, keys: list) -> list:
        """The values of a list of keys, in its order."""
        rows = [(i, k.decode() if isinstance(k, bytes) else str(k)) for i, k in enumerate(keys)]
        found = self.lookup(self.spark.createDataFrame(rows, "i bigint, key string"))
        return [r["value"] for r in sorted(found.select("i", "value").collect())]

    def query(self, key: object) -> object:
        return self.query_batch([key])[0]

    def get_filter(self) -> object:
        return self.part.filter

    def get_stats(self) -> dict:
        """The statistics tree of the main part."""
        part = self.part
        lengths = list(part.shape.counts)
        symbols = part.shape.symbols
        bits = (F.octet_length("solution") * 8).cast("bigint") if part.tier == "compact" else (F.octet_length("key") * 8).cast("bigint")
        sized = part.table.groupBy("bucket").agg(F.sum(bits).alias("bits"))
        row = sized.agg(F.count("*").alias("n"), F.sum("bits").alias("total"), F.avg("bits").alias("avg"), F.min("bits").alias("low"), F.max("bits").alias("high"), F.sum(F.ceil(F.col("bits") / 64) * 8).alias("bytes")).first()
        solution = int(row["bytes"] or 0)
        filter_stats = part.filter.stats() if part.filter is not None else None
        filter_bytes = filter_stats["size_bytes"] if filter_stats else 0
        metadata = 4 * len(lengths) + 8 * symbols + 8 + sizes.BUCKET_METADATA_BYTES * row["n"]
        return {
            "in_memory_bytes": solution + filter_bytes + metadata,
            "bucket_stats": {"num_buckets": row["n"], "total_solution_bits": row["total"] or 0, "avg_solution_bits": row["avg"] or 0.0, "min_solution_bits": row["low"] or 0, "max_solution_bits": row["high"] or 0},
            "huffman_stats": {
                "num_unique_symbols": symbols,
                "max_code_length": part.shape.longest,
                "avg_bits_per_symbol": sum(k * n for k, n in enumerate(lengths)) / symbols if symbols else 0.0,
                "avg_bits_per_key": dictionary.encoded_bits(part.book).first()["avg_bits_per_key"] if symbols else 0.0,
                "code_length_distribution": lengths,
            },
            "filter_stats": filter_stats,
            "solution_bytes": float(solution),
            "filter_bytes": float(filter_bytes),
            "metadata_bytes": float(metadata),
        }

    def save(self, path: str) -> None:
        tables, parts = {}, {}
        for name, part in (("main", self.part), ("lengths", self.lengths)):
            if part is None:
                continue
            tables[f"{name}_table"], tables[f"{name}_book"] = part.table, part.book
            parts[name] = {"buckets": part.buckets, "counts": list(part.shape.counts), "keys": part.keys, "stored_keys": part.stored_keys, "filter": None}
            kind = part.book.schema["symbol"].dataType.simpleString()
            if part.columns is not None:
                parts[name]["columns"] = [[pos, *shape.counts] for pos, shape in part.columns.items()]
                tables[f"{name}_mcv"] = part.mcv
            else:
                tables[f"{name}_mcv"] = self.spark.createDataFrame([(part.mcv,)], part.book.select("symbol").schema) if part.mcv is not None else self.spark.createDataFrame([], f"symbol {kind}")
            if part.filter is not None:
                parts[name]["filter"], tables[f"{name}_filter"] = filters.saved(part.filter)
        storage.save(self.spark, path, {"kind": f"{self.layout}-{self.kind}", "layout": self.layout, "value": self.kind, "tier": self.tier, "width": self.width, "parts": parts}, tables, {f"{n}_table": "bucket" for n in parts if self.tier == "relational"})


def load(spark: SparkSession, path: str, kind: str | None = None) -> Index:
    """A saved index of any layout; kind: for example scalar-uint32, an error if it is another."""
    manifest, tables = storage.load(spark, path, kind)
    parts = {}
    for name, own in manifest["parts"].items():
        made = filters.read(own["filter"], tables[f"{name}_filter"]) if own["filter"] else None
        columns, top = None, tables[f"{name}_mcv"]
        if "columns" in own:
            columns = {pos: dictionary.CodeShape(tuple(counts)) for pos, *counts in own["columns"]}
        else:
            top = row["symbol"] if (row := top.first()) else None
        parts[name] = Part(manifest["tier"], dictionary.CodeShape(tuple(own["counts"])), tables[f"{name}_book"], own["buckets"], tables[f"{name}_table"], top, made, own["keys"], own["stored_keys"], columns)
    return Index(manifest["layout"], manifest["value"], manifest["tier"], parts["main"], parts.get("lengths"), manifest["width"])


def build(df: DataFrame, key: str = "key", value: str = "value", *, prefilter: filters.FilterConfig | None = filters.AutoFilterConfig(), permutation: permute.PermutationConfig | None = None, shared_codebook: bool = False, shared_filter: bool = False, strategy: str | None = None, max_to_infer: int | None = None, tier: str = "compact", verbose: bool = False, kind_of_values: str | None = None) -> Index:
    """An index of df's key and value columns; an array column gives a fixed or ragged map, or with strategy packed a packed one. kind_of_values: what the values must fit, instead of the kind inferred."""
    if tier not in ("compact", "relational"):
        raise ValueError(f"unknown tier {tier!r}")
    inference.check_key(df, key)
    kind = inference.infer(df, value, max_to_infer)
    if kind_of_values is not None:
        kind = inference.forced(kind, kind_of_values)
    auto = isinstance(prefilter, filters.AutoFilterConfig)
    inference.check_options(kind.layout, kind.kind, permutation=permutation, shared_codebook=shared_codebook, shared_filter=shared_filter, strategy=strategy, explicit_filter=prefilter is not None and not auto)
    pairs = df.select(as_text(key).alias("key"), F.col(value).alias("value")).persist()
    if pairs.where("key is null").limit(1).count():
        raise ValueError("keys must not be null")
    if inference.repeated_keys(pairs).limit(1).count():
        raise RuntimeError("Detected a key collision: keys must be unique")
    if verbose:
        print(f"{kind.layout} map of {kind.kind}, {pairs.count()} keys")
    if kind.layout == "scalar":
        return Index("scalar", kind.kind, tier, build_part(pairs, prefilter, tier))
    rows = pairs.withColumnRenamed("value", "values")
    if permutation is not None:
        rows = permute.permuted(rows, permutation).persist()
    by_column = not shared_codebook and strategy != "packed"
    cells = arrays.cells(rows).select(F.concat("key", F.lit(POS), F.col("pos").cast("string")).alias("key"), "value", *([F.col("pos").cast("int").alias("pos")] if by_column else []))
    width = rows.agg(F.max(F.size("values"))).first()[0]
    layout = "packed" if strategy == "packed" else kind.layout
    lengths = None
    if layout != "fixed":
        lengths = build_part(arrays.lengths(rows).select("key", F.col("length").alias("value")), prefilter, tier)
    return Index(layout, kind.kind, tier, build_part(cells, None if layout == "packed" else prefilter, tier, by_column), lengths, width)


def from_lists(spark: SparkSession, keys: object, values: object, **options: object) -> Index:
    """The same from Python lists or numpy arrays: keys of str, bytes or a one-dimensional unsigned array; values of one or two dimensions or ragged."""
    if isinstance(keys, np.ndarray):
        if keys.ndim != 1 or keys.dtype != np.uint32:
            raise ValueError("key arrays must be one-dimensional uint32")
        names = [str(int(k)) for k in keys]
    else:
        if any(not isinstance(k, (str, bytes)) for k in keys):
            raise ValueError("keys must be str, bytes or a uint32 array")
        names = [k.decode() if isinstance(k, bytes) else k for k in keys]
    values = values.tolist() if isinstance(values, np.ndarray) else list(values)
    if not names or not values:
        raise ValueError("keys and values must not be empty")
    if len(names) != len(values):
        raise ValueError("keys and values must have the same length")
    nested = isinstance(values[0], (list, tuple, np.ndarray))
    rows = [[x.tolist() if isinstance(x, np.generic) else x for x in v] if nested else v for v in values]
    first = next((x for r in rows for x in (r if nested else [r])), None)
    if first is None:
        raise ValueError("Subarray must not be empty.")
    if isinstance(first, (list, tuple)):
        raise ValueError("values must have one or two dimensions")
    if isinstance(first, bool) or not isinstance(first, (int, str, bytes)):
        raise ValueError(f"Unsupported value type {type(first).__name__}")
    clean = lambda x: x.decode() if isinstance(x, bytes) else x
    rows = [[clean(x) for x in r] if nested else clean(r) for r in rows]
    if isinstance(first, int):
        low = min((x for r in rows for x in (r if nested else [r])), default=0)
        if low < 0:
            raise ValueError("values must not be negative")
        kind = "decimal(20,0)" if max(x for r in rows for x in (r if nested else [r])) >= 1 << 63 else "bigint"
        if kind != "bigint":
            from decimal import Decimal

            rows = [[Decimal(x) for x in r] if nested else Decimal(r) for r in rows]
    else:
        kind = "string"
    df = spark.createDataFrame(list(zip(names, rows, strict=True)), f"key string, value {f'array<{kind}>' if nested else kind}")
    return build(df, **options)


def describe(config: object) -> str:
    return json.dumps({"type": type(config).__name__, **dataclasses.asdict(config)})

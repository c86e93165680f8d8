"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Everything on the executors is DataFrame and SQL functions. A pattern's places are found by splitting
the text at its matches: the lengths of what lies between and of the matches add up to code point
offsets. The models count pairs of neighbouring characters in labelled samples: random are the strings that the fixed
patterns find in a bounded number of whole texts, and some that are random by construction, ordinary the words and identifiers of those texts. A candidate, a run of
at least ``LEAST_CHARS`` characters that may stand in a key, is a secret where the log likelihood
ratio of the two models exceeds ``THRESHOLD`` (a prior of one secret in a million runs). Candidates lie
outside the assign spans, and those that hold a span of another kind aren't reported twice.

Defined results: null and empty texts have no spans; very long texts are read whole, in time that grows as the power 1.5 of their matches at most;
repeated rows give repeated rows, and the first in order of texts with one id is sampled; spans that begin together are ordered by kind; other columns are ignored. The digest of no spans is
that of the empty string.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
LEAST_CHARS, THRESHOLD = 20, math.log(1e6)
RARE, BACK_OFF = 0.1, 10.0  # a pair's rate leans on its second character's as on so many pairs
FIRST, SYMBOLS = 43, 80  #: codes of the characters from + to z
SAMPLE_DOCS, RANDOM_ROWS = 2000, 4000


def cut(text: Column, pattern: str) -> Column:
    """array<struct<p,m>>: what lies ahead of each of the pattern's matches, and the match."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.arrays_zip(F.slice(pieces, F.lit(1), F.size(matches)).alias("p"), matches.alias("m"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, which no expression inside a lambda is."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _places(between: Column, kind: int) -> Column:
    """array<struct<start,kind,end>> of the matches of cut(). Lengths are added up in about as many blocks as a block has matches, as each growth of an array copies it."""
    found = "array<struct<start:bigint,kind:int,end:bigint>>"
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(found).alias("found"))
    ahead = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["p"])
        end = begin + F.length(x["m"])
        return F.struct(end.alias("at"), F.array_append(acc["found"], F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))).alias("found"))

    def blocks(all_: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(all_))).cast("int")
        numbers = F.sequence(F.lit(0), F.ceil(F.size(all_) / size).cast("int") - 1)
        return F.transform(numbers, lambda b: F.aggregate(F.slice(all_, b * size + 1, size), first, step))

    def together(parts: Column) -> Column:
        starts = F.aggregate(parts, ahead, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all")))["all"]
        return F.flatten(F.zip_with(parts, starts, lambda x, at: F.transform(x["found"], lambda f: F.struct((f["start"] + at).alias("start"), f["kind"].alias("kind"), (f["end"] + at).alias("end")))))

    return let(between, lambda all_: F.when(F.size(all_) > 0, let(blocks(all_), together)).otherwise(F.array().cast(found)))


def _kept(places: Column, keep: Column) -> Column:
    return F.transform(F.filter(F.arrays_zip(places.alias("f"), keep.alias("k")), lambda x: x["k"]), lambda x: x["f"])


def blanked(text: Column, between: Column, keep: Column) -> Column:
    """The text with the kept matches of cut() as blanks of their length, so that offsets stay."""
    size = F.aggregate(between, F.lit(0), lambda a, x: a + F.length(x["p"]) + F.length(x["m"]))
    parts = F.transform(F.arrays_zip(between.alias("b"), keep.alias("k")), lambda x: F.concat(x["b"]["p"], F.when(x["k"], F.repeat(F.lit(" "), F.length(x["b"]["m"]))).otherwise(x["b"]["m"])))
    return F.when(F.exists(keep, lambda k: k), F.concat(F.array_join(parts, ""), F.substring(text, size + 1, F.length(text)))).otherwise(text)


def ratio(table: list[float], token: Column) -> Column:
    """Sum of the table's log ratios over a token's neighbouring characters."""
    rows = F.from_json(F.lit(json.dumps(table)), "array<double>")
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c) - FIRST)
    first = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda a, c: F.struct(c.alias("last"), (a["sum"] + F.when(a["last"] >= 0, F.element_at(rows, a["last"] * SYMBOLS + c + 1)).otherwise(0.0)).alias("sum"))
    return F.aggregate(codes, first, step)["sum"]


def pair_counts(samples: DataFrame) -> DataFrame:
    """label, a, b and n of neighbouring characters in the samples' texts."""
    codes = F.filter(F.transform(F.split("text", ""), lambda c: F.ascii(c) - FIRST), lambda c: (c >= 0) & (c < SYMBOLS))
    pairs = samples.where(F.length("text") > 1).select("label", codes.alias("codes")).where(F.size("codes") > 1)
    zipped = F.arrays_zip(F.slice("codes", F.lit(1), F.size("codes") - 1).alias("a"), F.slice("codes", F.lit(2), F.size("codes") - 1).alias("b"))
    return pairs.select("label", F.explode(zipped).alias("x")).groupBy("label", F.col("x.a").alias("a"), F.col("x.b").alias("b")).agg(F.count("*").alias("n"))


def trained(samples: DataFrame) -> list[float]:
    """Log ratios, random over ordinary, for each pair of characters; samples has text and label (1 random, 0 ordinary)."""
    counts = {0: [0.0] * SYMBOLS**2, 1: [0.0] * SYMBOLS**2}
    for row in pair_counts(samples).collect():  # at most 2 x SYMBOLS^2 rows
        counts[row["label"]][row["a"] * SYMBOLS + row["b"]] += row["n"]
    rates = {}
    for label, own in counts.items():
        after = [sum(own[b::SYMBOLS]) + RARE for b in range(SYMBOLS)]  # of each character after any other
        before = [sum(own[a * SYMBOLS : (a + 1) * SYMBOLS]) for a in range(SYMBOLS)]
        share = [x / sum(after) for x in after]
        rates[label] = [math.log((x + BACK_OFF * share[i % SYMBOLS]) / (before[i // SYMBOLS] + BACK_OFF)) for i, x in enumerate(own)]
    return [round(r - o, 6) for r, o in zip(rates[1], rates[0], strict=True)]


def random_strings(spark: SparkSession, rows: int = RANDOM_ROWS) -> DataFrame:
    """Random strings that are so by construction: digests of numbers in base 64, hex and upper case; they give the model its alphabet where few are labelled."""
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 512))
    forms = F.array(F.base64(digest), F.lower(F.hex(digest)), F.upper(F.regexp_replace(F.base64(digest), "[^A-Za-z0-9]", "")))
    return spark.range(rows).select(F.explode(forms).alias("text"), F.lit(1).alias("label"))


def labelled_samples(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled strings of at most docs texts, in the order of a hash of their ids: what the fixed patterns find, of LEAST_CHARS or more characters with a digit, is random (1); words and identifiers outside them are ordinary (0)."""
    ids = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("sample_id")).orderBy(F.xxhash64("sample_id"), "sample_id").limit(docs).distinct()
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    few = texts.join(F.broadcast(ids), F.col("id").eqNullSafe(F.col("sample_id"))).groupBy("sample_id").agg(F.min("text").alias("text"))  # at most docs ids; only their texts move
    values = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    found = F.filter(values, lambda x: (F.length(x) >= LEAST_CHARS) & x.rlike("[0-9]"))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = F.regexp_extract_all(bare, F.lit(r"[A-Za-z][A-Za-z_-]+"), F.lit(0))
    both = F.concat(F.transform(found, lambda x: F.struct(x.alias("text"), F.lit(1).alias("label"))), F.transform(words, lambda x: F.struct(x.alias("text"), F.lit(0).alias("label"))))
    return few.select(F.explode(both).alias("x")).select("x.text", "x.label")


def scanned(df: DataFrame, table: list[float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id_col, found (all spans: start, kind, end, by start and kind) and base (those of the fixed patterns)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    long = F.transform(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2)), lambda x: F.length(x) >= 6)
    where = lambda pattern, places, of="t": F.when(F.regexp_like(of, F.lit(pattern)), places).otherwise(none)
    assign = where(ASSIGN, _kept(_places(cut(F.col("t"), ASSIGN), 0), long))
    base = F.array_sort(F.concat(assign, where(ACCESS, _places(cut(F.col("t"), ACCESS), 1)), where(HEX, _places(cut(F.col("t"), HEX), 2))))
    # a run outside all assign spans meets a span of another kind only where it holds the pattern itself
    rest = F.when(F.regexp_like("t", F.lit(ASSIGN)), blanked(F.col("t"), cut(F.col("t"), ASSIGN), long)).otherwise(F.col("t"))
    tokens = F.regexp_extract_all("rest", F.lit(CANDIDATE), F.lit(0))
    likely = F.transform(tokens, lambda x: ~x.rlike(ACCESS) & ~x.rlike(HEX) & (ratio(table, x) > threshold))
    more = where(CANDIDATE, _kept(_places(cut(F.col("rest"), CANDIDATE), 3), likely), "rest")
    own = df.select(F.col(id_col).alias("__id"), text.alias("t")).withColumn("base", base).withColumn("rest", rest)
    return own.select(F.col("__id").alias(id_col), "base", F.array_sort(F.concat("base", more)).alias("found"))


def joined(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_assign, n_access, n_hex, base_sha256, spans and n_markov of each text."""
    table = trained(random_strings(df.sparkSession).unionByName(labelled_samples(df, id_col, text_col)))
    found = scanned(df, table, id_col, text_col)
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select(id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("found").alias("spans"), count(3).alias("n_markov"))

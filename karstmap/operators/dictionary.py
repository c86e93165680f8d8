"""Value statistics and the entropy code of a value column.

A histogram is one partial and final hash aggregation. Huffman code lengths depend on the
frequencies alone, so the driver gets how many symbols have each frequency, at most the square root of
twice the rows, never the symbols. They stay distributed and get their lengths and canonical codes
from their ranks by literal expressions.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict, deque
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karstmap.functions.ordering import numbered

MAX_CODE_LENGTH = 62


def histogram(df: DataFrame, value: str = "value", by: list[str] | None = None) -> DataFrame:
    """The columns of by, symbol and freq."""
    return df.groupBy(*(by or []), F.col(value).alias("symbol")).agg(F.count("*").alias("freq"))


def pooled_histogram(df: DataFrame, values: str = "values") -> DataFrame:
    """symbol and freq over all cells of an array column."""
    return histogram(df.select(F.explode(values).alias("value")))


def column_histogram(df: DataFrame, values: str = "values") -> DataFrame:
    """pos, symbol and freq of each cell position of an array column."""
    return df.select(F.posexplode(values).alias("pos", "symbol")).groupBy("pos", "symbol").agg(F.count("*").alias("freq"))


def most_common(hist: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The columns of by, mcv and freq; of equally common values the smallest."""
    best = F.min(F.struct((-F.col("freq")).alias("f"), F.col("symbol").alias("s"))).alias("b")
    grouped = hist.groupBy(*by) if by else hist.groupBy()
    return grouped.agg(best).where("b is not null").select(*(by or []), F.col("b.s").alias("mcv"), (-F.col("b.f")).alias("freq"))


def dominance(hist: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The columns of by, n_keys, n_unique, top, alpha, distinct_ratio and n_minority."""
    grouped = hist.groupBy(*by) if by else hist.groupBy()
    own = grouped.agg(F.sum("freq").alias("n_keys"), F.count("*").alias("n_unique"), F.max("freq").alias("top"))
    return own.select(*(by or []), "n_keys", "n_unique", "top", (F.col("top") / F.col("n_keys")).alias("alpha"), (F.col("n_unique") / F.col("n_keys")).alias("distinct_ratio"), (F.col("n_keys") - F.col("top")).alias("n_minority"))


def entropy(hist: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The columns of by and the Shannon entropy in bits, as log2 N minus the mean of log2 frequency."""
    grouped = hist.groupBy(*by) if by else hist.groupBy()
    own = grouped.agg(F.sum("freq").alias("n"), F.sum(F.col("freq") * F.log2(F.col("freq").cast("double"))).alias("s"))
    return own.select(*(by or []), (F.log2(F.col("n").cast("double")) - F.col("s") / F.col("n")).alias("entropy_bits"))


def length_counts(classes: list[tuple[int, int]]) -> list[int]:
    """How many symbols get each code length, from 0, in a minimum-redundancy code; classes: frequency and how many symbols have it, ascending.

    Nodes of one weight are merged with each other in one step, so the work grows with the classes and not with the symbols; ties take leaves first.
    """
    if sum(n for _, n in classes) < 2:
        return [0, *(n for _, n in classes)]
    runs = [[f, n, None] for f, n in classes]  # weight, nodes left, the run or the two runs below each of its nodes
    sizes = [n for _, n in classes]
    leaves, inner = deque(range(len(runs))), deque()
    left = sum(sizes)

    def lightest() -> deque:
        return leaves if leaves and (not inner or runs[leaves[0]][0] <= runs[inner[0]][0]) else inner

    def add(weight: int, nodes: int, below: tuple[int, ...]) -> None:
        runs.append([weight, nodes, below])
        sizes.append(nodes)
        inner.append(len(runs) - 1)

    while left > 1:
        queue = lightest()
        k = queue[0]
        weight, nodes, _ = runs[k]
        pairs = nodes // 2
        if pairs:
            add(2 * weight, pairs, (k,))
            runs[k][1] -= 2 * pairs
            if not runs[k][1]:
                queue.popleft()
            left -= pairs
            continue
        queue.popleft()
        other = lightest()
        m = other[0]
        add(weight + runs[m][0], 1, (k, m))
        runs[m][1] -= 1
        if not runs[m][1]:
            other.popleft()
        left -= 1
    depths: list[Counter] = [Counter() for _ in runs]
    depths[-1][0] = 1
    for k in range(len(runs) - 1, len(classes) - 1, -1):
        below = runs[k][2]
        for depth, n in depths[k].items():
            for child in below:
                depths[child][depth + 1] += 2 * n if len(below) == 1 else n
    total = sum(depths[: len(classes)], Counter())
    return [total[x] for x in range(max(total) + 1)]


def code_lengths(freqs: list[int]) -> list[int]:
    """Code lengths of a minimum-redundancy code, in the order of the ascending frequencies."""
    counts = length_counts(sorted(Counter(freqs).items()))
    return [x for x in range(len(counts) - 1, -1, -1) for _ in range(counts[x])]


@dataclass(frozen=True)
class CodeShape:
    """How many symbols have each code length, from which canonical codes follow."""

    counts: tuple[int, ...]  # by length, from 0

    @property
    def symbols(self) -> int:
        return sum(self.counts)

    @property
    def longest(self) -> int:
        return max((k for k, c in enumerate(self.counts) if c), default=0)

    @property
    def firsts(self) -> list[tuple[int, int, int]]:
        """Length, place of its first symbol in canonical order and that symbol's code, for each used length."""
        out, code, place, last = [], 0, 0, 0
        for length, count in enumerate(self.counts):
            if count:
                code <<= length - last
                out.append((length, place, code))
                code, place, last = code + count, place + count, length
        return out

    @classmethod
    def of(cls, hist: DataFrame) -> CodeShape:
        return cls.of_classes([(r["freq"], r["n"]) for r in hist.groupBy("freq").agg(F.count("*").alias("n")).collect()])

    @classmethod
    def of_classes(cls, classes: list[tuple[int, int]]) -> CodeShape:
        shape = cls(tuple(length_counts(sorted(classes))))
        if shape.longest > MAX_CODE_LENGTH:
            raise ValueError(f"a code is longer than {MAX_CODE_LENGTH} bits")
        return shape

    @classmethod
    def sum(cls, shapes: Iterable[CodeShape]) -> CodeShape:
        """The counts of several codes together, for statistics."""
        return cls(tuple(map(sum, zip_longest(*(s.counts for s in shapes), fillvalue=0))))


def by_rank(shape: CodeShape, rank: Column) -> tuple[Column, Column]:
    """Code length and code of the symbol of a rank in the order of ascending frequency and symbol; canonical order is its reverse."""
    place = F.lit(shape.symbols - 1).cast("bigint") - rank
    length, code = F.lit(0), F.lit(0).cast("bigint")
    for n, first, start in shape.firsts:
        length = F.when(place >= first, F.lit(n)).otherwise(length)
        code = F.when(place >= first, F.lit(start).cast("bigint") + place - first).otherwise(code)
    return length.cast("int"), code


def codebook(hist: DataFrame, shape: CodeShape | None = None) -> DataFrame:
    """symbol, freq, rank, code_len and code."""
    shape = shape or CodeShape.of(hist)
    length, code = by_rank(shape, F.col("rank"))
    ranks = numbered(hist, [F.col("freq").asc(), F.col("symbol").asc()])
    return ranks.select("symbol", "freq", "rank", length.alias("code_len"), code.alias("code"))


def column_shapes(hist: DataFrame) -> dict[int, CodeShape]:
    """The shape of each column's own code, from a histogram with pos."""
    classes = defaultdict(list)
    for r in hist.groupBy("pos", "freq").agg(F.count("*").alias("n")).collect():
        classes[r["pos"]].append((r["freq"], r["n"]))
    return {pos: CodeShape.of_classes(own) for pos, own in sorted(classes.items())}


def column_codebook(hist: DataFrame, shapes: dict[int, CodeShape]) -> DataFrame:
    """pos, symbol, freq, rank, place, code_len and code: a code of its own for each column, of whose symbols rank and canonical place are numbers.

    All columns are numbered in one order; where each begins follows from how many symbols those before have.
    """
    rows, before = [], 0
    for pos, shape in sorted(shapes.items()):
        rows.append((pos, before, shape.symbols, [{"length": n, "first": first, "start": start} for n, first, start in shape.firsts]))
        before += shape.symbols
    kind = "pos int, before bigint, symbols bigint, firsts array<struct<length:int,first:bigint,start:bigint>>"
    codes = hist.sparkSession.createDataFrame(rows, kind)
    ranks = numbered(hist, [F.col("pos").asc(), F.col("freq").asc(), F.col("symbol").asc()])
    rank = F.col("rank") - F.col("before")
    placed = ranks.join(codes, "pos").withColumn("rank", rank).withColumn("place", F.col("symbols") - 1 - F.col("rank"))
    own = placed.withColumn("own", F.element_at(F.filter("firsts", lambda x: x["first"] <= F.col("place")), -1))
    return own.select("pos", "symbol", "freq", "rank", "place", F.col("own.length").alias("code_len"), (F.col("own.start") + F.col("place") - F.col("own.first")).alias("code"))


def encoded(df: DataFrame, book: DataFrame, value: str = "value") -> DataFrame:
    """df with code_len and code of its value; where the book has a code for each pos, of that of its column."""
    by_column = "pos" in book.columns
    own = book.select(F.col("symbol").alias("__symbol"), "code_len", "code", *([F.col("pos").alias("__pos")] if by_column else []))
    same = df[value].eqNullSafe(own["__symbol"])
    return df.join(own, same & (df["pos"] == own["__pos"]) if by_column else same).drop("__symbol", "__pos")


def decoded(df: DataFrame, book: DataFrame, name: str = "value") -> DataFrame:
    """df (with code_len and code) with the symbol of its code."""
    return df.join(book.select("code_len", "code", F.col("symbol").alias(name)), ["code_len", "code"])


def encoded_bits(book: DataFrame) -> DataFrame:
    """total_bits, avg_bits_per_key (weighted), avg_bits_per_symbol (unweighted) and max_code_length."""
    total = F.sum(F.col("freq") * F.col("code_len"))
    return book.agg(total.alias("total_bits"), (total / F.sum("freq")).alias("avg_bits_per_key"), F.avg("code_len").alias("avg_bits_per_symbol"), F.max("code_len").alias("max_code_length"))


def bits_for(freqs: list[int]) -> float:
    n = sum(freqs)
    return math.log2(n) - sum(f * math.log2(f) for f in freqs) / n if n else 0.0

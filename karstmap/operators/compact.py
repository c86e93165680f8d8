"""The compact tier: buckets of solved bit strings that hold values without their keys.

A key's code is written as equations over GF(2): its bit i is the xor of a bucket's bits at three places
of the key, each moved by i. A bucket of about ``EQUATIONS`` equations is one row; solving peels the
equations that have a bit of their own and eliminates the rest lazily, so that few variables are left to be eliminated densely. Looking up
xors three slices and reads the canonical code. Unknown keys give some value: none are stored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karstmap.functions.bits import pack_bits, unpack_bits
from karstmap.functions.hashing import as_text, mix, spread, wide
from karstmap.operators.dictionary import CodeShape

EQUATIONS, EXPANSION, SEEDS = 1600, 1.10, 64


def starts(h: np.ndarray, seed: int, span: int) -> np.ndarray:
    """Three places of each key for its first bit."""
    return np.stack([spread(mix(h, 4 * seed + i), span) for i in range(3)], axis=1)


def solve(rows: list[list[int]], values: list[int], size: int) -> list[int] | None:
    """Bits of a solution of equations, each given by its variables and their sum; None if they contradict.

    Equations that alone hold a variable come off first, as that variable can satisfy them last. Among the rest variables are
    set aside one by one, those in most equations first, until an equation has one other left, which it then expresses by those set aside; so only
    equations over the few variables set aside are eliminated, each as the bits of one number.
    """
    holders: list[list[int]] = [[] for _ in range(size)]
    for k, row in enumerate(rows):
        for v in row:
            holders[v].append(k)
    degree = list(map(len, holders))
    left = [True] * len(rows)
    peeled: list[tuple[int, int]] = []
    ready = [v for v in range(size) if degree[v] == 1]
    while ready:
        v = ready.pop()
        if degree[v] == 1:
            k = next(k for k in holders[v] if left[k])
            left[k] = False
            peeled.append((k, v))
            for u in rows[k]:
                degree[u] -= 1
                if degree[u] == 1:
                    ready.append(u)
    aside = 0
    known = [False] * size  # set aside or expressed
    state = list(values)  # bit 0: the sum; the others: variables set aside
    weight = [len(row) if keep else -1 for row, keep in zip(rows, left, strict=True)]
    expressed: list[tuple[int, int]] = []
    names: list[int] = []
    single = [k for k, w in enumerate(weight) if w == 1]
    dense = [k for k, w in enumerate(weight) if w == 0]
    order = iter(sorted((v for v in range(size) if degree[v] > 0), key=lambda v: -degree[v]))
    while True:
        if single:
            k = single.pop()
            if weight[k] != 1:
                continue
            v = next(u for u in rows[k] if not known[u])
            expressed.append((k, v))
            weight[k] = -1
            bits = state[k]
        else:
            v = next((u for u in order if not known[u]), -1)
            if v < 0:
                break
            aside += 1
            names.append(v)
            bits = 1 << aside
        known[v] = True
        for f in holders[v]:
            if weight[f] > 0:
                state[f] ^= bits
                weight[f] -= 1
                if weight[f] == 1:
                    single.append(f)
                elif not weight[f]:
                    dense.append(f)
    pivots: dict[int, int] = {}
    for k in dense:
        row = state[k]
        while row > 1:
            top = row.bit_length()
            if (other := pivots.get(top)) is None:
                pivots[top] = row
                break
            row ^= other
        else:
            if row:
                return None
    solution, found = [0] * size, 1  # found: bit 0 stands for the sums
    for top in sorted(pivots):
        if ((pivots[top] ^ (1 << (top - 1))) & found).bit_count() & 1:
            found |= 1 << (top - 1)
    for i, v in enumerate(names, 1):
        solution[v] = found >> i & 1
    for k, v in expressed:
        solution[v] = (state[k] & found).bit_count() & 1
    for k, v in reversed(peeled):
        total = values[k]
        for u in rows[k]:
            if u != v:
                total ^= solution[u]
        solution[v] = total
    return solution


def solved_bucket(h: np.ndarray, codes: np.ndarray, lengths: np.ndarray, longest: int) -> tuple[int, int, bytes]:
    """Seed, span and bits of one bucket."""
    lengths, codes = lengths.astype(np.int64), codes.astype(np.int64)
    span = max(3, int(np.ceil(lengths.sum() * EXPANSION)))
    owner = np.repeat(np.arange(len(lengths)), lengths)
    bit = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    values = (codes[owner] >> (lengths[owner] - 1 - bit) & 1).tolist()
    for seed in range(SEEDS):
        if seed and seed % 8 == 0:
            span += 2 + span // 50
        places = np.sort(starts(h, seed, span), axis=1)[owner] + bit[:, None]
        rows = places.tolist()
        for k in np.flatnonzero((places[:, 0] == places[:, 1]) | (places[:, 1] == places[:, 2])).tolist():
            a, b, c = rows[k]  # equal places cancel
            rows[k] = [c] if a == b else [a]
        if (found := solve(rows, values, span + longest)) is not None:
            return seed, span, pack_bits(np.array(found, np.uint8))
    raise RuntimeError("no solution found: repeated keys?")


def read_codes(h: np.ndarray, seed: int, span: int, bits: np.ndarray, shape: CodeShape) -> np.ndarray:
    """The canonical place of each key's symbol, by testing its bits length by length; bits: of a bucket, at least span and the shape's longest."""
    longest = shape.longest
    at = starts(h, seed, span)
    window = at[:, :, None] + np.arange(longest)
    read = np.bitwise_xor.reduce(bits[window], axis=1).astype(np.int64)
    place, code = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    open_ = np.ones(len(h), bool)
    firsts = {n: (p, c) for n, p, c in shape.firsts}
    for n in range(1, longest + 1):
        code = code * 2 + read[:, n - 1]
        if n in firsts:
            first, start = firsts[n]
            hit = open_ & (code - start < shape.counts[n]) & (code >= start)
            place[hit] = first + code[hit] - start
            open_ &= ~hit
    return place


def build(pairs: DataFrame, shape: CodeShape, buckets: int, key: str = "key") -> DataFrame:
    """bucket, seed, span and solution of pairs (key, code, code_len); keys must be unique."""
    longest = shape.longest

    def run(group: pa.Table) -> pa.Table:
        seed, span, bits = solved_bucket(np.asarray(group.column("h2")).astype(np.uint64), np.asarray(group.column("code")), np.asarray(group.column("code_len")), longest)
        return pa.table({"bucket": group.column("bucket")[:1], "seed": pa.array([seed], pa.int32()), "span": pa.array([span], pa.int32()), "solution": pa.array([bits], pa.binary())})

    own = pairs.select(*wide(key), "code", "code_len").withColumn("bucket", F.pmod("h1", F.lit(buckets)).cast("bigint"))
    return own.groupBy("bucket").applyInArrow(run, "bucket bigint, seed int, span int, solution binary")


def lookup(index: DataFrame, probe: DataFrame, shape: CodeShape, buckets: int, key: str = "key", columns: dict[int, CodeShape] | None = None) -> DataFrame:
    """text (each distinct probe key) and place (its symbol's canonical place); with columns, the codes by column, also pos, which probe has."""

    def run(keys: pa.Table, rows: pa.Table) -> pa.Table:
        h = np.asarray(keys.column("h2")).astype(np.uint64)
        place, known = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        if len(rows) and len(h):
            row = rows.to_pylist()[0]
            held = unpack_bits(row["solution"], row["span"] + shape.longest)
            if columns is None:
                place, known = read_codes(h, row["seed"], row["span"], held, shape), ~known
            else:
                pos = np.asarray(keys.column("pos"))
                for p in np.unique(pos).tolist():
                    if p in columns:
                        own = pos == p
                        place[own], known[own] = read_codes(h[own], row["seed"], row["span"], held, columns[p]), True
        out = {"text": keys.column("text"), "place": pa.array(place, pa.int64(), mask=~known)}
        return pa.table(out if columns is None else out | {"pos": keys.column("pos")})

    more = [] if columns is None else [F.col("pos").cast("int").alias("pos")]
    text = probe.select(as_text(key).alias("text"), *more).where("text is not null").distinct()
    keys = text.select("text", *wide("text"), *more).withColumn("bucket", F.pmod("h1", F.lit(buckets)).cast("bigint"))
    own = index.withColumn("bucket", F.col("bucket").cast("bigint"))  # read from folder names it is an int, which hashes into other partitions
    return keys.groupBy("bucket").cogroup(own.groupBy("bucket")).applyInArrow(run, "text string, place bigint" + (", pos int" if more else ""))


def bucket_count(total_bits: int) -> int:
    return max(1, -(-total_bits // EQUATIONS))

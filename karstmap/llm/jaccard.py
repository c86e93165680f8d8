"""Exact Jaccard self-join of word shingles by a token-group matrix.

1. Every text becomes its set of shingle hashes; texts of one set are one class from here on.
2. Shingles are dealt to shards, which see which ones more than one class has. A class can only link
   where at least the threshold's share of its shingles is shared, so all others are done.
3. The rest are partitioned into groups of similar classes: classes with a smallest hash in common,
   for several hash orders, in blocks of at most about ``GROUP``; within a block, links are found exactly, and
   linked classes are joined into components. Large components are cut into groups of about ``GROUP``
   classes; classes of small ones are grouped with those that they share a smallest hash with.
4. The token-group matrix, shingle by group, says which groups hold a shingle. Classes ask the groups with
   which they share one of their rarest shingles: classes of small components any group, of two
   large components the smaller one's classes the larger one's groups.
5. A class's overlap with the union of a group's shingles bounds its overlap with each of its classes; only
   groups whose bound reaches the threshold are opened, and their classes compared exactly.
6. Components of all links give each document the smallest id that it reaches.

No pair is lost: by the prefix rule two classes that link share one of their rarest shingles, and a class
that links to a class of a group has at least its threshold's share of shingles in the group's union. No step emits all pairs of a group: similar classes meet in blocks of
bounded size that return a link for each class, and components meet others by their bound.

A shingle that many texts have is sent once by each task, however many of the task's classes have it.
Ties, and which text of a group is opened first, change no result. Very long texts are read whole; blocks and buckets are bounded by
tokens as well as by classes.

Defined results: null and wordless texts have no shingles and link with nothing; a text of fewer
words than a shingle is one shingle; repeated rows are copies; rows with a null id link with nothing
and have a null component; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karstmap.llm.common import slices, stored, text_bytes

WORDS, PERCENT = 5, 75
GROUP, SMALL, ORDERS, SLICE = 256, 64, 3, 1000
SHARD_BYTES, SHARD_TOKENS, BUCKET_ROWS = 6_000_000, 400_000, 1000
POST_TOKENS, POST_SETS = 1_500_000, 60_000  #: of a task's sets that are sent together
SEVERAL = (-(1 << 63), 1 - (1 << 63))  #: stand for classes that a sending task doesn't name
HOT_COPIES, BLOCK_TOKENS, BUCKET_TOKENS = 1000, 4_000_000, 8_000_000
PART_BYTES, BROADCAST_ROWS, CELLS, SKETCH_BITS = 20_000_000, 200_000, 500_000, 20
MULTIPLIER, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.ascii_trim_whitespace(texts.fill_null(""))))
    flat = split.flatten()
    offsets = np.asarray(split.offsets) - split.offsets[0].as_py()
    coded = flat.dictionary_encode()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    hashes = own[np.asarray(coded.indices)]
    empty = np.asarray(pc.equal(pc.binary_length(flat), 0))
    window = np.zeros(0, np.uint64)
    if len(hashes) >= words:
        window = hashes[: len(hashes) - words + 1].copy()
        for k in range(1, words):
            window = window * MULTIPLIER + hashes[k : len(hashes) - words + 1 + k]
        window = mixed(window)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b == a or b == a + 1 and empty[a]:
            out.append(np.zeros(0, np.uint64))
        elif b - a < words:
            out.append(np.array([xxhash.xxh3_64_intdigest(hashes[a:b].tobytes(), seed=b - a)], np.uint64))
        else:
            out.append(np.unique(window[a : b - words + 1]))
    return out


def class_of(tokens: np.ndarray) -> int:
    return int.from_bytes(blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def documents_sets(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id_col, n (set size) and cls (a hash of the set; null for none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            sets = shingle_sets(batch.column(text_col), words)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(map(len, sets), pa.int64()), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64())], [id_col, "n", "cls"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n long, cls long")


def posted(sets: list[np.ndarray], owners: dict[str, np.ndarray], shards: int) -> Iterator[pa.RecordBatch]:
    """A row for each shard: tokens (32 bits of each hash), owner (place in the owners' columns) and the owners' columns."""
    if not sets:
        return
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
    shard, short = shard_of(tokens, shards)
    order = np.argsort(shard, kind="stable")
    short, owner, shard = short[order], owner[order], shard[order]
    starts = np.flatnonzero(np.diff(shard, prepend=-1))
    rows = []
    for a, b in zip(starts, [*starts[1:], len(shard)], strict=True):
        used, place = np.unique(owner[a:b], return_inverse=True)
        rows.append((int(shard[a]), short[a:b].tobytes(), place.astype(np.uint16).tobytes(), *(v[used].tobytes() for v in owners.values())))
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k == 0 else pa.binary()) for k, x in enumerate(zip(*rows, strict=True))], ["shard", "tokens", "owner", *owners])


def gathered(group: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """A shard's tokens, owners and the owners' columns, all its rows in one."""
    parts = [[np.frombuffer(x, t) for x in group.column(c).to_pylist()] for c, t in (("tokens", np.uint32), ("owner", np.uint16), *((n, np.int64) for n in names))]
    sizes = np.array([len(x) for x in parts[2]])
    shift = np.repeat(np.cumsum(sizes) - sizes, [len(x) for x in parts[1]])
    return np.concatenate(parts[0]), np.concatenate(parts[1]) + shift, [np.concatenate(x) for x in parts[2:]]


LOW = np.uint64(0xFFFFFFFF)


def joint(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Two numbers of 32 bits as one of 64."""
    return high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)


def met_again(ordered: np.ndarray) -> np.ndarray:
    """Places of an ordered array whose value stands beside them too."""
    again = ordered[1:] == ordered[:-1]
    return np.concatenate([again, [False]]) | np.concatenate([[False], again]) if len(ordered) else np.zeros(0, bool)


def repeated(tokens: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that occur more than once, in order, and their owners."""
    order = np.argsort(tokens)
    tokens = tokens[order]
    several = met_again(tokens)
    return tokens[several], owner[order[several]]


def by_part(cls: np.ndarray, n: np.ndarray, parts: int) -> list[tuple[int, bytes, bytes]]:
    """Classes and their counts by ranges of classes."""
    part = (cls.view(np.uint64) % np.uint64(parts)).astype(np.int64)
    return [(p, cls[part == p].tobytes(), n[part == p].tobytes()) for p in np.unique(part).tolist()]


def posted_once(sets: dict[int, np.ndarray], shards: int, parts: int) -> Iterator[pa.RecordBatch]:
    """posted() with each token at most once: those that several of the sets have are counted here, and sent without an owner, as had by several."""
    names = np.array(list(sets), np.int64)
    tokens, owner = np.concatenate(list(sets.values())), np.repeat(np.arange(len(sets)), [len(s) for s in sets.values()])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    several = met_again(tokens)
    n = np.bincount(owner[several], minlength=len(names)).astype(np.int64)
    if n.any():
        rows = by_part(names[n > 0], n[n > 0], parts)
        yield pa.RecordBatch.from_arrays([pa.array([shards + r[0] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()), pa.array([b""] * len(rows), pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "tokens", "owner", "cls"])
    single, begins = ~several, np.flatnonzero(several & np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    back = np.argsort(owner[single], kind="stable")
    alone = np.split(tokens[single][back], np.cumsum(np.bincount(owner[single], minlength=len(names)))[:-1])
    both = tokens[begins]
    yield from posted([*alone, both, both], {"cls": np.concatenate([names, np.array(SEVERAL, np.int64)])}, shards)


def shared_counts(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """cls and shared: how many shingles of the class another class has too; shards send their counts in arrays, by ranges of classes."""
    size = text_bytes(df, text_col)
    shards, parts = max(1, -(-size // SHARD_BYTES)), max(1, -(-size // PART_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0
        for batch in slices(batches, SLICE):
            for own in shingle_sets(batch.column(text_col), words):
                if len(own) and (cls := class_of(own)) not in held:
                    held[cls] = own
                    size += len(own)
                    if size >= POST_TOKENS or len(held) == POST_SETS:
                        yield from posted_once(held, shards, parts)
                        held, size = {}, 0
        if held:
            yield from posted_once(held, shards, parts)

    def count(group: pa.Table) -> pa.Table:
        if (part := group.column("shard")[0].as_py() - shards) >= 0:  # a task's own counts go on as they are
            return pa.table({"part": pa.array([part] * len(group), pa.int64()), "cls": group.column("cls"), "shared": group.column("tokens")})
        tokens, owner, (cls,) = gathered(group, ["cls"])
        tokens, owner = repeated(tokens, owner)
        names, own = np.unique(cls[owner], return_inverse=True)
        pairs = np.unique(joint(tokens, own))
        n = np.bincount((pairs & LOW)[met_again(pairs >> np.uint64(32))].astype(np.int64), minlength=len(names))
        real = (n > 0) & (names != SEVERAL[0]) & (names != SEVERAL[1])
        rows = by_part(names[real], n[real], parts)
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int64()), "cls": pa.array([r[1] for r in rows], pa.binary()), "shared": pa.array([r[2] for r in rows], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        cls, n = (np.concatenate([np.frombuffer(x, np.int64) for x in group.column(c).to_pylist()]) for c in ("cls", "shared"))
        names, at = np.unique(cls, return_inverse=True)
        return pa.table({"cls": pa.array(names, pa.int64()), "shared": pa.array(np.bincount(at, n).astype(np.int64), pa.int64())})

    sent = df.where(F.col(id_col).isNotNull()).select(text_col).mapInArrow(send, "shard int, tokens binary, owner binary, cls binary")
    counted = sent.groupBy("shard").applyInArrow(count, "part long, cls binary, shared binary")
    return counted.groupBy("part").applyInArrow(add, "cls long, shared long")


def overlaps(query: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Common tokens of the query with each of the sets that lie in flat from starts on."""
    at = np.searchsorted(query, flat)
    at[at == len(query)] = 0
    return np.add.reduceat((query[at] == flat).astype(np.int32), starts)


def block_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join all that are linked among sets: each place is looked from once, at those not joined yet."""
    rest, out = list(range(len(sets))), []
    while len(rest) > 1:
        queue = [rest.pop(0)]
        while queue and rest:
            at = queue.pop()
            sizes = np.array([len(sets[i]) for i in rest])
            both = overlaps(sets[at], np.concatenate([sets[i] for i in rest]), np.cumsum(sizes) - sizes)
            hit = 100 * both >= percent * (len(sets[at]) + sizes - both)
            found = [i for i, h in zip(rest, hit, strict=True) if h]
            rest = [i for i, h in zip(rest, hit, strict=True) if not h]
            out += [(at, i) for i in found]
            queue += found
    return out


def sent_whole(df: DataFrame) -> DataFrame:
    """df to be broadcast where it has at most BROADCAST_ROWS rows (of a few numbers each); else a join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def candidates(df: DataFrame, reps: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """cls, n, keys (the class's smallest hash in each order) and tokens (binary) of the classes in reps (rep, want)."""
    docs = df.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(sent_whole(reps), "rep")
    seeds = list(np.arange(ORDERS, dtype=np.uint64) * MULTIPLIER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            own = {}
            for s, want in zip(shingle_sets(batch.column("text"), words), batch.column("want").to_pylist(), strict=True):
                if len(s) and class_of(s) == want:
                    own[want] = s
            keys = [[int(mixed(s ^ seed).min().astype(np.int64)) for seed in seeds] for s in own.values()]
            columns = [pa.array(list(own), pa.int64()), pa.array(map(len, own.values()), pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array([s.tobytes() for s in own.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["cls", "n", "keys", "tokens"])

    return docs.mapInArrow(run, "cls long, n long, keys array<long>, tokens binary").dropDuplicates(["cls"])


def bucket_count(rows: DataFrame, sets: DataFrame) -> int:
    """How many tasks' shares the rows (cls) make with their sets, by number and by tokens."""
    held = rows.join(sets.select("cls", "n"), "cls").agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    return int(1 + max(held["rows"] // BUCKET_ROWS, held["tokens"] // BUCKET_TOKENS))


def links_in_blocks(sets: DataFrame, percent: int) -> DataFrame:
    """a and b: links that join the classes of each block; a block is some of the classes with one smallest hash."""
    keys = sets.select("cls", "n", F.posexplode("keys").alias("k", "key"))
    sizes = keys.groupBy("k", "key").agg(F.count("*").alias("size"), F.sum("n").alias("tokens_")).where("size > 1")
    part = F.pmod(F.xxhash64("cls", "k"), F.ceil(F.greatest(F.col("size") / GROUP, F.col("tokens_") / BLOCK_TOKENS)).cast("long"))
    blocks = stored(keys.join(sizes, ["k", "key"]).select("cls", F.xxhash64("k", "key", part).alias("block")), "members")
    buckets = bucket_count(blocks, sets)

    def run(group: pa.Table) -> pa.Table:
        held: dict[int, list[int]] = {}
        cls, tokens = group.column("cls").to_pylist(), [np.frombuffer(x, np.uint64) for x in group.column("tokens").to_pylist()]
        for i, b in enumerate(group.column("block").to_pylist()):
            held.setdefault(b, []).append(i)
        found = [(cls[own[x]], cls[own[y]]) for own in held.values() for x, y in block_links([tokens[i] for i in own], percent)]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    rows = sets.select("cls", "tokens").join(sent_whole(blocks), "cls").withColumn("bucket", F.pmod("block", F.lit(buckets)))
    return rows.groupBy("bucket").applyInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node that it reaches, of all nodes but the roots; large and small stars in turn until nothing changes."""
    here = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = here.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return here.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = here.union(here.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        here = stored(small.distinct(), "edges")


def shard_of(tokens: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Each token's shard and the 32 bits that stand for it there."""
    return (tokens % np.uint64(shards)).astype(np.int32), ((tokens // np.uint64(shards)) & LOW).astype(np.uint32)


def sketch_cells(shard: np.ndarray, short: np.ndarray) -> np.ndarray:
    return (mixed(joint(shard, short)) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def common_levels(sets: DataFrame, groups: DataFrame, shards: int) -> np.ndarray:
    """A sketch of fixed size: how many groups share a token, as a power of two; tokens of one cell count as the commonest of them."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            yield from posted([np.frombuffer(x, np.uint64) for x in batch.column("tokens").to_pylist()], {"gid": np.asarray(batch.column("gid"), np.int64)}, shards)

    def count(group: pa.Table) -> pa.Table:
        tokens, owner, (gid,) = gathered(group, ["gid"])
        tokens, owner = repeated(tokens, owner)
        short, n = np.unique(np.unique(joint(tokens, np.unique(gid, return_inverse=True)[1][owner])) >> np.uint64(32), return_counts=True)
        short, n = short[n >= 4], n[n >= 4]
        cell = sketch_cells(np.full(len(short), group.column("shard")[0].as_py()), short)
        level, part = np.log2(n).astype(np.uint8), cell >> (SKETCH_BITS - 6)
        rows = [(p, cell[part == p].astype(np.int32).tobytes(), level[part == p].tobytes()) for p in np.unique(part).tolist()]
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int64()), "cells": pa.array([r[1] for r in rows], pa.binary()), "levels": pa.array([r[2] for r in rows], pa.binary())})

    def top(group: pa.Table) -> pa.Table:
        part, size = group.column("part")[0].as_py(), 1 << (SKETCH_BITS - 6)
        out = np.zeros(size, np.uint8)
        for cells, levels in zip(group.column("cells").to_pylist(), group.column("levels").to_pylist(), strict=True):
            np.maximum.at(out, np.frombuffer(cells, np.int32) - part * size, np.frombuffer(levels, np.uint8))
        return pa.table({"part": pa.array([part], pa.int64()), "levels": pa.array([out.tobytes()], pa.binary())})

    sent = sets.select("cls", "tokens").join(sent_whole(groups.select("cls", "gid")), "cls").mapInArrow(send, "shard int, tokens binary, owner binary, gid binary")
    counted = sent.groupBy("shard").applyInArrow(count, "part long, cells binary, levels binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for row in counted.groupBy("part").applyInArrow(top, "part long, levels binary").collect():  # 64 parts of the sketch
        out[row["part"] << (SKETCH_BITS - 6) :][: 1 << (SKETCH_BITS - 6)] = np.frombuffer(row["levels"], np.uint8)
    return out


def questions(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """cls and gid of the classes and the groups that they ask: they share a token that is among the rarest of both.

    Tokens are ordered by how common the sketch says that they are, then by hash. Two sets that link share one
    of their first n - ceil(n * percent / 100) + 1 tokens in any order that all sets keep to.
    """
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_TOKENS))
    levels = sets.sparkSession.sparkContext.broadcast(common_levels(sets, groups, shards))
    names = ["cls", "label", "size", "gid"]

    def rarest(tokens: np.ndarray) -> np.ndarray:
        keep = len(tokens) - -(-len(tokens) * percent // 100) + 1
        level = levels.value[sketch_cells(*shard_of(tokens, shards))]
        return tokens[np.lexsort((tokens, level))[:keep]]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            yield from posted([rarest(np.frombuffer(x, np.uint64)) for x in batch.column("tokens").to_pylist()], {c: np.asarray(batch.column(c), np.int64) for c in names}, shards)

    def meet(group: pa.Table) -> pa.Table:
        tokens, owner, (cls, label, size, gid) = gathered(group, names)
        tokens, owner = repeated(tokens, owner)
        classes, c_of = np.unique(cls, return_inverse=True)
        matrix, g_first, g_of = np.unique(gid, return_index=True, return_inverse=True)
        # the matrix: each token's groups, once
        cells = np.unique(joint(tokens, g_of[owner]))
        cell_token, cell_group = cells >> np.uint64(32), (cells & LOW).astype(np.int64)
        low = np.searchsorted(cell_token, tokens, "left")
        count = np.searchsorted(cell_token, tokens, "right") - low
        ends = np.cumsum(count)
        steps = np.unique(np.searchsorted(ends, np.arange(0, (ends[-1] if len(ends) else 0) + CELLS, CELLS), "left"))
        found = np.zeros(0, np.uint64)
        for a, b in zip([0, *steps], [*steps, len(count)], strict=True):
            if a == b:
                continue
            who = np.repeat(owner[a:b], count[a:b])
            place = np.repeat(low[a:b] - (ends[a:b] - count[a:b]), count[a:b]) + np.arange(ends[a] - count[a], ends[b - 1])
            other = g_first[cell_group[place]]
            larger = (size[who] < size[other]) | (size[who] == size[other]) & (label[who] < label[other])
            asks = np.where(size[other] > SMALL, (label[who] != label[other]) & larger, size[who] <= SMALL)
            found = np.union1d(found, joint(c_of[who[asks]], g_of[other[asks]]))
        asking, asked = (found >> np.uint64(32)).astype(np.int64), (found & LOW).astype(np.int64)
        return pa.table({"cls": pa.array(classes[asking], pa.int64()), "gid": pa.array(matrix[asked], pa.int64())})

    rows = sets.select("cls", "tokens").join(sent_whole(groups), "cls")
    sent = rows.mapInArrow(send, "shard int, tokens binary, owner binary, " + ", ".join(f"{c} binary" for c in names))
    return sent.groupBy("shard").applyInArrow(meet, "cls long, gid long").distinct()


def opened(sets: DataFrame, groups: DataFrame, asked: DataFrame, percent: int) -> DataFrame:
    """a and b: a link of each asking class with each other component in each opened group, where there is one."""
    wanted = groups.join(asked.select("gid").distinct(), "gid", "left_semi").select("cls", "gid", "label", F.lit(False).alias("asks"))
    # a class that asks its own group is there already, so only its name goes along
    asking = stored(asked.join(groups.select("cls", "label", F.col("gid").alias("home")), "cls").select("cls", "gid", "label", (F.col("gid") == F.col("home")).alias("home")), "asking")
    sent = stored(wanted.union(asking.where("not home").select("cls", "gid", "label", F.lit(True))), "sent")
    rows = sets.select("cls", "tokens").join(sent_whole(sent), "cls").select("gid", "cls", "label", "tokens", "asks")
    rows = rows.union(asking.where("home").select("gid", "cls", "label", F.lit(None).cast("binary"), F.lit(True)))
    buckets = bucket_count(sent, sets)

    def run(group: pa.Table) -> pa.Table:
        held: dict[int, tuple[list[int], list[int]]] = {}
        cls, label = group.column("cls").to_pylist(), np.asarray(group.column("label"))
        tokens = [np.frombuffer(x, np.uint64) if x is not None else None for x in group.column("tokens").to_pylist()]
        for i, (g, asks) in enumerate(zip(group.column("gid").to_pylist(), group.column("asks").to_pylist(), strict=True)):
            held.setdefault(g, ([], []))[asks].append(i)
        for inside, asking_ in held.values():
            there = {cls[i]: tokens[i] for i in inside}
            for q in asking_:
                tokens[q] = there[cls[q]] if tokens[q] is None else tokens[q]
        found = []
        for inside, asking in held.values():
            sizes, labels = np.array([len(tokens[i]) for i in inside]), label[inside]
            flat, starts = np.concatenate([tokens[i] for i in inside]), np.cumsum(sizes) - sizes
            union = np.unique(flat)
            for q in asking:
                if 100 * len(np.intersect1d(tokens[q], union, assume_unique=True)) < percent * len(tokens[q]):
                    continue  # the bound: no set of the group can link
                both = overlaps(tokens[q], flat, starts)
                hit = np.flatnonzero((100 * both >= percent * (len(tokens[q]) + sizes - both)) & (labels != label[q]))
                found += [(cls[q], cls[inside[hit[k]]]) for k in np.unique(labels[hit], return_index=True)[1]]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("gid"), F.lit(buckets)))
    return rows.groupBy("bucket").applyInArrow(run, "a long, b long")


def neighbourhoods(sets: DataFrame) -> DataFrame:
    """cls and near: the smallest class within two steps over shared smallest hashes."""
    keys = sets.select("cls", F.posexplode("keys").alias("k", "key"))
    near = sets.select("cls", F.col("cls").alias("near"))
    for _ in range(2):
        least = keys.join(near, "cls").groupBy("k", "key").agg(F.min("near").alias("near"))
        near = keys.join(least, ["k", "key"]).groupBy("cls").agg(F.min("near").alias("near"))
    return near


def matrix_groups(sets: DataFrame, near: DataFrame) -> DataFrame:
    """cls, label and size (of its component) and gid (its group); a group of small components has the neighbourhood's name."""
    labels = sets.select("cls").join(components(near), sets["cls"] == F.col("node"), "left").select("cls", F.coalesce("root", "cls").alias("label"))
    labels = labels.join(labels.groupBy("label").agg(F.count("*").alias("size")), "label")
    home = F.when(F.col("size") > SMALL, F.xxhash64(F.lit("c"), "label")).otherwise(F.xxhash64(F.lit("n"), "near"))
    homes = stored(labels.join(neighbourhoods(sets), "cls").select("cls", "label", "size", home.alias("home")), "homes")
    counts = homes.groupBy("home").agg(F.count("*").alias("many"))
    chunk = F.pmod(F.xxhash64("cls"), F.ceil(F.col("many") / GROUP).cast("long"))
    return homes.join(counts, "home").select("cls", "label", "size", F.xxhash64("home", chunk).alias("gid"))


def class_links(df: DataFrame, classes: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """a and b: links whose components are those of all links between classes (cls, n, rep)."""
    shared = shared_counts(df, id_col, text_col, words)
    reps = stored(classes.join(shared, "cls").where(F.col("shared") * 100 >= F.col("n") * percent).select("rep", F.col("cls").alias("want")), "reps")
    sets = stored(candidates(df, reps, id_col, text_col, words), "sets")
    near = stored(links_in_blocks(sets, percent), "links")
    groups = stored(matrix_groups(sets, near), "groups")
    asked = stored(questions(sets, groups, percent), "asked")
    return near.union(opened(sets, groups, asked, percent))


def spread_join(own: DataFrame, known: DataFrame, rows: int) -> DataFrame:
    """own with least of its class, or null; a class of many copies is dealt to several tasks, by a list of such classes that is short whatever the table."""
    many = max(HOT_COPIES, rows // BROADCAST_ROWS)
    hot = known.where(F.col("copies") > many).select("cls", F.ceil(F.col("copies") / many).cast("int").alias("salts"))  # at most BROADCAST_ROWS, as each has many rows
    salted = own.join(F.broadcast(hot), "cls", "left").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    each = F.explode(F.sequence(F.lit(0), F.when(F.col("copies") > many, F.ceil(F.col("copies") / many).cast("int") - 1).otherwise(0)))
    return salted.join(known.select("cls", "least", each.alias("salt")), ["cls", "salt"], "left")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """id_col, n_shingles, cls and component_id of each row of df."""
    own = stored(documents_sets(df, id_col, text_col, words), "documents")
    classes = own.where(F.col("cls").isNotNull() & F.col(id_col).isNotNull()).groupBy("cls").agg(F.first("n").alias("n"), F.min(id_col).alias("rep"), F.count("*").alias("copies"))
    classes = stored(classes, "classes")
    found = components(class_links(df, classes.select("cls", "n", "rep"), id_col, text_col, words, percent))
    rooted = classes.join(found, classes["cls"] == found["node"], "left").select("cls", "rep", F.coalesce("root", "cls").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("least"))
    placed = rooted.join(least, "root").where("least <> rep").select("cls", "least")
    # a class of one document in no link needs no look-up; copies and linked ones meet their class
    known = classes.join(placed, "cls", "left").where("copies > 1 or least is not null").select("cls", F.coalesce("least", "rep").alias("least"), "copies")
    joined = spread_join(own, known, own.count())
    component = F.when(F.col(id_col).isNotNull(), F.coalesce("least", id_col))
    return joined.select(id_col, F.col("n").alias("n_shingles"), "cls", component.alias("component_id"))

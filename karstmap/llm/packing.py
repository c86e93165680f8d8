"""Best-fit packing of tokenised documents by a configuration linear program.

Pieces of at most ``capacity`` tokens are counted by length; that histogram, never larger than the
capacity, is all the driver sees. The program covers the pieces of more than ``capacity / FILLER``
tokens by configurations, at the fewest sequences in fractions. Its lengths are cut into ``GROUPS``
groups of about as many pieces each (or of one length), each counted as its longest. Multiplicative weights
solve it: each round takes the configuration that is worth most, and the weights of its groups fall; a knapsack by dynamic
programming over all groups prices a new one whenever those known may be worth less than the best, which also
gives a bound from below. Rounds end where value and bound are within ``GAP``, or after ``ROUNDS``. Fractions are rounded down, the largest remainders up while
pieces are left. The pieces left over and the small ones go by best fit, longest first, into the room that the
configurations leave and then into new ones. Where best fit alone needs fewer sequences, its plan is taken.

The plan gives, for each length and range of ranks, a run of sequences and an offset. Pieces are
ranked within their length by ranges of the order of length and hash, so a length that a third of
the pieces have is cut like any other range, and find their place by a binary search in the plan.

Defined results: null and empty texts are the end id alone; very long texts are cut into pieces, all of which are kept; documents repeat as often as in the
input, and equal lengths are told apart by a hash of id and piece; an empty table packs into nothing; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karstmap.llm.common import by_batch, kept, slices, stored

CAPACITY, END_ID = 4096, 1
CACHE_WORDS = 500_000
GROUPS, ROUNDS, RATE, GAP = 96, 12_000, 0.1, 0.01
FILLER = 12  #: pieces of at most this part of the capacity fill the room that configurations leave
SLICE, LEARN = 1000, 1000


class WordIds:
    """Ids of white-space separated words as little-endian bytes; words met before are looked up.

    The tokenizer drops white space, never merges over it and lower-cases, so a text's ids are its
    words' in a row. Words and ids are Arrow arrays, and only new words become Python strings. New words of letters alone are
    encoded together, as one text. When the store is full, the half that fewest slices had goes.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.last = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)  # of ids that end a piece
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.words, self.codes, self.met = pa.array([], pa.string()), pa.array([], pa.large_binary()), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> np.ndarray:
        """Encodes and adds new words, those of letters alone in a few calls; the place of each among those added."""
        letters = np.fromiter(map(str.isalpha, words), bool, len(words))
        order = np.concatenate([np.flatnonzero(letters), np.flatnonzero(~letters)])
        found: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        whole = int(letters.sum())
        for at in range(0, len(order), LEARN):
            few = [words[i] for i in order[at : at + LEARN].tolist()]
            if at + len(few) <= whole:
                raw = self.encode([" ".join(few)])[0]
                ends = np.flatnonzero(self.last[raw]) + 1
                if len(ends) == len(few):  # each stayed one piece
                    found.append(raw)
                    sizes.append(np.diff(ends, prepend=0))
                    continue
            own = self.encode(few)
            found += own
            sizes.append(np.array(list(map(len, own)), np.int64))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) * 4
        codes = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(order), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.concatenate(found).astype("<u4").tobytes())])
        self.words = pa.concat_arrays([self.words, pa.array([words[i] for i in order.tolist()], pa.string())])
        self.codes = pa.concat_arrays([self.codes, codes])
        self.met = np.concatenate([self.met, np.zeros(len(order), np.int64)])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return place

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and where each text's begin and the last one's end."""
        if len(self.words) > CACHE_WORDS:
            keep = np.sort(np.argsort(-self.met, kind="stable")[: CACHE_WORDS // 2])
            self.words, self.codes, self.met = self.words.take(pa.array(keep)), self.codes.take(pa.array(keep)), self.met[keep] // 2
        texts = texts.fill_null("")
        # capitals inside a special token's marks would make it one, so such texts keep theirs
        lower = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        apart = pc.replace_substring_regex(lower, r"(\p{L})([.,])([ \n]|$)", r"\1 \2\3")  # a piece of its own in any case
        split = pc.split_pattern(pc.replace_substring(apart, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        at = pc.index_in(coded.dictionary, self.words)
        place = np.array(at.fill_null(-1), np.int64)
        if at.null_count:
            known = len(self.words)
            place[place < 0] = known + self.learn(coded.dictionary.filter(at.is_null()).to_pylist())
        self.met[place] += 1
        own = self.codes.take(pa.array(place[np.asarray(coded.indices)]))
        _, ends, held = own.buffers()
        ends = np.frombuffer(ends, np.int64, len(own) + 1) // 4 if len(own) else np.zeros(1, np.int64)
        return np.frombuffer(held or b"", "<u4", int(ends[-1])), ends[np.asarray(split.offsets) - split.offsets[0].as_py()]


def word_ids(path: str) -> WordIds:
    """One tokenizer for a worker process."""
    return kept("words", path, lambda: WordIds(path))


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """id_col, piece, start, length, ids_crc32 and, with_ids, the ids as little-endian unsigned 32-bit binary."""
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        for batch in slices(batches, SLICE):
            found: list[tuple] = []
            flat, ends = words.ids(batch.column(text_col))
            for i in range(batch.num_rows):
                ids = flat[ends[i] : ends[i + 1]].tobytes() + end
                for k in range(0, len(ids), 4 * capacity):
                    own = ids[k : k + 4 * capacity]
                    found.append((i, k // (4 * capacity), k // 4, len(own) // 4, zlib.crc32(own), own if with_ids else None))
            if found:
                own = list(zip(*found, strict=True))
                columns = [batch.column(id_col).take(pa.array(own[0], pa.int64())), pa.array(own[1], pa.int32()), *(pa.array(x, pa.int64()) for x in own[2:5])]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(own[5], pa.binary())] if with_ids else [])], [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return df.select(id_col, text_col).mapInArrow(run, schema)


def length_groups(counts: np.ndarray, groups: int = GROUPS) -> list[list[int]]:
    """Lengths with pieces, longest first, cut into groups: a group has about 1 / groups of the pieces, or is one length."""
    quota = max(1, -(-int(counts.sum()) // groups))
    out: list[list[int]] = []
    held = quota
    for length in np.flatnonzero(counts)[::-1].tolist():
        if held >= quota or counts[length] >= quota:
            out.append([])
            held = 0
        out[-1].append(length)
        held += int(counts[length])
    return out


def priced(values: np.ndarray, lengths: np.ndarray, counts: np.ndarray, capacity: int) -> dict[int, int]:
    """The knapsack's best configuration, as index -> copies: at most capacity tokens and counts copies of each length."""
    best = np.zeros(capacity + 1)
    items: list[tuple[int, int]] = []
    took: list[np.ndarray] = []
    for i in range(len(lengths)):
        left, copies = int(min(counts[i], capacity // lengths[i])), 1
        while left > 0:
            copies = min(copies, left)
            left -= copies
            size = copies * int(lengths[i])
            more = best[: capacity + 1 - size] + copies * values[i]
            better = np.zeros(capacity + 1, bool)
            np.greater(more, best[size:], out=better[size:])
            np.maximum(best[size:], more, out=best[size:])
            items.append((i, copies))
            took.append(better)
            copies *= 2
    out: dict[int, int] = {}
    room = capacity
    for (i, copies), better in zip(reversed(items), reversed(took), strict=True):
        if better[room]:
            out[i] = out.get(i, 0) + copies
            room -= copies * int(lengths[i])
    return out


class Covering:
    """The configuration linear program over groups of lengths: the fewest sequences, in fractions, that cover all pieces.

    use: configuration -> fraction, which covers every group; value: its total; bound: no packing, whole or in
    fractions, of pieces as long as their group's longest needs less.
    """

    def __init__(self, sizes: np.ndarray, need: np.ndarray, capacity: int, rounds: int = ROUNDS, rate: float = RATE, gap: float = GAP):
        columns: list[tuple[tuple[int, int], ...]] = [((i, 1),) for i in range(len(sizes))]
        matrix, taken = np.zeros((2 * len(sizes), len(sizes))), np.zeros(2 * len(sizes))
        matrix[: len(sizes)], taken[: len(sizes)] = np.eye(len(sizes)), need  # alone in a sequence each: a solution to begin with
        self.value, self.bound, best = float(need.sum()), 0.0, taken.copy()
        weight, covered = sizes / capacity, np.zeros(len(sizes))
        top, total, taken = np.inf, 0.0, taken * 0  # no configuration is worth more than top, as weights only fall
        for k in range(rounds if len(sizes) else 0):
            worth = matrix[: len(columns)] @ weight
            at = int(worth.argmax())
            if worth[at] < (1 - gap) * top:
                config = priced(weight, sizes, need, capacity)
                column = np.zeros(len(sizes))
                column[list(config)] = list(config.values())
                top = float(column @ weight)
                self.bound = max(self.bound, float(weight @ need) / top)  # weights over the best worth are a dual solution
                if top > worth[at] * (1 + 1e-12):
                    at = len(columns)
                    if at == len(matrix):
                        matrix, taken = np.concatenate([matrix, matrix * 0]), np.concatenate([taken, taken * 0])
                    columns.append(tuple(sorted(config.items())))
                    matrix[at] = column
            held = matrix[at] > 0
            step = float((need[held] / matrix[at][held]).min())
            taken[at] += step
            total += step
            covered += step * matrix[at]
            weight = weight * np.exp(-rate * step * matrix[at] / need)
            if weight.max() < 1e-100:
                weight, top = weight * 1e100, top * 1e100
            if k % 50 == 0:
                least = float((covered / need).min())
                if least and total / least < self.value:
                    self.value, best = total / least, taken / least
                if self.value <= self.bound * (1 + gap):
                    break
        self.use = {columns[i]: float(best[i]) for i in np.flatnonzero(best).tolist()}

    def rounded(self, need: np.ndarray) -> list[tuple[tuple[tuple[int, int], ...], int]]:
        """Whole uses that cover no piece twice: each fraction rounded down, then one more for the largest remainders that still fit."""
        left, uses = need.astype(np.int64).copy(), {}
        order = sorted(self.use, key=lambda k: (-self.use[k], k))
        for config in order:
            n = min(int(self.use[config] + 1e-9), *(int(left[i]) // c for i, c in config))
            uses[config] = n
            for i, c in config:
                left[i] -= n * c
        for config in sorted(order, key=lambda k: (int(self.use[k]) - self.use[k], k)):
            if all(left[i] >= c for i, c in config):
                uses[config] += 1
                for i, c in config:
                    left[i] -= c
        return [(k, n) for k, n in uses.items() if n]


def dealt(uses: list[tuple[tuple[tuple[int, int], ...], int]], groups: list[list[int]], left: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Configurations of groups as configurations of lengths: each group's pieces are handed out longest first; left loses them."""
    at = [0] * len(groups)
    out: list[tuple[dict[int, int], int]] = []
    for config, n in uses:
        while n:
            many, one = n, {}
            for g, copies in config:
                while not left[groups[g][at[g]]]:
                    at[g] += 1
                many = min(many, int(left[groups[g][at[g]]]) // copies)
            for g, copies in config:
                place, rest = at[g], copies
                while rest:  # one use takes what is left of a length and goes on to the next
                    length = groups[g][place]
                    took = copies if many else min(rest, int(left[length]))
                    if took:
                        one[length] = one.get(length, 0) + took
                    rest -= took
                    place += 1
            many = max(many, 1)
            for length, copies in one.items():
                left[length] -= copies * many
            out.append((one, many))
            n -= many
    return out


def linear_program(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[Covering, list[list[int]], np.ndarray]:
    """The program over the pieces of more than capacity / FILLER tokens and under capacity, its groups and their needs."""
    own = counts.astype(np.int64).copy()
    own[: capacity // FILLER + 1] = own[capacity] = 0
    groups = length_groups(own)
    need = np.array([own[g].sum() for g in groups], np.int64)
    return Covering(np.array([g[0] for g in groups], np.int64), need, capacity, rounds), groups, need


def configurations(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Configurations (length -> copies) and how often each is used, covering counts[length] pieces exactly."""
    left = counts.astype(np.int64).copy()
    plan: list[tuple[dict[int, int], int]] = []
    if left[capacity]:
        plan.append(({capacity: 1}, int(left[capacity])))
        left[capacity] = 0
    plain = best_fit(list(plan), left, capacity)
    program, groups, need = linear_program(left, capacity, rounds)
    plan = best_fit(plan + dealt(program.rounded(need), groups, left), left, capacity)
    return min(plan, plain, key=lambda p: sum(n for _, n in p))


def best_fit(plan: list[tuple[dict[int, int], int]], left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """plan with the pieces left[length] added, each into the configuration with the least room that takes it, or a new one."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}
    rooms: list[int] = []

    def put(config: dict[int, int], uses: int, room: int) -> None:
        if uses:
            if not open_.get(room):
                insort(rooms, room)
            open_.setdefault(room, []).append((config, uses))

    for config, uses in plan:
        put(config, uses, capacity - sum(k * n for k, n in config.items()))
    for length in np.flatnonzero(left)[::-1].tolist():
        need = int(left[length])
        while need:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                put({length: each}, need // each, capacity - each * length)
                if need % each:
                    put({length: need % each}, 1, capacity - need % each * length)
                break
            room = rooms[at]
            config, uses = open_[room].pop()
            if not open_[room]:
                rooms.pop(at)
            each = room // length
            take = min(uses, need // each)
            if take:
                put(config | {length: config.get(length, 0) + each}, take, room - each * length)
                need -= take * each
            elif need:
                put(config | {length: config.get(length, 0) + need}, 1, room - need * length)
                take, need = 1, 0
            put(config, uses - take, room)
    return [x for group in open_.values() for x in group]


def placed(ranked: DataFrame, firsts: list[tuple[int, int, int]], plan: list[tuple[dict[int, int], int]]) -> DataFrame:
    """ranked with sequence_id and offset: each length's ranks are dealt to the plan's configurations in order."""
    lows: dict[int, int] = {}
    entries: list[tuple[int, int, int, int, int]] = []
    first = 0
    for config, uses in plan:
        at = 0
        for length, copies in sorted(config.items(), reverse=True):
            low = lows.get(length, 0)
            entries.append((length, low, first, copies, at))
            lows[length] = low + copies * uses
            at += copies * length
        first += uses
    entries.sort()
    lengths, low, sequence, copies, offset = np.array(entries, np.int64).reshape(-1, 5).T
    shift = np.int64(1) << np.int64(44)
    keys = lengths * shift + low
    parts, own_lengths, begins = np.array(sorted(firsts), np.int64).reshape(-1, 3).T
    part_keys = parts * shift + own_lengths
    shared = ranked.sparkSession.sparkContext.broadcast((keys, low, sequence, copies, offset, part_keys, begins))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, low, sequence, copies, offset, part_keys, begins = shared.value
        own = np.asarray(batch.column("length"))
        rank = np.asarray(batch.column("own")) + begins[np.searchsorted(part_keys, np.asarray(batch.column("part")) * shift + own)]
        at = np.searchsorted(keys, own * shift + rank, side="right") - 1
        slot = rank - low[at]
        out = {"sequence_id": sequence[at] + slot // copies[at], "offset": offset[at] + slot % copies[at] * own}
        columns = [batch.column(c) for c in names]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(v, pa.int64()) for v in out.values())], [*names, *out])

    names = [c for c in ranked.columns if c not in ("part", "own")]
    schema = ", ".join([*(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in names), "sequence_id long", "offset long"])
    return ranked.mapInArrow(by_batch(run), schema)


def ranked(df: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """df with part, a range of the order of length and a hash, and own, a row's number among those of its length in its part."""

    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            lengths = np.asarray(batch.column("length"))
            if not len(lengths):
                continue
            begins = np.flatnonzero(np.diff(lengths, prepend=-1))
            own = np.arange(len(lengths)) - np.repeat(begins, np.diff([*begins, len(lengths)]))
            head = begins[1] if len(begins) > 1 else len(lengths)
            if lengths[0] == last:
                own[:head] += seen
            last, seen = int(lengths[-1]), int(own[-1]) + 1
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(np.full(len(lengths), part), pa.int64()), pa.array(own, pa.int64())], [*names, "part", "own"])

    keys = [F.col("length"), F.xxhash64(*order), *map(F.col, order)]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in df.columns)
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"{kinds}, part long, own long")


def packed(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """pieces() with sequence_id and offset."""
    cut = stored(pieces(df, tokenizer, id_col, text_col, capacity, with_ids), "pieces")
    own = stored(ranked(cut, (id_col, "piece", "ids_crc32")), "ranked")
    counts, firsts = np.zeros(capacity + 1, np.int64), []
    for row in own.groupBy("part", "length").count().orderBy("part", "length").collect():  # ranges meet at an edge, so at most their number and capacity rows
        firsts.append((row["part"], row["length"], int(counts[row["length"]])))
        counts[row["length"]] += row["count"]
    return placed(own, firsts, configurations(counts, capacity))

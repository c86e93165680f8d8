"""Reordering values within rows so that columns become more even.

The global sort puts common values first, in plain DataFrame operations. Its refinement climbs: each
round measures how often each value stands in each column and then places every row's values where they
are commonest, best pairs first. The entropy permutation packs the commonest value and column pairs of
what is left, one pair a time, on the driver and within a limit of cells.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ENTROPY_CELLS = 2_000_000
MAX_SHARED_SCORES = 1_000_000  #: pairs of value and column in a refinement's broadcast
SHORT, SLICE = 16, 2000  #: rows of up to SHORT cells are dealt side by side; SLICE rows with their scores at a time


@dataclass(frozen=True)
class PermutationConfig:
    """Base of the permutation configurations."""


@dataclass(frozen=True)
class GlobalSortPermutationConfig(PermutationConfig):
    refinement_iterations: int = 5


@dataclass(frozen=True)
class EntropyPermutationConfig(PermutationConfig):
    pass


def global_sort(df: DataFrame, key: str = "key", values: str = "values") -> DataFrame:
    """key and values by how common each value is overall, then by value."""
    cells = df.select(key, F.posexplode(values).alias("pos", "value"))
    counts = cells.groupBy("value").agg(F.count("*").alias("n"))
    sorted_ = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("value"), "pos")))
    own = cells.join(counts, "value").groupBy(key).agg(F.transform(sorted_, lambda x: x["value"]).alias(values))
    empty = df.where(F.size(values) == 0).select(key, values)
    return own.unionByName(empty)


def _dense(begins: np.ndarray, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The scores at the first SHORT columns: a row for each begin, 0 where there is none."""
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    near = pos < SHORT
    table = np.zeros((len(begins) - 1, min(SHORT, int(pos.max(initial=0)) + 1)), np.int64)
    table[owner[near], pos[near]] = n[near]
    return table


def dealt(sizes: np.ndarray, rank: np.ndarray, code: np.ndarray, begins: np.ndarray, pos: np.ndarray, n: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """For each place of rows of these sizes the cell, by its number, that goes there.

    rank: the cells' values in order; code: the cells' rows of dense and of begins, which say where in pos and n their scores are.
    Pairs of cell and column go best score first, then by value and column; cells without a column left to wish for take what is free, in order.
    """
    out = np.full(len(rank), -1)
    starts = np.cumsum(sizes) - sizes
    for m in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == m)
        cells = starts[rows][:, None] + np.arange(m)
        if m > SHORT:
            for own in cells:
                parts = [slice(begins[c], begins[c + 1]) for c in code[own].tolist()]
                wish_pos, wish_n = (np.concatenate([x[p] for p in parts]) for x in (pos, n))
                which = np.repeat(np.arange(m), [p.stop - p.start for p in parts])
                order = np.lexsort((which, wish_pos, rank[own][which], -wish_n))
                slots, free, done = np.full(m, -1), m, np.zeros(m, bool)
                for i, at in zip(which[order].tolist(), wish_pos[order].tolist(), strict=True):
                    if at < m and slots[at] < 0 and not done[i]:
                        slots[at], done[i] = own[i], True
                        free -= 1
                        if not free:
                            break
                slots[slots < 0] = own[~done]
                out[own] = slots
            continue
        by_value = np.take_along_axis(cells, np.argsort(rank[cells], axis=1, kind="stable"), axis=1)
        wish = np.zeros((len(rows), m, m), np.int64)
        wish[:, :, : dense.shape[1]] = dense[code[by_value]][:, :, :m]
        each, slots, left = np.arange(len(rows)), np.full((len(rows), m), -1), np.ones((len(rows), m), bool)
        for _ in range(m):
            best = wish.reshape(len(rows), -1).argmax(axis=1)  # of equal ones the first: the smallest value and column
            i, at = best // m, best % m
            has = wish[each, i, at] > 0
            some, i, at = each[has], i[has], at[has]
            slots[some, at] = by_value[some, i]
            left[some, by_value[some, i] - cells[some, 0]] = False
            wish[some, i, :] = 0
            wish[some, :, at] = 0
        slots[slots < 0] = cells[left]  # a row has as many free columns as cells left, both in order
        out[cells] = slots
    return out


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _placed(df: DataFrame, scores: pa.Table, key: str, values: str) -> DataFrame:
    """df with every row's values dealt by scores (value, pos, n) that all tasks get."""
    names = scores.column("value").combine_chunks()
    distinct = names.unique()
    distinct = distinct.take(pc.sort_indices(distinct))
    code = np.asarray(pc.index_in(names, distinct), np.int64)
    order = np.argsort(code, kind="stable")
    begins = _offsets(np.bincount(code, minlength=len(distinct)))
    shared = df.sparkSession.sparkContext.broadcast((distinct, begins, *(np.asarray(scores.column(c), np.int64)[order] for c in ("pos", "n"))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct, begins, pos, n = shared.value
        dense = _dense(begins, pos, n)
        for batch in batches:
            lists = batch.column(values)
            flat, sizes = lists.flatten(), np.asarray(pc.list_value_length(lists), np.int64)
            code = np.asarray(pc.index_in(flat, distinct), np.int64)
            taken = flat.take(pa.array(dealt(sizes, code, code, begins, pos, n, dense)))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(pa.array(_offsets(sizes), pa.int32()), taken)], [key, values])

    return df.mapInArrow(place, _schema(df, key, values))


def _placed_by_join(df: DataFrame, pairs: DataFrame, key: str, values: str) -> DataFrame:
    """The same where the scores ride along with the cells."""
    cells = df.select(key, F.posexplode(values).alias("pos", "value"))
    scores = pairs.groupBy("value").agg(F.collect_list(F.struct("pos", "n")).alias("scores"))
    rows = cells.join(scores, "value").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "value", "scores"))).alias("cells"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = batch.column("cells")
            flat, sizes = lists.flatten(), np.asarray(pc.list_value_length(lists), np.int64)
            own, riding = flat.field("value"), flat.field("scores")
            begins = _offsets(np.asarray(pc.list_value_length(riding), np.int64))
            pos, n = (np.asarray(riding.flatten().field(c), np.int64) for c in ("pos", "n"))
            rank = np.asarray(pc.rank(own, tiebreaker="dense"), np.int64)
            taken = own.take(pa.array(dealt(sizes, rank, np.arange(len(own)), begins, pos, n, _dense(begins, pos, n))))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(pa.array(_offsets(sizes), pa.int32()), taken)], [key, values])

    placed = rows.mapInArrow(place, _schema(df, key, values))
    return placed.unionByName(df.where(F.size(values) == 0).select(key, values))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _schema(df: DataFrame, key: str, values: str) -> str:
    return f"`{key}` {df.schema[key].dataType.simpleString()}, `{values}` {df.schema[values].dataType.simpleString()}"


def refine_round(df: DataFrame, key: str = "key", values: str = "values", most: int = MAX_SHARED_SCORES) -> DataFrame:
    """Every row's values dealt to its columns by how often a value stands in a column; null cells and rows go.

    At most most pairs of value and column are sent to all tasks, and rows stay where they are; more are joined to the cells.
    """
    cells = df.select(key, F.posexplode(values).alias("pos", "value"))
    pairs = cells.groupBy("value", "pos").agg(F.count("*").alias("n"))
    few = pairs.limit(most + 1).toArrow()
    if len(few) > most:
        return _placed_by_join(df, pairs, key, values)
    own = df.select(key, values).where(F.col(values).isNotNull())
    if few.column("value").null_count:
        own = own.withColumn(values, F.array_compact(values))
        few = few.filter(pc.is_valid(few.column("value")))
    return _placed(own, few, key, values)


def entropy_greedy(matrix: list[list]) -> list[list]:
    """Rows reordered so that the commonest pairs of value and column come first; ties take the smaller value, then column."""
    width = min(map(len, matrix), default=0)
    out: list[dict[int, object]] = [{} for _ in matrix]
    left = [Counter(row[:width]) for row in matrix]
    columns = set(range(width))
    rest = {c: set(range(len(matrix))) for c in columns}
    while any(rest.values()):
        best = None
        for c in sorted(columns):
            counts = Counter(v for r in rest[c] for v in left[r])
            if counts:
                value, n = min(counts.items(), key=lambda x: (-x[1], x[0]))
                if best is None or (-n, value, c) < best[:3]:
                    best = (-n, value, c)
        _, value, column = best
        for r in [r for r in rest[column] if left[r][value] > 0]:
            out[r][column] = value
            left[r] -= Counter([value])
            rest[column].discard(r)
    return [[out[r][c] for c in range(width)] + list(matrix[r][width:]) for r in range(len(matrix))]


def permuted(df: DataFrame, config: PermutationConfig, key: str = "key", values: str = "values") -> DataFrame:
    """key and values reordered by a configuration; each row keeps its values and its length."""
    own = df.select(key, values)
    if isinstance(config, GlobalSortPermutationConfig):
        held = own.persist() if config.refinement_iterations else own
        own = global_sort(held, key, values)
        for _ in range(config.refinement_iterations):
            own = own.persist()
            refined = refine_round(own, key, values)  # has read all of own, so that what own came from may go
            held.unpersist()
            held, own = own, refined
        return own
    if isinstance(config, EntropyPermutationConfig):
        cells = own.agg(F.sum(F.size(values))).first()[0] or 0
        if cells > MAX_ENTROPY_CELLS:
            raise ValueError(f"the entropy permutation takes at most {MAX_ENTROPY_CELLS} cells; use the global sort")
        held = own.orderBy(key).collect()
        return df.sparkSession.createDataFrame([(r[key], v) for r, v in zip(held, entropy_greedy([r[values] for r in held]), strict=True)], own.schema)
    raise ValueError(f"unknown permutation {config!r}")

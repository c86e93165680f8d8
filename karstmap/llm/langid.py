"""Language ID by cross-parsing: the language whose text describes a document in the fewest phrases.

For each language a suffix automaton holds a bounded sample of labelled text: the words of the whole texts of at most
``SAMPLE_DOCS`` documents, taken in the order of a hash of their
ids, those of most documents first and then in the order of a hash, while they come to at most ``SAMPLE_CHARS`` characters. A text is parsed word by word, each with a
space on both sides, into longest matches; phrases, times the bits that point at a place in the
sample, over the letters is the cross-parsing entropy. The smallest wins; ties go to the language
that sorts first. Words met before are looked up, so a worker parses each word once.

Defined results: null texts and texts without a letter give ``und`` and score 0; without any
labelled text all give ``und``; rows with a null id are never learned from and not held out;
repeated rows give repeated rows, and the first in order of texts with one id is learned; very long texts are read whole; other columns are ignored, and
columns to keep that are named like a result get it replaced.
"""

from __future__ import annotations

import hashlib
import json
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karstmap.llm.automaton import SuffixAutomaton
from karstmap.llm.common import by_batch, fold_of, kept

SAMPLE_DOCS, SAMPLE_CHARS = 200, 40_000
CACHE_WORDS = 250_000
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def samples(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """The distinct words to learn of each language. The rank limit is applied before the shuffle, so a hot language sends docs rows a task."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and text is not null and lang is not null")
    few = rows.select("id", "lang").withColumn("rank", rank).where(F.col("rank") <= docs)
    ids = few.groupBy(F.col("id").alias("sample_id")).agg(F.min("lang").alias("own"))  # docs ids of each language
    texts = rows.join(F.broadcast(ids), (F.col("id") == F.col("sample_id")) & (F.col("lang") == F.col("own"))).groupBy("id", "lang").agg(F.min("text").alias("text"))

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [sorted(set(LETTERS.findall(t.lower()))) for t in batch.column("text").to_pylist()]
        at = np.repeat(np.arange(len(found)), list(map(len, found)))
        return pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(at, pa.int64())), pa.array([w for x in found for w in x], pa.string())], ["lang", "word"])

    counts = texts.mapInArrow(by_batch(words), "lang string, word string").groupBy("lang", "word").agg(F.count("*").alias("n"))
    order = (F.desc("n"), F.xxhash64("word"), F.col("word"))
    size = F.sum(F.length("word") + 1).over(Window.partitionBy("lang").orderBy(*order))  # of the sampled documents' words alone
    learned: dict[str, list[str]] = {}
    for row in counts.withColumn("size", size).where(F.col("size") <= chars).orderBy("lang", *order).collect():
        learned.setdefault(row["lang"], []).append(row["word"])
    return learned


class CrossParser:
    """Phrases of a text against the sample of each language."""

    def __init__(self, learned: dict[str, list[str]]):
        self.langs = list(learned)
        self.moves: list[list[dict]] = []
        for own in learned.values():
            automaton = SuffixAutomaton()
            for word in own:
                automaton.add(f" {word} ")
            self.moves.append(automaton.next)
        self.bits = np.array([math.log2(2 + sum(len(w) + 1 for w in own)) for own in learned.values()])
        self.places: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.langs) + 1), np.int32)

    @staticmethod
    def phrases(moves: list[dict], text: str) -> int:
        count, state = 0, 0
        for char in text:
            step = moves[state].get(char)
            if step is None:
                count += 1
                step = moves[0].get(char, 0) if state else 0
                if state and not step:
                    count += 1
            state = step
        return count + (state > 0)

    def place(self, token: str) -> int:
        """The row of the table that counts a token's phrases for each language and its letters."""
        at = len(self.places)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        words = LETTERS.findall(token.lower())
        self.table[at, :-1] = [sum(self.phrases(moves, f" {w} ") for w in words) for moves in self.moves]
        self.table[at, -1] = sum(map(len, words))
        self.places[token] = at
        return at

    def entropies(self, text: str) -> np.ndarray | None:
        """Bits a letter for each language; None without letters."""
        if len(self.places) > CACHE_WORDS:
            self.places.clear()
        tokens = text.split()
        get, place = self.places.get, self.place
        at = [i if (i := get(t)) is not None else place(t) for t in tokens]
        total = self.table[at].sum(axis=0, dtype=np.int64) if at else np.zeros(1)
        return total[:-1] * self.bits / total[-1] if total[-1] else None

    def predict(self, text: str | None) -> tuple[str, float]:
        bits = self.entropies(text) if text and self.langs else None
        if bits is None:
            return UNKNOWN, 0.0
        best = int(bits.argmin())
        return self.langs[best], float(1 / np.exp2(bits[best] - bits).sum())


def identified(df: DataFrame, learned: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, lang_pred, score and the columns to keep."""
    shared = df.sparkSession.sparkContext.broadcast(learned)
    made: dict[str, CrossParser] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made["it"] = _parser(shared.value)
        found = [made["it"].predict(t) for t in batch.column(text_col).to_pylist()]
        out = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
        return pa.RecordBatch.from_arrays([*map(batch.column, names), *out], [*names, "lang_pred", "score"])

    names = [c for c in dict.fromkeys((id_col, *keep)) if c not in ("lang_pred", "score")]
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names]
    return df.select(*dict.fromkeys((*names, text_col))).mapInArrow(by_batch(run), ", ".join([*kinds, "lang_pred string", "score double"]))


def _parser(learned: dict[str, list[str]]) -> CrossParser:
    """One parser for a worker process, kept from task to task while the sample is the same."""
    key = hashlib.sha256(json.dumps(list(learned.items())).encode()).digest()
    return kept("parser", key, lambda: CrossParser(learned))


def learnable(df: DataFrame, id_col: str = "doc_id", folds: int = 4, held: int = 2) -> DataFrame:
    return df.where(fold_of(id_col, folds) != held)

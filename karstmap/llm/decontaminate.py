"""Benchmark decontamination: documents streamed through a suffix automaton of the benchmark.

The automaton is a generalised one over the items' words; reading a document it keeps, word by
word, the length of the longest match that ends there. Where that length reaches the window,
the last ``window`` words are hit, and the state's items are found. An item shorter than the
window is itself one window and is found at the state that its words lead to.

The benchmark is read in blocks of at most ``block_words`` words, so an automaton sent to the
executors has a fixed bound; a larger benchmark takes more passes, whose hits are merged.

Defined results: null or wordless texts have no words, no hits and are clean; items without
words or with a null id are never found; repeated items with one id count once; repeated
documents give repeated rows; very long texts are read whole, word by word; spans that touch or overlap are one, and items found are sorted; other columns are ignored,
and columns to keep that are named like a result get it replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karstmap.llm.automaton import SuffixAutomaton
from karstmap.llm.common import by_batch, utf8

#: A-Z become lower case, other ASCII than letters and digits a space.
NORMAL = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
BLOCK_WORDS = 500_000


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


class ItemAutomaton(SuffixAutomaton):
    """Generalised suffix automaton of word sequences, with the items of each state."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        super().__init__()
        self.window, self.ids, self.vocabulary, self.shortest = window, [], {}, window
        coded = []
        for name, item in items:
            if item:
                self.ids.append(name)
                coded.append([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in item])
                self.shortest = min(self.shortest, len(item))
        for item in coded:
            self.add(item)
        self.items: list[set[int]] = [set() for _ in self.next]
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for k, item in enumerate(coded):
            state = 0
            for word in item:
                state = self.next[state][word]
                up = state
                while up > 0 and k not in self.items[up]:
                    self.items[up].add(k)
                    up = self.link[up]
            if len(item) < window:
                self.whole.setdefault(state, []).append((len(item), k))

    def find(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged spans of hit words (end exclusive) and the numbers of the items found."""
        if len(text) < self.shortest:
            return [], set()
        codes = np.fromiter(map(self.vocabulary.get, text, iter(lambda: -1, 0)), np.int32, len(text))
        known = np.flatnonzero(np.diff(np.concatenate(([0], codes >= 0, [0]))))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        moves, link, length, window = self.next, self.link, self.length, self.window
        for start, end in known.reshape(-1, 2).tolist():
            if end - start < self.shortest:
                continue
            state = matched = 0
            for i, word in enumerate(codes[start:end].tolist(), start):
                while word not in moves[state]:
                    if not state:
                        break
                    state = link[state]
                    matched = length[state]
                else:
                    state = moves[state][word]
                    matched += 1
                size = 0
                if matched >= window:
                    up = state
                    while length[link[up]] >= window:
                        up = link[up]
                    found |= self.items[up]
                    size = window
                if self.whole:
                    up = state
                    while up > 0:
                        for k, item in self.whole.get(up, ()):
                            if k <= matched:
                                found.add(item)
                                size = max(size, k)
                        up = link[up]
                if size:
                    first = i + 1 - size
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, i + 1))
        return spans, found


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> int:
    """Blocks that keep an automaton near block_words words; words are at least two bytes with their space."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-size // (2 * block_words)))


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), block_words: int = BLOCK_WORDS) -> DataFrame:
    """id_col, n_words, spans (array of start and end word), items (array of item ids as text) and the columns to keep."""
    keep = tuple(c for c in keep if c not in ("n_words", "spans", "items"))
    blocks = item_blocks(benchmark, block_words)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out = docs.select(*dict.fromkeys((id_col, text_col, *keep)))
    for block in range(blocks):
        rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
        if blocks > 1:
            rows = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        items = [(r["item_id"], words(r["text"].encode())) for r in rows.collect()]  # one bounded block
        first = block == 0
        stay = keep if block + 1 == blocks else tuple(dict.fromkeys((text_col, *keep)))
        cache: dict[str, ItemAutomaton] = {}

        def run(batch: pa.RecordBatch, items=items, cache=cache, first=first, stay=stay) -> pa.RecordBatch:
            if not cache:
                cache["it"] = ItemAutomaton(items, window)
            automaton = cache["it"]
            counts, spans, names = [], [], []
            before = [None] * batch.num_rows if first else list(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True))
            for text, old in zip(utf8(batch, text_col), before, strict=True):
                own = words(text)
                hit, found = automaton.find(own)
                named = {automaton.ids[k] for k in found}
                if old:
                    hit = merged([*hit, *((x["start"], x["end"]) for x in old[0])])
                    named |= set(old[1])
                counts.append(len(own))
                spans.append([{"start": a, "end": b} for a, b in hit])
                names.append(sorted(named))
            columns = [batch.column(id_col), pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(names, pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays([*columns, *map(batch.column, stay)], [id_col, "n_words", "spans", "items", *stay])

        schema = f"`{id_col}` {kind}, n_words long, spans array<struct<start:long,end:long>>, items array<string>" + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in stay)
        out = out.mapInArrow(by_batch(run), schema)
    return out


def verdicts(found: DataFrame, coverage: int = 20) -> DataFrame:
    """find_items' rows with n_hit, n_items, items_sha256 and contaminated: hit words are at least 1 / coverage of the words."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return (
        found.withColumn("n_hit", hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * coverage >= F.col("n_words")))
    )


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without its hit words and what stands between them; the rest is joined by one space."""
    if text is None or not spans:
        return text
    data = text.encode()
    flat = data.translate(NORMAL)
    places, at = [], 0
    for word in flat.split():
        at = flat.index(word, at)
        places.append((at, at + len(word)))
        at += len(word)
    kept, last = [], 0
    for a, b in spans:
        kept.append(data[last : places[a][0]])
        last = places[b - 1][1]
    kept.append(data[last:])
    return b" ".join(x for x in (k.strip() for k in kept) if x).decode()


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage: int = 20, max_span: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text_col, contaminated and removed_words: contaminated texts become null, and spans of over max_span words leave the others."""
    judged = verdicts(find_items(docs, benchmark, window, id_col, text_col, keep=(text_col,)), coverage).select(id_col, text_col, "n_words", "spans", "contaminated")
    limit = max_span if max_span is not None else 1 << 62

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, gone = [], []
        for text, n, spans, bad in zip(*(batch.column(c).to_pylist() for c in (text_col, "n_words", "spans", "contaminated")), strict=True):
            long = [(x["start"], x["end"]) for x in spans if x["end"] - x["start"] > limit]
            texts.append(None if bad else without_spans(text, long))
            gone.append(n if bad else sum(b - a for a, b in long))
        return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(texts, pa.string()), batch.column("contaminated"), pa.array(gone, pa.int64())], [id_col, text_col, "contaminated", "removed_words"])

    kinds = {c: docs.schema[c].dataType.simpleString() for c in (id_col, text_col)}
    return judged.mapInArrow(by_batch(cut), f"`{id_col}` {kinds[id_col]}, `{text_col}` string, contaminated boolean, removed_words long")

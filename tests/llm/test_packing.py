"""Packing against a plain tokenization and the rules of a packing."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from karstmap.llm import common, packing, queries

SF = "/root/testdata/sf0.001"


def plain_pieces(docs, capacity=4096):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.public_tokenizer())
    out = []
    for name, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            own = ids[k : k + capacity]
            out.append((name, k // capacity, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    return sorted(out)


def check_packing(rows, capacity=4096):
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_packing_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op4_packing(spark, SF).collect()
    plain = plain_pieces(docs)
    assert sorted(tuple(r)[:5] for r in rows) == plain
    assert check_packing(rows) <= -(-sum(x[3] for x in plain) // 4096) + 1


@pytest.mark.parametrize("parts", [1, 7])
def test_packing_edges(spark, monkeypatch, parts):
    spread = packing.ranked
    monkeypatch.setattr(packing, "ranked", lambda df, order: spread(df.repartition(parts), order))
    texts = [None, "", " \n\t ", "it's 10,000 o'clock…  x y", "<|endoftext|> a<|startoftext|>b", "ΣΑΣ İI ﬁ é ́x", "word " * 9000, "Don't, (stop). A.B", "a" * 5000, "a" * 5000, "日本語 テキスト", "\x1c\x85x\x0by"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(8, "a" * 5000)]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in docs], "doc_id long, text string, rank int, part int")
    rows = packing.packed(df, queries.public_tokenizer()).collect()
    assert sorted(tuple(r)[:5] for r in rows) == plain_pieces(docs)
    check_packing(rows)
    assert packing.packed(df.limit(0), queries.public_tokenizer()).count() == 0


def test_plan_covers_all():
    rng = np.random.default_rng(4)
    for shape in ("uniform", "short", "long", "one", "two"):
        n = {"uniform": rng.integers(1, 101, 3000), "short": rng.integers(1, 20, 3000), "long": rng.integers(40, 101, 3000), "one": np.full(1000, 34), "two": np.repeat([67, 33], 500)}[shape]
        counts = np.bincount(n, minlength=101)
        plan = packing.configurations(counts, 100)
        covered = np.zeros(101, int)
        for config, uses in plan:
            assert sum(k * v for k, v in config.items()) <= 100
            for k, v in config.items():
                covered[k] += v * uses
        assert (covered == counts).all()
        used, least = sum(u for _, u in plan), {"long": int((n > 50).sum())}.get(shape, -(-int(n.sum()) // 100))
        assert used <= {"one": 500, "two": 500}.get(shape, least * 1.03 + 1)


def test_program_beats_best_fit():
    n = 60  # six kinds of ninety-nine in a hundred; best fit pairs them badly
    counts = np.zeros(4097, np.int64)
    counts[[2069, 1096, 1055, 932]] = [6 * n, 6 * n, 6 * n, 12 * n]
    program, groups, need = packing.linear_program(counts)
    assert sorted(map(tuple, groups)) == [(932,), (1055,), (1096,), (2069,)]
    assert np.isclose(program.bound, 9 * n) and 9 * n <= program.value * (1 + 1e-9) <= 9 * n * (1 + packing.GAP) * (1 + 2e-9)
    assert sum(uses for _, uses in packing.configurations(counts)) == 9 * n
    assert sum(uses for _, uses in packing.best_fit([], counts, 4096)) == 11 * n


def test_program_value_bound_and_rounding():
    rng = np.random.default_rng(6)
    for _ in range(3):
        counts = np.zeros(4097, np.int64)
        counts[rng.integers(400, 3000, 40)] = rng.integers(20, 300, 40)
        program, groups, need = packing.linear_program(counts)
        covered = np.zeros(len(groups))
        for config, fraction in program.use.items():
            assert sum(groups[i][0] * c for i, c in config) <= 4096
            for i, c in config:
                covered[i] += c * fraction
        assert (covered >= need * (1 - 1e-9)).all()
        assert program.bound <= program.value * (1 + 1e-9) <= program.bound * 1.05
        assert program.bound >= sum(groups[i][0] * n for i, n in enumerate(need)) / 4096 * (1 - 1e-9)
        used = np.zeros(len(groups), int)
        for config, uses in program.rounded(need):
            for i, c in config:
                used[i] += c * uses
        assert (used <= need).all() and used.sum() >= 0.9 * need.sum()
        assert sum(u for _, u in packing.configurations(counts)) <= program.value + len(groups)


def test_knapsack_is_best():
    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths, counts, values = np.sort(rng.choice(np.arange(2, 12), 3, False)), rng.integers(1, 4, 3), rng.random(3)
        got = packing.priced(values, lengths, counts, 20)
        best = max(float(values @ x) for x in np.ndindex(*(counts + 1)) if lengths @ np.array(x) <= 20)
        assert np.isclose(sum(values[i] * n for i, n in got.items()), best)
        assert sum(lengths[i] * n for i, n in got.items()) <= 20


def test_word_store(monkeypatch):
    """Words and their ids are arrays, of a bounded number, and those that many slices had stay when the store is full."""
    monkeypatch.setattr(packing, "CACHE_WORDS", 400)
    words, plain = packing.WordIds(queries.public_tokenizer()), packing.WordIds(queries.public_tokenizer())
    rng = np.random.default_rng(3)
    for k in range(30):
        texts = [" ".join(["common", "it's", *("".join(map(chr, rng.integers(97, 123, 4))) for _ in range(20))]) for _ in range(10)] + [None, "", "a1 . Foo.\n\tbar"]
        flat, ends = words.ids(pa.array(texts, pa.string()))
        want = plain.encode([t or "" for t in texts])
        assert [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [x.tolist() for x in want]
        assert len(words.words) == len(words.codes) == len(words.met) <= 400 + 250
        assert not k or "common" in words.words.to_pylist()
    assert len(words.ids(pa.array([], pa.string()))[0]) == 0


def test_worker_keeps_one_thing():
    """What a stage's workers hold from task to task goes when the next stage's is made."""
    made = [common.kept(name, 1, lambda name=name: [name]) for name in ("parser", "words")]
    assert common.kept("words", 1, list) is made[1] and common.kept("parser", 1, list) == []
    common._KEPT.clear()

"""Language model and toxicity against plain versions and held-out rows."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from karstmap.llm import lmscore, queries, toxicity

SF = "/root/testdata/sf0.001"


def plain_base(docs, held=1):
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None]
    counts = Counter(w for k, t in docs if k is not None and zlib.crc32(str(k).encode()) % 5 != held for w in cut(t))
    n, v = sum(counts.values()), len(counts)
    return [(k, len(cut(t)), sum(counts[w] > 0 for w in cut(t)), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in cut(t))) for k, t in docs]


@pytest.mark.parametrize("head", [lmscore.HEAD_WORDS, 50, 0])
def test_base_scores(spark, head):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = lmscore.language_model_scores(spark.read.parquet(f"{SF}/documents.parquet"), head_words=head, rounds=1).collect()
    got = {r.doc_id: r for r in rows}
    for k, n, known, total, base in plain_base(docs):
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and math.isclose(r.base_score, base, rel_tol=1e-9)


def test_model_beats_base(spark):
    rows = [r for r in queries.op5_lm_scoring(spark, SF).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert all(r.score < 0 for r in rows)


def test_lm_edges(spark):
    docs = [(1, None), (2, ""), (3, "a b a"), (3, "a b a"), (None, "a z"), (5, "q " * 5000), (6, "A\x0bB\x85c é É"), (11, "new words"), (12, "x")]
    df = spark.createDataFrame([(a, b, 0, "r") for a, b in docs], "doc_id long, text string, n long, word string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lmscore.language_model_scores(df).collect())
    assert got == sorted((k is None, k or 0, n, known, total, round(base, 6)) for k, n, known, total, base in plain_base(docs))
    assert lmscore.language_model_scores(df.limit(0)).count() == 0
    none = lmscore.language_model_scores(df.where("doc_id is null")).collect()
    assert [r.train_tokens for r in none] == [0] and none[0].n_known == 0 and np.isfinite(none[0].score)


def model(k=3, v=5, seed=6):
    draw = np.random.default_rng(seed)
    one = lambda *s: (x := draw.random(s)) / x.sum(axis=-1, keepdims=True)
    return lmscore.Model(one(k), one(k, k), one(k, v).T)


def test_forward_is_exact():
    m, draw = model(), np.random.default_rng(7)
    for size in (1, 2, 5):
        x = draw.integers(0, 5, size)
        total = 0.0
        for path in itertools.product(range(3), repeat=size):
            p = m.start[path[0]] * m.emit[x[0], path[0]]
            for t in range(1, size):
                p *= m.move[path[t - 1], path[t]] * m.emit[x[t], path[t]]
            total += p
        assert np.isclose(m.logp([x.astype(np.int32)])[0], np.log(total))
    coded = [draw.integers(0, 5, n).astype(np.int32) for n in (1, 40, 7, 100, 33, 8)]
    assert np.allclose(m.logp(coded, chunk=8), m.logp(coded, chunk=1000))


def test_expected_counts_are_exact():
    m, draw = model(), np.random.default_rng(8)
    coded = [draw.integers(0, 5, n).astype(np.int32) for n in (4, 1, 3, 4)]
    first, moves, emitted = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for x in coded:
        paths = []
        for path in itertools.product(range(3), repeat=len(x)):
            p = m.start[path[0]] * m.emit[x[0], path[0]]
            for t in range(1, len(x)):
                p *= m.move[path[t - 1], path[t]] * m.emit[x[t], path[t]]
            paths.append((path, p))
        total = sum(p for _, p in paths)
        for path, p in paths:
            first[path[0]] += p / total
            for t, s in enumerate(path):
                emitted[x[t], s] += p / total
                if t:
                    moves[path[t - 1], s] += p / total
    got = m.expected(coded)
    assert all(np.allclose(a, b) for a, b in zip(got, (first, moves, emitted), strict=True))


def test_toxicity_query(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = queries.op2_toxicity(spark, "/root/testdata/sf0.01").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == 1 and t == 1 for p, t in held) >= 0.6 * sum(t for _, t in held) and sum(p == 1 and t == 0 for p, t in held) <= 0.05 * len(held)


def test_toxicity_edges(spark):
    docs = [(i, "good day to you" if i % 2 else "you awful idiot") for i in range(60)] + [(100, None), (101, ""), (102, "idiot"), (102, "idiot"), (None, "idiot")]
    labels = [(i, 1 - i % 2) for i in range(60)] + [(0, 0), (100, 1), (None, 1), (3, 5), (4, None)]
    df = spark.createDataFrame([(a, b, 0.5) for a, b in docs], "doc_id long, text string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, toxic long")
    rows = toxicity.scored(df, toxicity.trained(df, marks)).collect()
    assert len(rows) == len(docs)
    by = {r.doc_id: r for r in rows}
    assert by[102].predicted == 1 and by[1].predicted == 0 and by[100].score == by[101].score
    assert {r.score for r in toxicity.scored(df, toxicity.trained(df, marks.limit(0))).collect()} == {1 / (1 + math.exp(500))}


def test_counterfactuals_cut_bias():
    draw = np.random.default_rng(9)
    texts, toxic = [], []
    for i in range(400):
        bad = i % 2
        group = "muslims" if draw.random() < (0.9 if bad else 0.1) else "christians"
        texts.append(f"the {group} {'are vile scum' if bad and draw.random() < 0.8 else 'live here'}")
        toxic.append(bad)
    rows, pairs = [sorted(toxicity.text_features(t)) for t in texts], [p for t in texts for p in toxicity.counterfactuals(t)]
    gap = lambda c: abs(c.score("muslims live here") - c.score("christians live here"))
    plain, fair = toxicity.fit(rows, np.array(toxic), pairs, penalty=0), toxicity.fit(rows, np.array(toxic), pairs, penalty=5)
    assert gap(fair) < 0.2 * gap(plain) and fair.score("vile scum") > 0.5


def test_fit_is_the_penalised_optimum():
    """The weights against Newton's method on the same objective over a dense matrix."""
    draw = np.random.default_rng(14)
    words = ["muslims", "jews", "vile", "calm", "scum"]
    texts = [" ".join(w for w, p in zip(words, (0.6, 0.3, 0.5, 0.3, 0.4) if i % 2 else (0.3, 0.6, 0.1, 0.5, 0.1), strict=True) if draw.random() < p) for i in range(300)]
    toxic = np.arange(300) % 2
    rows, pairs = [sorted(toxicity.text_features(t)) for t in texts], [p for t in texts for p in toxicity.counterfactuals(t)]
    for penalty in (0.0, 1.0, 10.0):
        got = toxicity.fit(rows, toxic, pairs, penalty, steps=6000)
        names = sorted(got.weights)
        x = np.array([[f in r for f in names] for r in rows], float)
        d = np.array([[(f in a) * 1.0 - (f in b) for f in names] for a, b in pairs])
        d = d[np.abs(d).sum(axis=1) > 0]
        mass, w, bias = np.maximum(x.mean(axis=0), 1e-3), np.zeros(len(names)), 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(x @ w + bias)))
            slope = np.append(x.T @ (p - toxic) / 300 + toxicity.RIDGE * mass * w + 2 * penalty * d.T @ (d @ w) / len(d), (p - toxic).mean())
            one = np.column_stack([x, np.ones(300)])
            curve = one.T @ (one * (p * (1 - p))[:, None]) / 300
            curve[:-1, :-1] += np.diag(toxicity.RIDGE * mass) + 2 * penalty * d.T @ d / len(d)
            change = np.linalg.lstsq(curve, slope, rcond=None)[0]
            w, bias = w - change[:-1], bias - change[-1]
        plain = 1 / (1 + np.exp(-(x @ w + bias)))
        assert np.allclose(plain, [got.score(t) for t in texts], atol=2e-3)


def test_penalty_acts_on_the_corpus(spark):
    """Neutral mentions in held-out neutral texts: swapping the group changes scores far less with the penalty than without."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("toxic = 0").join(docs, "doc_id").where(toxicity.fold_of("doc_id", 5) == 0).orderBy("doc_id").limit(40).collect()
    sentences = [x for r in held for x in toxicity.SENTENCES.findall(r.text)[:2]]
    change = {}
    for penalty in (0.0, toxicity.PENALTY):
        own = toxicity.trained(docs, toxicity.learnable(labels), penalty=penalty)
        change[penalty] = np.mean([abs(own.score(f"{w} {x}") - own.score(toxicity.swapped(f"{w} {x}".lower()))) for w in toxicity.TERMS for x in sentences])
        if penalty:
            assert not any(own.score(f"{w} {x}") >= 0.5 for w in toxicity.TERMS for x in sentences)
    assert 0 < change[toxicity.PENALTY] < 0.3 * change[0.0]


def test_toxicity_reads_whole_texts(spark):
    long = "plain words and more " * 20_000
    docs = [(i, long + ("idiot scum" if i % 2 else "end here")) for i in range(24)] + [(50, long * 3)]
    df = spark.createDataFrame([(a, b, 0.1, 7, "x") for a, b in docs], "doc_id long, text string, score double, predicted int, label string")
    marks = spark.createDataFrame([(i, i % 2, "z") for i in range(24)], "doc_id long, toxic long, text string")
    rows = toxicity.scored(df, toxicity.trained(df, marks), keep=("score", "label")).collect()
    assert all(r.predicted == r.doc_id % 2 for r in rows) and rows[0].label == "x" and rows[0].asDict().keys() == {"doc_id", "label", "score", "predicted"}
    assert len(toxicity.counterfactuals("the men. " * 30)) == 31


def test_toxicity_keeps_the_prior_under_caps(spark):
    docs = [(i, ("nice calm words" if i % 10 else "vile awful words") if i % 3 else "plain words") for i in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(2000)], "doc_id long, toxic long")
    mean = lambda rows: np.mean([r.score for r in toxicity.scored(df, toxicity.trained(df, marks, rows=rows)).collect()])
    assert abs(mean(5000) - 0.1) < 0.02 and abs(mean(150) - 0.1) < 0.03


def test_model_is_whole(spark):
    df = spark.range(40_000).selectExpr("concat_ws(' ', array_repeat(concat('w', id), 4)) AS text")
    trained = lmscore.learned_counts(df)
    assert trained.symbols == lmscore.FIRST_HEAD + 40_000 and (lmscore.STATES, lmscore.ROUNDS, lmscore.HEAD_WORDS) == (8, 4, 200_000)
    few = lmscore.learned_counts(df, head_words=39_999)  # all have one count, so all are told by their endings
    assert few.symbols == lmscore.FIRST_HEAD and few.total == trained.total == 200_000 and few.distinct == 40_001
    words = [r.word for r in few.counts.collect() if r.word]
    by = Counter(lmscore.ending(bytes(w)) for w in words)
    assert all(few.held[s] == 4 * n for s, n in by.items())
    odd = spark.createDataFrame([(b"a",), (b"ab",), (b"abc",), ("é€x".encode(),), (b"long words",)], "word binary")
    assert all(r.s == lmscore.ending(bytes(r.word)) for r in odd.select("word", lmscore.ending_of("word").alias("s")).collect())


def test_scores_equal_a_plain_model(spark, monkeypatch):
    """The query's score, from the counts and the trained model, by a recursion over plain numbers; the model by plain Baum-Welch from the same start."""
    seen = {}
    whole = lmscore.seeded
    monkeypatch.setattr(lmscore, "seeded", lambda *a: seen.setdefault("model", whole(*a)))
    docs = [(i, t) for i, t in enumerate(["a b a c", "b a b", "", None, "c c d a b", "a b", "e f a a b", "rare one", "a b", "d a"])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = lmscore.language_model_scores(df, states=2, rounds=2, head_words=2).collect()
    train = [t for k, t in docs if zlib.crc32(str(k).encode()) % 5 != 1]
    counts = Counter(w for t in train for w in (t or "").encode().split())
    top = sorted(counts, key=lambda w: (-counts[w], w))
    head = next(top[:n] for n in (2, 1, 0) if all(counts[w] >= 4 for w in top[:n]) and len({math.floor(math.log2(counts[w])) for w in top[:n]} & {math.floor(math.log2(counts[w])) for w in top[n:]}) == 0)
    place = {w: lmscore.FIRST_HEAD + i for i, w in enumerate(head)}
    code = lambda t: [place.get(w) or lmscore.ending(w) for w in (t or "").encode().split()] + [0]
    held, kinds = Counter(s for t in train for s in code(t)), Counter(lmscore.ending(w) for w in counts if w not in place)
    model = seen["model"]
    unigram = np.array([held[s] + 0.5 for s in range(lmscore.FIRST_HEAD + len(head))])
    unigram /= unigram.sum()
    for _ in range(2):
        model = lmscore.fitted(*plain_expected(model, [code(t) for t in train]), unigram)
    for r, (k, t) in zip(sorted(rows), docs, strict=True):
        p = plain_forward(model, code(t))
        for w in (t or "").encode().split():
            if w not in place:
                p *= (counts[w] + 0.5) / (held[lmscore.ending(w)] + 0.5 * (kinds[lmscore.ending(w)] + 1))
        assert r.doc_id == k and math.isclose(r.score, math.log10(p), rel_tol=1e-5)


def plain_forward(m, x):
    a = m.start * m.emit[x[0]]
    for s in x[1:]:
        a = (a @ m.move) * m.emit[s]
    return a.sum()


def plain_expected(m, coded):
    k = len(m.start)
    first, moves, emitted = np.zeros(k), np.zeros((k, k)), np.zeros(m.emit.shape)
    for x in coded:
        a = [m.start * m.emit[x[0]]]
        for s in x[1:]:
            a.append((a[-1] @ m.move) * m.emit[s])
        b = [np.ones(k)]
        for s in reversed(x[1:]):
            b.append(m.move @ (m.emit[s] * b[-1]))
        b.reverse()
        total = a[-1].sum()
        first += a[0] * b[0] / total
        for t, s in enumerate(x):
            emitted[s] += a[t] * b[t] / total
            if t:
                moves += np.outer(a[t - 1], m.emit[s] * b[t]) * m.move / total
    return first, moves, emitted


def test_chunks_change_nothing():
    m, draw = model(v=50), np.random.default_rng(12)
    coded = [draw.integers(0, 50, n).astype(np.int32) for n in (4, 1, 9, 120, 17, 64, 65)]
    whole = plain_expected(m, coded)
    for chunk in (1, 7, 64, 1000):
        assert all(np.allclose(a, b) for a, b in zip(m.expected(coded, chunk), whole, strict=True))
        assert np.allclose(m.logp(coded, chunk), [math.log(plain_forward(m, x)) for x in coded])
    single = lmscore.Model(*(x.astype(np.float32) for x in (m.start, m.move, m.emit)))
    assert all(np.allclose(a, b, rtol=1e-3) for a, b in zip(single.expected(coded, 16), whole, strict=True))


def test_words():
    """Words split in Arrow are those of bytes."""
    texts = [None, "", "  ", " A\t\x0bb\x1cÉ É  ", "x\x85Y z\n"]
    ends, words = lmscore.words_of(pa.array(texts, pa.string()))
    got = words.cast(pa.string()).to_pylist()
    assert [[w.encode() for w in got[a:b]] for a, b in zip(ends[:-1], ends[1:], strict=True)] == [(t or "").encode().lower().split() for t in texts]

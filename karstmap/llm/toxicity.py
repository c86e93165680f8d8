"""Toxicity by a counterfactual-regularised classifier.

A logistic regression over the words of a text, and the first letters of each, learns from a
bounded sample of labelled rows: of each label the ``SAMPLE_ROWS`` rows first in the order of a hash
of their ids, each with its whole text. Each row stands for as many as its label has for
each sampled one, in the loss and in the penalty, so the sample leaves the share of toxic texts as it is. Features are kept where a likelihood
ratio test ties them to the label.

A counterfactual is a labelled sentence in which an identity term is swapped for the next of its group. Every sentence of the sample that names a
group gives one; and in each labelled text, a term drawn by the text's hash is put ahead of one of its sentences, as a neutral mention
that the text is learned with as well, whose swap is another. The fit pays for the square of the difference between
the two scores, whichever features differ. So a group's name alone says nothing, and neutral mentions aren't taken for toxic ones. Terms of groups are features
whatever the test says, as the penalty is on them.

Scoring reads whole texts; each worker looks up words it met before.

Defined results: null and empty texts get the score of a text without features; very long texts are read whole; without labelled
rows of both kinds every score is the share of toxic rows, or 0 without any; repeated labels of a
document count once, as toxic if one says so; labels other than 0 and 1, and null ids, are ignored; of different texts
with one labelled id the first in their order is learned; ties of the hash go to the smaller id. Columns to keep that are named like a result get it replaced.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karstmap.llm.common import by_batch, fold_of

SAMPLE_ROWS, FEATURES = 3000, 20_000
LEAST_RATIO, RIDGE, PENALTY, STEPS = 10.0, 1e-3, 1.0, 400
CACHE_WORDS = 250_000
WORDS = re.compile(r"[^\W\d_]+")
SENTENCES = re.compile(r"[^.!?\n]+")

#: Groups of identity terms that may stand for each other.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual"),
    ("muslim", "jewish", "christian", "hindu", "buddhist", "sikh", "atheist"),
    ("muslims", "jews", "christians", "hindus", "buddhists", "sikhs", "atheists"),
    ("black", "white", "asian", "hispanic", "latino", "african", "european"),
    ("immigrants", "refugees", "natives", "foreigners", "migrants"),
    ("disabled", "blind", "deaf", "elderly", "young", "old"),
)


def word_features(word: str) -> list[int]:
    """Hashes of the lower-case word and of its first 4, 5 and 6 letters."""
    parts = [f"={word}", *(f"^{word[:n]}" for n in (4, 5, 6) if len(word) >= n)]
    return [zlib.crc32(p.encode()) for p in parts]


def text_features(text: str | None) -> set[int]:
    return {f for w in set(WORDS.findall((text or "").lower())) for f in word_features(w)}


TERMS = {w: (g, i) for g in IDENTITY for i, w in enumerate(g)}
IDENTITY_FEATURES = frozenset(f for w in TERMS for f in word_features(w))


def swapped(sentence: str) -> str:
    """The sentence with each identity term swapped for the next of its group."""

    def turn(match: re.Match) -> str:
        if (own := TERMS.get(match[0])) is None:
            return match[0]
        return own[0][(own[1] + 1) % len(own[0])]

    return WORDS.sub(turn, sentence)


def mention(text: str | None) -> str:
    """The identity term that a text is learned with as well."""
    terms = list(TERMS)
    return terms[zlib.crc32((text or "").encode("utf-8", "surrogatepass")) % len(terms)]


def counterfactuals(text: str | None) -> list[tuple[list[int], list[int]]]:
    """Of every sentence that names a group, and of the one that the neutral mention is put ahead of: the features that it alone has, and those that it alone has with the terms swapped."""
    sentences = [x.lower() for x in SENTENCES.findall(text or "")]
    term = mention(text)
    out = []
    for sentence in [f"{term} {sentences[zlib.crc32(term.encode()) % len(sentences)] if sentences else ''}", *sentences]:
        if any(w in TERMS for w in WORDS.findall(sentence)):
            own, other = text_features(sentence), text_features(swapped(sentence))
            out.append((sorted(own - other), sorted(other - own)))
    return out


class Classifier:
    """Weights of the kept features and the bias."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.seen: dict[str, tuple[int, ...]] = {}

    def score(self, text: str | None) -> float:
        if len(self.seen) > CACHE_WORDS:
            self.seen.clear()
        found: set[int] = set()
        get = self.seen.get
        for token in set((text or "").split()):
            own = get(token)
            if own is None:
                own = self.seen[token] = tuple(f for w in WORDS.findall(token.lower()) for f in word_features(w) if f in self.weights)
            if own:
                found.update(own)
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _ratio(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    """Twice the log likelihood ratio of each feature's counts among na and nb texts."""
    term = lambda x, n, p: np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / (n * p)), 0) + np.where(x < n, (n - x) * np.log(np.maximum(n - x, 1e-300) / (n * (1 - p) + 1e-300)), 0)
    p = (a + b) / (na + nb)
    return 2 * (term(a, na, p) + term(b, nb, p))


def fit(rows: list[list[int] | np.ndarray], toxic: np.ndarray, pairs: list[tuple[list[int], list[int]]] = (), penalty: float = PENALTY, stands: np.ndarray | None = None, pair_stands: np.ndarray | None = None, copies: int = 1, steps: int = STEPS) -> Classifier:
    """Gradient descent with momentum on log loss, ridge and the counterfactual penalty; stands: how many rows each row, or each pair, stands for; copies: how many rows are of one text."""
    part = np.full(len(rows), 1 / max(1, len(rows))) if stands is None else stands / stands.sum()
    p_part = np.ones(len(pairs)) if pair_stands is None else np.asarray(pair_stands, float)
    toxic = toxic.astype(float)
    n1, n0 = int(toxic.sum()), int(len(toxic) - toxic.sum())
    if not n1 or not n0:
        return Classifier({}, 500.0 if n1 else -500.0)
    lengths = np.array([len(r) for r in rows])
    owner, flat = np.repeat(np.arange(len(rows)), lengths), np.concatenate([np.asarray(r, np.uint32) for r in rows])
    names, at = np.unique(flat, return_inverse=True)
    ones = np.bincount(at, toxic[owner], len(names))
    zeros = np.bincount(at, minlength=len(names)) - ones
    ratio = _ratio(ones, zeros, n1, n0) / copies
    group = np.isin(names, np.fromiter(IDENTITY_FEATURES, np.uint32))
    kept = np.argsort(-ratio, kind="stable")[:FEATURES]
    kept = np.union1d(kept[ratio[kept] >= LEAST_RATIO], np.flatnonzero(group))
    place = np.full(len(names), -1)
    place[kept] = np.arange(len(kept))
    inside = place[at] >= 0
    owner, at = owner[inside], place[at][inside]
    index = {int(names[k]): i for i, k in enumerate(kept)}
    coded = [([index[f] for f in a if f in index], [index[f] for f in b if f in index]) for a, b in pairs]
    p_part = p_part[[a != b for a, b in coded]] if coded else p_part
    coded = [p for p in coded if p[0] != p[1]]
    p_part = p_part / max(p_part.sum(), 1e-300)
    p_owner = np.repeat(np.arange(len(coded)), [len(a) + len(b) for a, b in coded]).astype(int)
    p_at = np.array([f for a, b in coded for f in (*a, *b)], int)
    p_sign = np.array([s for a, b in coded for s in (*[1.0] * len(a), *[-1.0] * len(b))])
    weight, bias = np.zeros(len(kept)), float(np.log(part @ toxic / (part @ (1 - toxic))))
    speed, bias_speed = np.zeros(len(kept)), 0.0
    step = 4.0 / max(1.0, np.bincount(owner, minlength=1).max(initial=1) ** 0.5)
    mass = np.maximum(np.bincount(at, part[owner], len(kept)), 1e-3)  # a rare feature's weight moves as fast as a common one's
    hold = mass + 2 * penalty * np.bincount(p_at, (p_part * np.bincount(p_owner, minlength=len(coded)))[p_owner], len(kept))
    for _ in range(steps):
        z = bias + np.bincount(owner, weight[at], len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - toxic) * part
        slope = np.bincount(at, error[owner], len(kept)) + RIDGE * mass * weight
        if len(coded):
            change = np.bincount(p_owner, p_sign * weight[p_at], len(coded))
            slope = slope + 2 * penalty * np.bincount(p_at, p_sign * (p_part * change)[p_owner], len(kept))
        speed = 0.9 * speed - step * 0.1 * slope / hold
        bias_speed = 0.9 * bias_speed - step * 0.1 * error.sum()
        weight, bias = weight + speed, bias + bias_speed
    return Classifier({f: float(weight[i]) for f, i in index.items()}, bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """text_col, label and stands (the label's ids for each sampled one) of at most rows documents of each label; the sample of labels is small by its limit, so it goes to the documents."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("sample_id")).agg(F.max(label_col).cast("int").alias("label"))
    known = F.broadcast(docs.sparkSession.createDataFrame([(r["label"], max(r["n"] / rows, 1.0)) for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()], "label int, stands double"))  # two rows
    few = [own.where(F.col("label") == k).orderBy(F.xxhash64("sample_id"), "sample_id").limit(rows) for k in (0, 1)]  # each task keeps rows of them before any moves
    texts = docs.select(F.col(id_col).alias("sample_id"), F.col(text_col).alias("text")).where("text is not null")
    return texts.join(F.broadcast(few[0].union(few[1]).join(known, "label")), "sample_id").groupBy("sample_id", "label", "stands").agg(F.min("text").alias("text"))


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS, penalty: float = PENALTY) -> Classifier:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        pairs = [counterfactuals(t) for t in texts]
        packed = lambda f: pa.array([np.array(sorted(f(t)), np.uint32).tobytes() for t in texts], pa.binary())
        columns = [
            batch.column("label"),
            batch.column("stands"),
            packed(text_features),
            packed(lambda t: set(word_features(mention(t)))),
            pa.array([[a for a, _ in p] for p in pairs], pa.list_(pa.list_(pa.int64()))),
            pa.array([[b for _, b in p] for p in pairs], pa.list_(pa.list_(pa.int64()))),
        ]
        return pa.RecordBatch.from_arrays(columns, ["label", "stands", "features", "mention", "sentences", "swapped"])

    sample = labelled_sample(docs, labels, id_col, text_col, label_col, rows)
    got = sample.mapInArrow(by_batch(run), "label int, stands double, features binary, mention binary, sentences array<array<long>>, swapped array<array<long>>").toArrow()
    plain = [np.frombuffer(x, np.uint32) for x in got.column("features").to_pylist()]
    named = [np.union1d(x, np.frombuffer(m, np.uint32)) for x, m in zip(plain, got.column("mention").to_pylist(), strict=True)]
    both = [list(zip(a, b, strict=True)) for a, b in zip(got.column("sentences").to_pylist(), got.column("swapped").to_pylist(), strict=True)]
    stands = np.asarray(got.column("stands"), float) if len(got) else np.zeros(0)
    labels_of = np.asarray(got.column("label"), np.int64) if len(got) else np.zeros(0)
    twice = lambda x: np.concatenate([x, x])  # each text as it is and with its neutral mention
    return fit(plain + named, twice(labels_of), [p for x in both for p in x], penalty, twice(stands) if len(got) else None, np.repeat(stands, [len(x) for x in both]) if len(got) else None, copies=2)


def scored(df: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns to keep, score and predicted."""
    shared = df.sparkSession.sparkContext.broadcast((classifier.weights, classifier.bias))
    made: list[Classifier] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Classifier(*shared.value))
        scores = [made[0].score(t) for t in batch.column(text_col).to_pylist()]
        out = [pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32())]
        return pa.RecordBatch.from_arrays([*map(batch.column, names), *out], [*names, "score", "predicted"])

    names = [c for c in dict.fromkeys((id_col, *keep)) if c not in ("score", "predicted")]
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names]
    return df.select(*dict.fromkeys((*names, text_col))).mapInArrow(by_batch(run), ", ".join([*kinds, "score double", "predicted int"]))


def learnable(labels: DataFrame, id_col: str = "doc_id", folds: int = 5, held: int = 0) -> DataFrame:
    return labels.where(fold_of(id_col, folds) != held)

"""The Jaccard join against all pairs."""

import re
from collections import defaultdict

import numpy as np

from karstmap.llm import jaccard, queries

SF = "/root/testdata/sf0.01"


def plain(docs, size=5):
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    sets, held = {}, defaultdict(list)
    for k, (_, t) in enumerate(docs):
        w = cut(t)
        sets[k] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
        if docs[k][0] is not None:
            for x in sets[k]:
                held[x].append(k)
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, own in sets.items():
        if docs[k][0] is None:
            continue
        both = defaultdict(int)
        for x in own:
            for j in held[x]:
                if j < k:
                    both[j] += 1
        for j, n in both.items():
            if 100 * n >= 75 * (len(own) + len(sets[j]) - n):
                parent[root(k)] = root(j)
    least = {}
    for k, (name, _) in enumerate(docs):
        if name is not None:
            least[root(k)] = min(least.get(root(k), name), name)
    return sorted(((name, len(sets[k]), least[root(k)] if name is not None else None) for k, (name, _) in enumerate(docs)), key=str)


def test_join_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(map(tuple, queries.op9_jaccard_join(spark, SF).collect()), key=str)
    assert got == plain(docs) and any(r[0] != r[2] for r in got)


def test_join_edges(spark, monkeypatch):
    draw = np.random.default_rng(10)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(draw.choice(words, 60)) for _ in range(6)]
    docs = [(100, None), (101, ""), (102, " \t\n"), (103, "one two"), (104, "One  TWO"), (105, "one two three"), (106, "a b c d e"), (107, "a b c d e"), (107, "a b c d e"), (None, "a b c d e")]
    for k in range(300):  # chains of near copies, most of which link to few others
        text = base[k % 6].split()
        for i in draw.choice(60, draw.integers(0, 4), replace=False):
            text[i] = f"x{draw.integers(0, 1000)}"
        docs.append((k, " ".join(text)))
    docs += [(1000 + k, "shared passage of many words in a row that all have " * 2 + " ".join(draw.choice(words, 20))) for k in range(50)]
    draw.shuffle(docs)
    docs = [(None if a is None else int(a), b) for a, b in docs]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in docs], "doc_id long, text string, cls int, n int")
    expected = plain(docs)
    for group, small, orders, rows in ((256, 64, 3, 2000), (7, 3, 1, 20), (7, 1000, 1, 20)):
        monkeypatch.setattr(jaccard, "SMALL", small)
        monkeypatch.setattr(jaccard, "GROUP", group)
        monkeypatch.setattr(jaccard, "ORDERS", orders)
        monkeypatch.setattr(jaccard, "BROADCAST_ROWS", rows)
        monkeypatch.setattr(jaccard, "CELLS", 5000)
        got = jaccard.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got), key=str) == expected
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rows = [(1, 2), (2, 3), (10, 11), (3, 4), (9, 4), (20, 20), (12, 11), (30, 31), (31, 32), (32, 33), (33, 34), (34, 35), (35, 36)]
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 9: 1, 11: 10, 12: 10, **{k: 30 for k in range(31, 37)}}

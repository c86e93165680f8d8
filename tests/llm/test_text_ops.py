"""Media, decontamination, line dedup and language ID against plain versions."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from karstmap.llm import decontaminate, langid, linededup, media, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "a line that is certainly longer than forty characters"


def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_media_query(spark):
    docs = documents(spark)
    for r in queries.op1_media_columns(spark, SF).collect():
        raw = docs[r.doc_id].text.encode()
        payload = raw + b"\0" * (-len(raw) % 64) or b"\0" * 64
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        media_ = f"P5\n64 {len(payload) // 64}\n255\n".encode() + payload
        assert (r.media_bytes, r.media_sha256) == (len(media_), hashlib.sha256(media_).hexdigest())
        assert r.feature == plain_feature(np.frombuffer(payload, np.uint8).reshape(-1, 64))


def plain_feature(image):
    """Difference hash by areas: each cell's mean over the parts of the samples that it covers."""
    share = lambda size, cells: np.array([[max(0.0, min((i + 1) * size / cells, j + 1) - max(i * size / cells, j)) for j in range(size)] for i in range(cells)])
    mean = share(image.shape[0], 8) @ image.astype(float) @ share(64, 9).T / (image.shape[0] / 8 * (64 / 9))
    return np.packbits(np.round(mean[:, :-1], 6) < np.round(mean[:, 1:], 6)).tobytes().hex()


def test_media_edges(spark):
    rows = [(1, None), (2, ""), (3, "x" * 64), (4, "é" * 70_000), (4, "é" * 70_000)]
    got = media.stored_texts(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.payload_bytes for r in got] == [64, 64, 64, 140_032, 140_032]
    assert got[0].payload_sha256 == got[1].payload_sha256 and got[3] == got[4]
    assert media.stored_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    bmp = media.stored_texts(spark.createDataFrame(rows, "doc_id long, text string"), form="bmp").orderBy("doc_id").collect()
    assert [r.payload_sha256 for r in bmp] == [r.payload_sha256 for r in got] and [r.feature for r in bmp] == [r.feature for r in got]


def test_names_that_clash(spark):
    """Columns named like results or like an operator's own are ignored, or replaced where they are to be kept."""
    names = ["id", "items", "spans", "n_words", "score", "lang_pred", "segment", "key", "n_lines", "feature", "error", "word"]
    df = spark.createDataFrame([(i, LINE + f"\nthe cat sat on {i}", "en", *[i] * len(names)) for i in range(7)], "doc_id long, text string, lang string, " + ", ".join(f"{n} int" for n in names))
    bench = spark.createDataFrame([(1, "the cat sat", 5, 6)], "item_id long, text string, spans int, items int")
    assert {r.n_hit for r in decontaminate.verdicts(decontaminate.find_items(df, bench, keep=tuple(names))).collect()} == {3}
    assert decontaminate.find_items(df, bench, keep=tuple(names), block_words=1).first().items == ["1"]
    assert decontaminate.decontaminated(df, bench).count() == 7
    for limits in ({}, {"broadcast_segments": 0, "broadcast_lines": 0}):
        rows = linededup.deduplicated(df, keep=tuple(names), **limits).collect()
        assert sorted((r.doc_id, r.id, r.n_lines, r.n_dropped) for r in rows) == [(i, i, 2, int(i < 6)) for i in range(7)]
        assert linededup.deduplicated(df.drop("doc_id"), id_col="id", **limits).count() == 7
    found = langid.identified(df, langid.samples(df), keep=tuple(names))
    assert found.columns.count("score") == 1 and {r.lang_pred for r in found.collect()} == {"en"}
    assert media.stored_texts(df).count() == 7


def test_media_formats(spark):
    rng = np.random.default_rng(1)
    grey, colour = rng.integers(0, 256, (11, 13), np.uint8), rng.integers(0, 256, (7, 5, 3), np.uint8)
    deep = rng.integers(0, 65536, (4, 6), np.uint16)
    for image in (grey, colour, deep):
        assert (media.decode(media.encode_netpbm(image)) == image).all()
    for image in (grey, colour):
        assert (media.decode(media.encode_bmp(image)) == image).all()
    assert media.decode(b"P2 # c\n2 2 9\n1 2\n3 4").tolist() == [[1, 2], [3, 4]]
    assert media.decode(b"P1\n2 2\n10\n01").tolist() == [[0, 255], [255, 0]]
    assert media.decode(b"P4\n9 1\n\x80\x80").tolist() == [[0] + [255] * 7 + [0]]
    assert media.decode(b"P3\n1 1 255\n1 2 3").tolist() == [[[1, 2, 3]]]
    rows = [(1, media.encode_bmp(grey)), (2, b"P5\n4 4\n255\nab"), (3, None), (4, b"GIF")]
    got = media.media_columns(spark.createDataFrame(rows, "doc_id long, media binary")).orderBy("doc_id").collect()
    assert (got[0].height, got[0].width, got[0].error) == (11, 13, None) and all(r.error and r.feature is None for r in got[1:])


@pytest.mark.parametrize("shape", [(16, 18), (11, 13), (3, 2), (1, 64), (5, 7, 3)])
def test_area_resize(shape, monkeypatch):
    image = np.random.default_rng(2).integers(0, 256, shape).astype(np.uint8)
    height, width = 8, 9
    fine = np.repeat(np.repeat(image.astype(float), height, 0), width, 1)
    plain = fine.reshape(height, shape[0], width, shape[1], *shape[2:]).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(image, height, width), plain)
    monkeypatch.setattr(media, "BLOCK_ROWS", 2)
    assert np.allclose(media.area_resize(image, height, width), plain)


def plain_hits(docs, items):
    """Every window of every item looked up in every text."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = defaultdict(set)
    for name, text in items:
        w = cut(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(str(name))
    out = {}
    for name, text in docs:
        w, hit, found = cut(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (names := windows.get(tuple(w[i : i + size]))) is not None:
                    found |= names
                    hit |= set(range(i, i + size))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[name] = (len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination_query(spark):
    docs = [(k, r.text) for k, r in documents(spark).items()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    plain = plain_hits(docs, items)
    got = {r[0]: tuple(r[1:]) for r in queries.op8_decontamination(spark, SF).collect()}
    assert got == plain and any(v[1] for v in plain.values())


def test_decontamination_edges(spark):
    abc = [f"w{i}" for i in range(30)]
    items = [(1, " ".join(abc)), (1, " ".join(abc)), (2, " ".join(abc[5:25])), (3, "w7 W8"), (4, ""), (5, None), (None, "w1 w2"), (6, "a a b a a"), (7, "!!")]
    docs = [(1, " ".join(abc)), (2, "x " + " ".join(abc[3:17]) + " y " + " ".join(abc[16:29])), (3, "w7"), (4, "W7-w8"), (5, None), (6, ""), (7, "a a b a a b a a"), (8, "z " * 300 + "w7 w8"), (9, " ".join(abc[:12])), (9, " ".join(abc[:12]))]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    plain = plain_hits(docs, [x for x in items if x[0] is not None])
    for block in (500_000, 10):
        rows = decontaminate.verdicts(decontaminate.find_items(df, bench, block_words=block)).collect()
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows}
        assert got == plain and len(rows) == len(docs)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.verdicts(decontaminate.find_items(df, empty)).collect()} == {0}
    assert decontaminate.find_items(df.limit(0), bench).count() == 0
    cut = {r.doc_id: r for r in decontaminate.decontaminated(df, bench, max_span=1).collect()}
    assert cut[8].text.strip() == "z " * 299 + "z" and cut[8].removed_words == 2 and cut[1].text is None and cut[6].text == ""


def test_automaton_random():
    rng = np.random.default_rng(3)
    for _ in range(150):
        items = [(str(i), [b"%d" % x for x in rng.integers(0, 3, rng.integers(1, 12))]) for i in range(4)]
        text = [b"%d" % x for x in rng.integers(0, 4, 40)]
        spans, found = (a := decontaminate.ItemAutomaton(items, 5)).find(text)
        hit, names = set(), set()
        for name, w in items:
            size = min(5, len(w))
            for i in range(len(w) - size + 1):
                for j in range(len(text) - size + 1):
                    if text[j : j + size] == w[i : i + size]:
                        hit |= set(range(j, j + size))
                        names.add(name)
        assert {x for s, e in spans for x in range(s, e)} == hit and {a.ids[k] for k in found} == names


def plain_kept(docs, least=40, many=5):
    """Lines before, and the lines that stay, of each document."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    held = defaultdict(set)
    for name, text in docs:
        for x in (text or "").split("\n"):
            if len(key(x)) >= least and name is not None:
                held[key(x)].add(name)
    out = []
    for name, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if name is None or len(held.get(key(x), ())) < many or max(held[key(x)]) == name]
        out.append((name, lines, kept))
    return out


def plain_lines(docs):
    return sorted(((k, len(a), len(a) - len(b), hashlib.sha256("\n".join(b).encode()).hexdigest()) for k, a, b in plain_kept(docs)), key=str)


def test_line_query(spark):
    plain = plain_lines([(k, r.text) for k, r in documents(spark).items()])
    assert sorted(map(tuple, queries.op7_line_dedup(spark, SF).collect()), key=str) == plain and any(x[2] for x in plain)


def test_line_edges(spark):
    docs = [(i, f"own {i}\n  {LINE.upper()}\t\nend") for i in range(6)] + [(10 + i, "é" * 39) for i in range(6)] + [(20 + i, "é" * 40 + "\n" + "É" * 40) for i in range(5)]
    docs += [(30, None), (31, ""), (32, "\n\n"), (None, LINE), (33, LINE), (33, LINE), (34, LINE * 2), (35, "x" * 200_000 + "\n" + LINE + "\n" + LINE)]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, key string, segment int")
    plain = plain_lines(docs)
    for limits in ({}, {"broadcast_segments": 0, "broadcast_lines": 0}):
        rows = linededup.deduplicated(df, keep=("key",), **limits).collect()
        got = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows]
        assert sorted(got, key=str) == plain
        assert [r.text for r in rows if r.doc_id == 30] == [None]
    assert linededup.deduplicated(df.limit(0)).count() == 0


def test_language_query(spark):
    docs = documents(spark)
    rows = queries.op10_language_id(spark, SF).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.95


def test_language_edges(spark):
    rows = [(1, "the cat sat on the mat", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", "de"), (5, "12 + 7 !", None), (6, "the dog", None), (7, "die hunde", None), (None, "the", "en"), (6, "the dog", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identified(df, langid.samples(df)).collect()
    by = {r.doc_id: r.lang_pred for r in got}
    assert len(got) == len(rows) and by[6] == "en" and by[7] == "de" and by[3] == by[4] == by[5] == "und"
    assert {r.lang_pred for r in langid.identified(df, langid.samples(df.limit(0))).collect()} == {"und"}
    long = df.union(spark.createDataFrame([(50, "the cat " * 200_000, "en"), (50, "zzz", "en"), (51, "die katze " * 200_000, None)], df.schema))
    learned = langid.samples(long)
    assert learned["en"][0] == "the" and "zzz" not in learned["en"] and learned == langid.samples(long.repartition(5))
    assert {r.doc_id: r.lang_pred for r in langid.identified(long, learned).collect()}[51] == "de"
    parser = langid.CrossParser({"a": ["abab", "ba"], "b": ["xyz"]})
    for text in ("abab", "baba", "qqab", "xyzx", "", "bbbb"):
        for moves, sample in zip(parser.moves, ([" abab ", " ba "], [" xyz "]), strict=True):
            count, at = 0, 0
            while at < len(text):
                end = at + 1
                while end < len(text) and any(text[at : end + 1] in s for s in sample):
                    end += 1
                at, count = end, count + 1
            assert parser.phrases(moves, text) == count, text

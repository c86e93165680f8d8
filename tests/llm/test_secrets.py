"""Secret scans against a plain scan and planted random strings."""

import hashlib
import re

from karstmap.llm import queries, secrets

SF = "/root/testdata/sf0.01"
PLAIN = (
    ("assign", re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[1]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def plain(text):
    spans = [(m.start(), k, kind, m.end()) for k, (kind, rx, keep) in enumerate(PLAIN) for m in rx.finditer(text or "") if keep(m)]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(spans)]


def check(rows, docs):
    assert len(rows) == len(docs)
    by = dict(docs)
    for r in rows:
        base = plain(by[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), r
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex"))
        spans = [x for x in r.spans.split(",") if x]
        assert [x for x in spans if not x.startswith("markov")] == base and len(spans) == len(base) + r.n_markov


def test_secret_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op3_secret_scan(spark, SF).collect()
    check(rows, docs)
    assert sum(r.n_assign for r in rows) and not any(r.n_markov for r in rows)


def test_secret_edges(spark):
    random = "xK9vQ2mZ7pL4wT8rB3nY6cH1"
    texts = [
        None, "", "token=token:abcdefgh", "PASSWORD : 'abc.def-1' api_key=x apikey=\"zzzzzz", "é💥 secret=ſecret123 ſecret=abcdefg toKen=ABCDEF",
        "AKIA" + "Z" * 15 + " AKIAAKIA" + "0" * 14 + "x", "0" * 23 + "g" + "f" * 24 + " " + "a1" * 200, "token==abcdef", "token=abc token=abcdef" * 3, "see " + random + " and thehandlerofincomingrequests",
        "secret=" + random, "x" * 300_000 + " token=abcdef " + "0" * 30, "tokentoken=\x20\x20abcdef", "api__key=abcdefg api_key\x20=\x20-_-_-_",
    ]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, t string, found int")
    words = spark.createDataFrame([(w, 0) for w in "the handler of incoming requests reads a stream and writes another one to the end".split()] * 40, "text string, label int")
    table = secrets.trained(secrets.random_strings(spark, 500).unionByName(words))
    spans = secrets.scanned(df, table)
    count = lambda k: f"size(filter(found, s -> s.kind = {k}))"
    rows = spans.selectExpr("doc_id", f"{count(0)} n_assign", f"{count(1)} n_access", f"{count(2)} n_hex", f"{count(3)} n_markov").withColumn("x", secrets.F.lit(1))
    text = spans.select("doc_id", secrets.joined("found").alias("spans"), secrets.F.sha2(secrets.joined("base").cast("binary"), 256).alias("base_sha256"))
    rows = rows.join(text, "doc_id").collect()
    check(rows, docs)
    by = {r.doc_id: r for r in rows}
    at = texts[9].index(random)
    assert by[9].spans == f"markov:{at}:{at + len(random)}" and by[10].n_markov == 0
    assert secrets.secrets(df.limit(0)).count() == 0 and len(secrets.secrets(df.union(df)).collect()) == 2 * len(docs)


LONG = 20_000  # 2 MB, 80,000 matches


def test_long_texts_take_seconds(spark):
    import time

    random = "xK9vQ2mZ7pL4wT8rB3nY6cH1"
    text = " ".join(f"{i:024x} token=abcdef{i} {random} plainwordsandmoreplainwords" for i in range(LONG))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    table = secrets.trained(secrets.random_strings(spark, 500).unionByName(spark.createDataFrame([("plain", 0), ("words", 0), ("and", 0), ("more", 0)] * 20, "text string, label int")))
    began = time.time()
    r = secrets.scanned(df, table).selectExpr("transform(array(0, 1, 2, 3), k -> size(filter(found, s -> s.kind = k))) AS n", "element_at(found, -1) AS last", "size(base) AS base").first()
    assert r.n == [LONG, 0, LONG, LONG] and r.base == 2 * LONG
    at = text.rindex(random)
    assert (r["last"].start, r["last"].end) == (at, at + len(random)) and time.time() - began < 60


def test_model_is_that_of_the_samples(spark):
    import math
    from collections import Counter

    docs = [(1, "password = 'Zx81kQ77pLmN20aaBcD3' and ordinary_words stay"), (2, "AKIA" + "Q7" * 9 + " more words"), (2, "z other text of one id"), (3, None), (None, "words of none"), (4, "token=short1 " + "ab12" * 8)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    samples = sorted((r.label, r.text) for r in secrets.labelled_samples(df).collect())
    assert samples == sorted([(1, "Zx81kQ77pLmN20aaBcD3"), (1, "AKIA" + "Q7" * 9), (1, "ab12" * 8)] + [(0, w) for w in "and ordinary_words stay more words words of none".split()])
    table = secrets.trained(spark.createDataFrame([(t, k) for k, t in samples], "text string, label int"))
    logs = []
    for label in (1, 0):
        pairs = Counter((x, y) for k, t in samples if k == label for x, y in zip(t, t[1:]))
        after, before = Counter(), Counter()
        for (x, y), n in pairs.items():
            after[y] += n
            before[x] += n
        total = sum(after.values()) + secrets.SYMBOLS * secrets.RARE
        logs.append(lambda x, y, p=pairs, a=after, b=before, n=total: math.log((p[x, y] + secrets.BACK_OFF * (a[y] + secrets.RARE) / n) / (b[x] + secrets.BACK_OFF)))
    for x, y in (("Q", "7"), ("a", "b"), ("o", "r"), ("z", "+")):
        at = (ord(x) - secrets.FIRST) * secrets.SYMBOLS + ord(y) - secrets.FIRST
        assert math.isclose(table[at], logs[0](x, y) - logs[1](x, y), abs_tol=1e-5)
    got = spark.createDataFrame([("Q7ab",)], "t string").select(secrets.ratio(table, secrets.F.col("t")).alias("r")).first().r
    assert math.isclose(got, sum(logs[0](x, y) - logs[1](x, y) for x, y in zip("Q7a", "7ab")), abs_tol=1e-4)


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = secrets.secrets(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)

"""The corpus pipeline against its stages' plain versions in a row."""

import re

from test_jaccard import plain as plain_join
from test_packing import check_packing, plain_pieces
from test_text_ops import plain_hits, plain_kept

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def expected(docs, items):
    docs = [(k, t) for k, t in docs if t and re.search(r"[^\W\d_]", t)]
    docs = [(k, "\n".join(kept)) for k, _, kept in plain_kept(docs)]
    first = {k: c for k, _, c in plain_join(docs)}
    docs = [(k, t) for k, t in docs if first[k] == k]
    bad = plain_hits(docs, items)
    return plain_pieces([(k, t) for k, t in docs if not bad[k][4]])


def test_run(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = corpus_pipeline.run(spark, SF).collect()
    check_packing(rows)
    got = sorted(tuple(r)[:5] for r in rows)
    assert got == expected(docs, items) and len({x[0] for x in got}) < len(docs)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    edge = spark.createDataFrame([(900, None, None, None, None), (901, "", "en", "s", 0), (None, "ein wort", "de", "s", 8), (902, "12", None, "s", 2)], docs.schema)
    for at in (docs.union(edge), docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, SF)
            assert at.columns == docs.columns
            at.count()
        corpus_pipeline.STAGES[-1][1](spark, at, SF).count()

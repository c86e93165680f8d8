"""A corpus pipeline: five filtering stages over documents, the last of which packs what is left into sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karstmap.llm import decontaminate, jaccard, langid, linededup, packing
from karstmap.llm.common import stored, table
from karstmap.llm.queries import public_tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BROADCAST_IDS = 1_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the learned languages; null texts and texts without a letter go."""
    found = langid.identified(docs, langid.samples(langid.learnable(docs)), keep=COLUMNS[1:])
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many repeat; n_chars is that of what is left."""
    kept = linededup.deduplicated(docs, keep=COLUMNS[2:])
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies."""
    found = stored(jaccard.near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    gone = F.broadcast(found) if found.count() <= BROADCAST_IDS else found
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS[1:])
    return decontaminate.verdicts(found).where(~F.col("contaminated")).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return packing.packed(docs, public_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("packing", best_fit_packing),
]

#: SQL can't tokenize; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

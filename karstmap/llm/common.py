"""Helpers shared by the corpus operators: reading, shared scratch tables, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where none is set and all run on one machine, one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="karstmap-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again, which cuts its lineage."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of size rows, so that the Python copies of long texts stay few."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def by_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """fn over slices of the Arrow batches, for mapInArrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if (out := fn(batch)) is not None:
                yield out

    return run


_KEPT: dict[str, tuple[object, object]] = {}


def kept(name: str, key: object, make: Callable[[], object]) -> object:
    """What make gives, held by the worker process from task to task while name and key stay the same; only the last one is, so that stages don't add up."""
    if name not in _KEPT or _KEPT[name][0] != key:
        _KEPT.clear()
        _KEPT[name] = (key, make())
    return _KEPT[name][1]


def utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column's values as UTF-8 bytes."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts, counted in one column-pruned pass; sizes the shuffles that follow."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()["n"]

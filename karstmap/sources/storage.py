"""Saving and loading: Parquet tables and a JSON manifest that says what they are."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 1
NPY_ROWS = 10_000


class DeserializationError(RuntimeError):
    """What lies at a path is not what was to be loaded."""


def save(spark: SparkSession, path: str, manifest: dict, tables: dict[str, DataFrame], partition: dict[str, str] | None = None) -> None:
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if partition and name in partition:
            writer = writer.partitionBy(partition[name])
        writer.parquet(f"{path}/{name}")
    text = json.dumps(manifest | {"format": FORMAT, "tables": sorted(tables)}, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load(spark: SparkSession, path: str, kind: str | None = None) -> tuple[dict, dict[str, DataFrame]]:
    """The manifest and the tables; kind: what it must be. A path that doesn't exist is Spark's own error."""
    rows = spark.read.text(f"{path}/manifest").collect()
    try:
        manifest = json.loads(rows[0]["value"])
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}
    except (IndexError, ValueError, KeyError) as e:
        raise DeserializationError(f"no index at {path}") from e
    if manifest.get("format") != FORMAT or kind is not None and manifest["kind"] != kind:
        raise DeserializationError(f"{path} holds {manifest.get('kind')}, not {kind}")
    return manifest, tables


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """row and values of matrices in NPY files, one array a row; row is the number within its file. Each file is one task's, from any store that Spark reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                matrix = np.load(io.BytesIO(content), allow_pickle=False)
                if matrix.ndim != 2 or matrix.dtype.kind not in "iu":
                    raise ValueError(f"{name} holds no matrix of integers")
                for at in range(0, len(matrix), NPY_ROWS):
                    part = matrix[at : at + NPY_ROWS].astype(np.int64)
                    rows = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32()), pa.array(part.ravel(), pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part)), pa.int64()), rows], ["path", "row", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, row bigint, values array<bigint>")


def difference(a: DataFrame, b: DataFrame) -> int:
    """Rows that only one of two tables has."""
    return a.exceptAll(b).unionAll(b.exceptAll(a)).agg(F.count("*")).first()[0]

"""Older embedding files: raw float32 rows, and Parquet with half-precision lists."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

ROWS = "path string, row long, embedding array<float>"


def read_raw_rows(spark: SparkSession, path: str, size: int = 512) -> DataFrame:
    """(path, row, embedding): rows of `size` floats by number; a torn last row is left out."""

    def run(batches):
        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = len(content) // (4 * size)
                x = np.frombuffer(content, "<f4", n * size).reshape(n, size)
                for k in range(0, n, 4096):
                    part = x[k : k + 4096]
                    values = pa.FixedSizeListArray.from_arrays(pa.array(part.ravel()), size).cast(pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(part)), pa.array(range(k, k + len(part)), pa.int64()), values], names=["path", "row", "embedding"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ROWS)


def read_half_precision(spark: SparkSession, path: str, id_col: str = "face_id", vector_col: str = "embedding") -> DataFrame:
    """(id, embedding) from Parquet files whose lists are half precision, which Spark's own reader refuses."""

    def run(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                for part in pq.ParquetFile(io.BytesIO(content)).iter_batches(4096, columns=[id_col, vector_col]):
                    vectors = part.column(vector_col).cast(pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([part.column(id_col).cast(pa.string()), vectors], names=["id", "embedding"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("content").mapInArrow(run, "id string, embedding array<float>")


def align(size: int, row_bytes: int = 2048) -> int:
    """Bytes to add so that the next row starts at a whole one."""
    return -size % row_bytes

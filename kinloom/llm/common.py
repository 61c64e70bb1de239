"""Helpers that the training-data operators share.

Operators read columns by position, so further columns whose names differ only in
case, or equal an operator's own working names, do no harm.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, shared_folder  # noqa: F401

#: Rows and bytes of one Arrow batch: bounds what a Python worker holds when values are long.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: A table of fixed-width rows is broadcast only when it has been counted to be this small.
BROADCAST_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lowered(spark: SparkSession) -> None:
    """Hand Python workers little at a time: lowers the session's bounds on Arrow batches, never raises them.

    At the usual bounds (10,000 rows, 64 MB) the buffers on both sides take some hundred MB of an
    executor; the bounds are read when a plan runs, so they can't be put back before."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def bounded(batches):
    """The Arrow batches in slices of bounded rows and bytes (one row at least), without empty ones: what becomes of them in Python is bounded whatever the session's settings."""
    for b in batches:
        rows = max(1, min(BATCH_ROWS, b.num_rows * BATCH_BYTES // max(1, b.nbytes)))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def position(df: DataFrame, name: str) -> int:
    """Index of a column: by exact name, else the only one that equals it but for case."""
    if name in df.columns:
        return df.columns.index(name)
    found = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise KeyError(f"column {name!r} is not among {df.columns}")
    return found[0]


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, under the operator's own names."""
    at = {out: position(df, name) for out, name in wanted.items()}
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(out) for out, i in at.items()])


def join_counted(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a cut table of fixed-width rows: broadcast up to `limit` rows, else shuffled,
    where both sides are plain exchanges and adaptive execution can split hot keys."""
    few = right.limit(limit + 1).count() <= limit
    return left.join(F.broadcast(right) if few else right.hint("merge"), on, how)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: what reads it next reads only the columns it needs."""
    folder = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")

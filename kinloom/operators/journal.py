"""Append-only logs: last write wins, commits, retractions, resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_per_key(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key in log order.

    As an aggregate: partial maxima are taken before the shuffle, so a key with many rows is no hot one."""
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return best.select(*keys, "r.*").select(*log.columns)


def progress(log: DataFrame, key: str, status: str, order: str, done: str = "done", failed: str = "failed") -> DataFrame:
    """Keys by last status: processed, failed, and keys in all."""
    last = log.groupBy(key).agg(F.max_by(status, order).alias("s"))
    return last.agg(F.count_if(F.col("s") == done).alias("processed"), F.count_if(F.col("s") == failed).alias("failed"), F.count("*").alias("keys"))


def pending(manifest: DataFrame, log: DataFrame, key: str, retry: DataFrame | None = None) -> DataFrame:
    """Manifest rows without a log row; `retry` names keys to do again all the same."""
    seen = log.select(key).distinct()
    if retry is not None:
        seen = seen.join(retry.select(key), key, "left_anti")
    return manifest.join(seen, key, "left_anti")


def committed(faces: DataFrame, state: DataFrame, photo: str = "photo_id", batch: str = "batch", order: str = "line_no") -> DataFrame:
    """Face rows of the attempt that their photo's last state row committed; of rows that repeat a face, the last."""
    last = last_per_key(state, [photo], order).where("status = 'done'").select(photo, batch)
    return last_per_key(faces.join(last, [photo, batch], "left_semi"), ["face_id"], order)


def live(journal: DataFrame, record: str = "record_id", subject: str = "subject", retracted: str = "retracted") -> DataFrame:
    """Records that are no retraction and that none retracts."""
    gone = journal.where(F.col(retracted)).select(F.col(subject).alias(record)).where(F.col(record).isNotNull()).distinct()
    return journal.where(~F.coalesce(retracted, F.lit(False))).join(gone, record, "left_anti")


def changes(log: DataFrame, value: str, order: str, within: str) -> DataFrame:
    """Per group of `within`, how often the value differs from the row before (the first row counts)."""
    before = F.lag(value).over(Window.partitionBy(within).orderBy(order))
    return log.withColumn("new", ~F.col(value).eqNullSafe(before)).groupBy(within).agg(F.count_if("new").alias("changes"), F.count("*").alias("rows"))


def neighbours(rows: DataFrame, value: str, order: str, within: str) -> DataFrame:
    """Consecutive pairs (a, b) within a group."""
    after = F.lead(value).over(Window.partitionBy(within).orderBy(order))
    return rows.select(within, F.col(value).alias("a"), after.alias("b")).where("b is not null")


def distinct_pairs(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Unordered pairs, each once, no pair of equals."""
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


#: Rows from the end whose weight is more than nothing: 0.7 to the power of 2,100 is 0 in double precision.
SMOOTHED_ROWS = 2_100


def smoothed(log: DataFrame, value: str, order: str, within: str, keep: float = 0.7) -> DataFrame:
    """Exponentially weighted mean in log order, per group.

    As a sum of weighted rows: only the last SMOOTHED_ROWS of a group weigh anything (for `keep` up
    to 0.7), and row limits by group hold before the shuffle, so a group may be of any size."""
    w = Window.partitionBy(within).orderBy(F.col(order).desc())
    tail = log.select(within, order, F.col(value).cast("double").alias("v")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= SMOOTHED_ROWS)
    share = F.when(F.lead("k").over(w).isNull(), 1.0).otherwise(1 - keep)
    weighed = tail.withColumn("share", share)
    return weighed.groupBy(within).agg(F.sum(F.pow(F.lit(keep), F.col("k") - 1) * F.col("share") * F.col("v")).alias("smoothed"))


def latest(log: DataFrame, n: int, order: str, within: str) -> DataFrame:
    """The last n rows of each group."""
    w = Window.partitionBy(within).orderBy(F.col(order).desc())
    return log.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)

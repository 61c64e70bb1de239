"""The journal and event computations over growing input; each has a batch twin.

Input grows by files. A finite run (`drain`) reads all there is and ends, which is how tests
compare a stream with its twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def follow(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    """New Parquet files of a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def follow_journal(spark: SparkSession, path: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    """New JSON-line files of a folder, torn lines dropped, as a stream."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_batch).json(path)


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream until its input ends; the rows of the last batch (complete) or of all batches (append)."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:  # the same number writes the same folder again, so a retried batch counts once
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={0 if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


def last_status(log: DataFrame, key: str, status: str, order: str) -> DataFrame:
    """Last status of each key, kept as state: a later row takes an earlier one's place."""
    return log.groupBy(key).agg(F.max_by(status, order).alias(status))


def progress(spark: SparkSession, log: DataFrame, key: str, status: str, order: str) -> DataFrame:
    """Keys done and failed by last status, from a stream of log rows."""
    last = drain(last_status(log, key, status, order))
    return last.agg(F.count_if(F.col(status) == "done").alias("processed"), F.count_if(F.col(status) == "failed").alias("failed"), F.count("*").alias("keys"))


def totals(log: DataFrame, value: str, by: str) -> DataFrame:
    """Running totals of a tail."""
    return log.groupBy(by).agg(F.count("*").alias("rows"), F.round(F.sum(value), 4).alias("total"), F.max(value).alias("largest"))


def windowed(events: DataFrame, ts: str, by: str, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by event-time window, for append queries: a window comes out, and its state goes, when the watermark passes its end; later rows are dropped."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    counted = events.withWatermark(ts, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), by, "n")


def sessions(events: DataFrame, ts: str, by: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Bursts of activity, for append queries: a session ends after a gap, and comes out when the watermark passes its end."""
    s = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return s.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def once(events: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Rows whose keys have not come within the watermark (retries of a batch)."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)

"""Run journals added up for events and the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C



def with_rate(runs: DataFrame) -> DataFrame:
    rate = F.when((F.col("photos") > 0) & (F.col("seconds") > 0), F.col("seconds") / F.col("photos"))
    return runs.withColumn("rate", rate)


def run_rollup(runs: DataFrame) -> DataFrame:
    """All runs (photos, seconds, total): photo-weighted seconds per photo, extremes, sums."""
    r = with_rate(runs)
    valid = F.col("rate").isNotNull()
    return r.agg(
        F.count("*").alias("runs"), F.count_if(valid).alias("samples"),
        F.round(F.sum(F.when(valid, F.col("seconds"))) / F.sum(F.when(valid, F.col("photos"))), 6).alias("weighted_rate"),
        F.round(F.min("rate"), 6).alias("min_rate"), F.round(F.max("rate"), 6).alias("max_rate"),
        F.round(F.sum(F.when(F.col("total") > 0, F.col("total"))), 2).alias("total_seconds"), F.sum("photos").cast("long").alias("photos"),
    )


def event_timing(runs: DataFrame) -> DataFrame:
    """Per event: total, unweighted mean rate, last reviewer that is not empty, last phase, latest stamp (order: ord)."""
    r = with_rate(runs)
    named = F.when(F.col("reviewer") != "", F.col("reviewer"))
    return r.groupBy("event_id").agg(
        F.round(F.sum(F.when(F.col("total") > 0, F.col("total"))), 2).alias("total_seconds"), F.round(F.avg("rate"), 6).alias("mean_rate"),
        F.max_by(named, F.when(named.isNotNull(), F.col("ord"))).alias("reviewer"), F.max_by("phase", "ord").alias("phase"), F.max("stamp").alias("last_stamp"),
    )


def dashboard(events: DataFrame) -> DataFrame:
    """Totals over events (folder, event_id, processed, faces, people): photos once per folder, people where known."""
    key = F.coalesce(F.nullif("folder", F.lit("")), F.concat(F.lit("?"), F.col("event_id").cast("string")))
    folders = events.groupBy(key.alias("k")).agg(F.max("processed").alias("distinct_photos"), F.count("*").alias("events"), F.sum("processed").alias("processed"), F.sum("faces").alias("faces"), F.sum("people").alias("people"), F.count_if(F.col("people").isNull()).alias("unmeasured"))
    return folders.agg(
        F.sum("events").cast("long").alias("events"), F.sum("processed").cast("long").alias("processed"), F.sum("distinct_photos").cast("long").alias("distinct_photos"),
        F.sum(F.greatest(F.lit(0), F.col("processed") - F.col("distinct_photos"))).cast("long").alias("reprocessed"), F.count_if(F.col("events") > 1).alias("shared_folders"),
        F.sum("faces").cast("long").alias("faces"), F.sum("people").cast("long").alias("people"), F.sum("unmeasured").cast("long").alias("unmeasured"),
    )


def size_class(photo_count, processed):
    n = F.greatest(photo_count, processed)
    return F.when(n >= C.LARGE_EVENT, "large").when(n >= C.MEDIUM_EVENT, "medium").otherwise("small")


def progress_pct(processed, photo_count):
    return F.when(photo_count > 0, F.least(F.lit(100.0), processed / photo_count * 100)).otherwise(0.0)


def album_truth(photos: DataFrame, most: float = 0.9) -> DataFrame:
    """Per event: whether folders may serve as truth (two or more, none the root, none with nearly all)."""
    by = photos.groupBy("event_id", "album").agg(F.count("*").alias("n"))
    out = by.groupBy("event_id").agg(F.count("*").alias("albums"), F.count_if(F.col("album") == "").alias("root"), (F.max("n") / F.sum("n")).alias("share"))
    return out.select("event_id", "albums", F.round("share", 6).alias("top_share"), ((F.col("albums") >= 2) & (F.col("root") == 0) & (F.col("share") <= most)).alias("usable"))

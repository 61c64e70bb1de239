"""Thresholds read off the data: what surely differs shows how close different faces come."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..config import Settings
from ..functions.vector import clamp, unit_distance
from .blocks import quantile


def same_photo_pairs(faces: DataFrame, max_pairs: int | None = None) -> DataFrame:
    """(event_id, photo_id, a, b, d) for all pairs a < b of one photo: two faces in one photo are two people.

    All of them; a caller who wants a budget gets whole photos in order of their id until it is reached."""
    if max_pairs is not None:
        n = faces.groupBy("event_id", "photo_id").agg(F.count("*").alias("n"))
        before = F.sum(F.expr("n * (n - 1) / 2")).over(Window.partitionBy("event_id").orderBy("photo_id").rowsBetween(Window.unboundedPreceding, -1))
        within = n.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < max_pairs).select("event_id", "photo_id")
        faces = faces.join(within, ["event_id", "photo_id"], "left_semi")
    a = faces.select("event_id", "photo_id", F.col("face_id").alias("a"), F.col("x").alias("xa"))
    b = faces.select("event_id", "photo_id", F.col("face_id").alias("b"), F.col("x").alias("xb"))
    return a.join(b, ["event_id", "photo_id"]).where("a < b").select("event_id", "photo_id", "a", "b", unit_distance(F.col("xa"), F.col("xb")).alias("d"))


def merge_line(pairs: DataFrame, judged: DataFrame | None = None, default: float = Settings.pass2_threshold) -> DataFrame:
    """Per event: line, closest (1st percentile), pairs, duplicates, basis.

    `judged` has (event_id, d) of pairs that people called different."""
    d = pairs.select("event_id", "d", F.lit(0).alias("j"))
    if judged is not None:
        d = d.unionByName(judged.select("event_id", "d", F.lit(1).alias("j")))
    usable = F.col("d") >= C.DUPLICATE_FLOOR
    s = d.groupBy("event_id").agg(
        F.count_if(~usable).alias("duplicates"),
        F.count_if(usable).alias("pairs"),
        F.count_if(usable & (F.col("j") == 1)).alias("judged"),
    )
    s = s.join(quantile(d.where(usable), ["event_id"], "d", 0.01).withColumnRenamed("quantile", "p1"), "event_id", "left")
    enough = F.col("pairs") >= C.MIN_PAIRS
    line = F.when(enough, F.bround(clamp(F.col("p1") * C.PILE_DISCOUNT, C.MERGE_FLOOR, C.MERGE_CEILING), 2)).otherwise(default)
    basis = F.when(~enough, "default").when(F.col("judged") > 0, "judged").otherwise("measured")
    return s.select("event_id", line.alias("line"), F.round("p1", 6).alias("closest"), "pairs", "duplicates", basis.alias("basis"))


def small_face_line(distances: DataFrame, default: float = Settings.second_class_assign) -> DataFrame:
    """Per event, the line for attaching small faces, from (event_id, d) between small faces and other people."""
    s = distances.groupBy("event_id").agg(F.count("d").alias("pairs"))
    s = s.join(quantile(distances, ["event_id"], "d", 0.01).withColumnRenamed("quantile", "p1"), "event_id", "left")
    enough = F.col("pairs") >= C.SMALL_MIN_PAIRS
    line = F.when(enough, F.bround(clamp(F.col("p1") * C.SMALL_MARGIN, C.SMALL_FLOOR, C.SMALL_CEILING), 2)).otherwise(default)
    return s.select("event_id", line.alias("line"), F.round("p1", 6).alias("closest"), "pairs", F.when(enough, "measured").otherwise("default").alias("basis"))


def evidence_cut(judged: DataFrame) -> DataFrame:
    """(event_id, d, same) -> per event: floor, ceiling, cut, cost.

    Where judgements don't overlap the cut is midway. Else candidates lie between observed
    distances (and beyond both ends) and the first, so the tightest, of least cost wins; a wrong
    merge costs three splits. Costs come from running sums over the distances."""
    ends = judged.groupBy("event_id").agg(F.max(F.when(F.col("same"), F.col("d"))).alias("floor"), F.min(F.when(~F.col("same"), F.col("d"))).alias("ceiling"), F.count_if("same").alias("n_same"), F.count_if(~F.col("same")).alias("n_diff"))
    by = judged.groupBy("event_id", "d").agg(F.count_if("same").alias("s"), F.count_if(~F.col("same")).alias("t"))
    w = Window.partitionBy("event_id").orderBy("d")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    at = by.select("event_id", "d", F.lead("d").over(w).alias("next"), F.sum("s").over(upto).alias("s"), F.sum("t").over(upto).alias("t"), F.row_number().over(w).alias("k"))
    inner = at.select("event_id", F.when(F.col("next").isNotNull(), F.round((F.col("d") + F.col("next")) / 2, 4)).otherwise(F.least(F.lit(1.0), F.col("d") + 0.05)).alias("cut"), "s", "t")
    first = at.where("k = 1").select("event_id", F.greatest(F.lit(0.0), F.col("d") - 0.05).alias("cut"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    costed = inner.unionByName(first).join(ends, "event_id")
    cost = 3 * F.col("t") / F.greatest("n_diff", F.lit(1)) + (F.col("n_same") - F.col("s")) / F.greatest("n_same", F.lit(1))
    best = costed.groupBy("event_id").agg(F.min(F.struct(F.round(cost, 9).alias("cost"), "cut")).alias("b"))
    clear = F.col("floor").isNull() | F.col("ceiling").isNull() | (F.col("floor") < F.col("ceiling"))
    out = ends.join(best, "event_id")
    return out.select("event_id", F.round("floor", 6).alias("floor"), F.round("ceiling", 6).alias("ceiling"), F.when(clear, F.round((F.coalesce("floor", "ceiling") + F.coalesce("ceiling", "floor")) / 2, 3)).otherwise(F.round("b.cut", 4)).alias("cut"), F.when(clear, 0.0).otherwise(F.col("b.cost")).alias("cost"))

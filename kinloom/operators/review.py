"""Read models for reviewing identities: order, pages, boxes, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_faces(faces: DataFrame, by: list[str], n: int) -> DataFrame:
    """The n best faces of each person."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("quality").desc(), "face_id"))
    return faces.withColumn("k", k).where(F.col("k") <= n).select(*by, "k", "face_id", "quality")


def review_order(groups: DataFrame) -> DataFrame:
    """Mixed piles first, then those not approved, then the largest (persons of one event)."""
    w = Window.partitionBy("event_id").orderBy(F.col("mixed").desc(), "approved", F.col("size").desc(), "pred")
    return groups.select("event_id", "pred", "size", "mixed", "approved", F.row_number().over(w).alias("place"))


def page(rows: DataFrame, order: list, number: int, per: int) -> DataFrame:
    """One page in a total order; per 0 gives all rows."""
    out = rows.orderBy(*order)
    return out if per == 0 else out.offset((max(1, number) - 1) * per).limit(per)


def pages(total: int, per: int) -> int:
    return 1 if per == 0 else max(1, -(-total // per))


def box_percent(boxes: DataFrame, photos: DataFrame) -> DataFrame:
    """Boxes (x, y, w, h) as shares of their photo (width, height); photos without dimensions are left out."""
    sized = photos.where("width > 0 and height > 0").select("event_id", "photo_id", F.col("width").alias("pw"), F.col("height").alias("ph"))
    j = boxes.join(sized, ["event_id", "photo_id"])
    return j.select("face_id", *[F.round(100.0 * F.col(c) / F.col(of), 3).alias(f"{c}_pct") for c, of in (("x", "pw"), ("y", "ph"), ("w", "pw"), ("h", "ph"))])


def review_progress(piles: DataFrame) -> DataFrame:
    """piles (event_id, approved, fixed) -> piles, answered, faces fixed, percent answered."""
    s = piles.groupBy("event_id").agg(F.count("*").alias("piles"), F.count_if("approved").alias("answered"), F.sum("fixed").cast("long").alias("fixed"))
    return s.withColumn("pct", F.round(100.0 * F.col("answered") / F.col("piles"), 1))


def flagged(journal: DataFrame) -> DataFrame:
    """Faces that a live judgement calls wrong or no face."""
    return journal.where(F.col("kind").isin("FACE_WRONG", "NOT_A_FACE")).select(F.col("subject").alias("face_id")).distinct()

"""Faces with known identities, derived from the embeddings table on either engine.

Each vector is pulled towards its label's first vector, so that labels become identities. A
photo never holds two faces of one label; the collision variant puts four neighbours in one. With
loners every 17th vector is a direction of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vector import unit


def faces(spark: SparkSession, sf_dir: str, pull: float = 2.0, collide: bool = False, loners: bool = False) -> DataFrame:
    """face_id, vec_id, label, event_id, photo_id, x (unit), quality, height, blur, yaw, det_score, width."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    base = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("b"))
    mixed = e.join(base, "label").withColumn("m", F.zip_with("embedding", "b", lambda x, y: x.cast("double") + F.lit(pull) * y.cast("double")))
    if loners:
        alone = F.transform("embedding", lambda _, i: F.when(i == F.col("vec_id") % 64, 1.0).otherwise(0.0))
        mixed = mixed.withColumn("m", F.when(F.col("vec_id") % 17 == 0, alone).otherwise(F.col("m")))
    place = F.floor(F.col("vec_id") / 4) if collide else F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long")
    out = mixed.select("vec_id", F.col("label").cast("long").alias("label"), unit(F.col("m")).alias("x"), place.alias("photo_id"))
    v = F.col("vec_id")
    return out.select(
        F.format_string("%06d_%02d", "photo_id", (v % 100 if collide else F.col("label"))).alias("face_id"),
        "vec_id", "label", (F.lit(0) if collide else F.col("photo_id") % 2).cast("long").alias("event_id"), "photo_id", "x",
        ((v * 37) % 100 / 100).alias("quality"), (30 + (v * 53) % 400).alias("height"), (20 + (v * 41) % 300).cast("double").alias("width"),
        ((v * 29) % 60).cast("double").alias("blur"), ((v * 31) % 121 - 60).cast("double").alias("yaw"), (0.5 + (v * 17) % 50 / 100).alias("det_score"),
    )


def sql(pull: float = 2.0, collide: bool = False, loners: bool = False) -> str:
    """The same as `faces`, as the body of WITH."""
    m = f"list_transform(range(1, len(e.embedding) + 1), lambda i: e.embedding[i]::DOUBLE + {pull} * base.b[i]::DOUBLE)"
    if loners:
        m = f"CASE WHEN e.vec_id % 17 = 0 THEN list_transform(range(0, len(e.embedding)), lambda i: (i = e.vec_id % 64)::INT::DOUBLE) ELSE {m} END"
    photo = "vec_id // 4" if collide else "row_number() OVER (PARTITION BY label ORDER BY vec_id)"
    return f"""base AS (SELECT label, arg_min(embedding, vec_id) AS b FROM embeddings GROUP BY label),
mixed AS (SELECT e.vec_id, e.label, {m} AS m FROM embeddings e JOIN base USING (label)),
placed AS (SELECT vec_id, label::BIGINT AS label, list_transform(m, lambda v: v / sqrt(list_dot_product(m, m))) AS x, ({photo})::BIGINT AS photo_id FROM mixed),
faces AS (SELECT printf('%06d_%02d', photo_id, {'vec_id % 100' if collide else 'label'}) AS face_id, vec_id, label, ({'0' if collide else 'photo_id % 2'})::BIGINT AS event_id, photo_id, x,
  ((vec_id * 37) % 100) / 100 AS quality, 30 + (vec_id * 53) % 400 AS height, (20 + (vec_id * 41) % 300)::DOUBLE AS width, ((vec_id * 29) % 60)::DOUBLE AS blur,
  ((vec_id * 31) % 121 - 60)::DOUBLE AS yaw, 0.5 + ((vec_id * 17) % 50) / 100 AS det_score FROM placed)"""

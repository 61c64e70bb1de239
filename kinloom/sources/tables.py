"""Columnar and journal schemas, readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the face and photo tables and of the journals.
FACES = (
    "event_id string, face_id string, photo_id string, photo_path string, sub_album string, face_index int, batch long, bbox_x float, bbox_y float, bbox_w float, bbox_h float, "
    "det_score float, quality_score float, blur float, yaw float, yaw_method string, face_h_px float, align_scale float, detector_source string, accepted boolean, second_class boolean, "
    "reject_reason string, embedding_ref long, embedding_model_version string, embedding array<float>"
)
PHOTOS = "event_id string, photo_id string, path string, sub_album string, width int, height int, taken_at string, exif_rotated boolean, face_count int, accepted_count int, detected_count int"
MANIFEST = "photo_id string, source_id string, name string, path string, sub_album string, size long"
STATE = "photo_id string, status string, batch long, path string, sub_album string, width int, height int, taken_at string, exif_rotated boolean, face_count int, accepted_count int, detected_count int, error string"
RUNS = (
    "event_id string, run_id string, reviewer string, trigger string, phase string, started_at string, finished_at string, total_seconds double, processing_seconds double, photos_total int, "
    "photos_processed int, photos_skipped_done int, photos_failed int, faces_detected int, faces_accepted int, people_found int, source_type string, error string, model_version string"
)
FEEDBACK = "kind string, reviewer string, record_id string, ts string, same_group array<string>, different_pairs array<array<string>>, excluded array<string>, subject string, person_label string, text string, retracted boolean, model_version string"


def read_journal(spark: SparkSession, path: str, schema: str, keep_broken: bool = False) -> DataFrame:
    """JSON lines; blank and torn lines are skipped, unknown keys dropped, missing ones null.

    With keep_broken a column `broken` has the text of lines that could not be read."""
    reader = spark.read
    if keep_broken:
        return reader.schema(f"{schema}, broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    return reader.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_journal(rows: DataFrame, path: str) -> None:
    """Add rows as new files; what is there stays."""
    rows.write.mode("append").json(path)


def read_document(spark: SparkSession, path: str, schema: str, defaults: dict) -> DataFrame:
    """A whole-file JSON document; fields that can't be read take their defaults."""
    names = set(defaults)
    d = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return d.select(*[F.coalesce(c, F.lit(defaults[c])).alias(c) if c in names else F.col(c) for c in d.columns])


def write_faces(faces: DataFrame, path: str) -> None:
    """One folder for each event; only the events in `faces` are replaced."""
    faces.repartition("event_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("event_id").parquet(path)


def read_faces(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """Faces; with a version only accepted ones of it (both filters reach the scan)."""
    f = spark.read.parquet(path)
    return f if version is None else f.where(F.col("accepted") & (F.col("embedding_model_version") == version))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_ndjson(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Dimension rows with changes laid over: null keeps what was there, '' clears."""
    rest = [c for c in table.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in rest])
    joined = table.join(new, key, "full_outer")
    return joined.select(key, *[F.when(F.col(f"new_{c}").isNull(), F.col(c)).when(F.col(f"new_{c}").cast("string") == "", None).otherwise(F.col(f"new_{c}")).alias(c) for c in rest])

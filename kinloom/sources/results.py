"""Results kept by event and signature, the catalogue of events, and the HTML report."""

from __future__ import annotations

import html
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Events that the face table has, from its folders alone."""
    return spark.read.parquet(path).select("event_id").distinct()


def keep_result(assigned: DataFrame, path: str, signature: str) -> None:
    """Write the result of a clustering; results of other settings stay."""
    out = assigned.withColumn("signature", F.lit(signature)).repartition("signature", "event_id")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("signature", "event_id").parquet(path)


def kept_result(spark: SparkSession, path: str, signature: str, event_id=None) -> DataFrame | None:
    """A kept result, or None if there is none; only its own folders are read."""
    try:
        found = spark.read.parquet(path).where(F.col("signature") == signature)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    found = found if event_id is None else found.where(F.col("event_id") == event_id)
    return None if found.isEmpty() else found.drop("signature")


def keep_summary(summary: DataFrame, path: str, default_settings: bool) -> bool:
    """Materialise a summary row, but only of a run at default or automatic settings."""
    if default_settings:
        summary.write.mode("append").parquet(path)
    return default_settings


def report(persons: DataFrame, members: DataFrame, counters: dict, most_faces: int = 60, most_leftovers: int = 200) -> DataFrame:
    """(event_id, html): a page for each event with its persons, their best faces, its best leftovers and the counters.

    Pages are put together where their rows are; a page grows with the persons of its event, with
    most_faces of each and most_leftovers."""
    from ..operators.review import top_faces

    cell = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    listed = F.concat(F.lit("<ul>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "face_id"))), lambda f: F.concat(F.lit("<li>"), cell(f["face_id"]))), ""), F.lit("</ul></section>"))
    best = top_faces(members.where("person_id is not null"), ["event_id", "person_id"], most_faces).groupBy("event_id", "person_id").agg(listed.alias("f"))
    head = F.concat(F.lit("<section><h2>"), cell(F.col("label")), F.lit("</h2><p>"), F.col("faces").cast("string"), F.lit(" faces in "), F.col("photos").cast("string"), F.lit(" photos</p>"), "f")
    sections = persons.join(best, ["event_id", "person_id"]).select("event_id", F.col("person_id").alias("at"), head.alias("html"))
    told = sections.groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "html"))), lambda x: x["html"]), "\n").alias("people"))
    left = top_faces(members.where("person_id is null"), ["event_id"], most_leftovers).groupBy("event_id").agg(F.concat(F.lit("<section><h2>Leftovers</h2>"), listed).alias("left"))
    rows = "".join(f"<tr><th>{html.escape(str(k))}<td>{html.escape(str(v))}" for k, v in counters.items())
    start = F.lit(f"<!DOCTYPE html><meta charset=utf-8><title>Identities</title><table>{rows}</table>")
    return told.join(left, "event_id", "full").select("event_id", F.concat_ws("\n", start, "people", "left").alias("html"))


class Cache:
    """Results by key, each with the stamp of what it was made from; all go when there are more than `most`.

    A result whose stamp has changed is made anew, so a table that was written again is read again."""

    def __init__(self, most: int = 24, drop: Callable[[object], None] = lambda result: None):
        self.most, self._drop, self._held = most, drop, {}

    def get(self, key, stamp, make: Callable[[], object]):
        held = self._held.get(key)
        if held is not None and held[0] == stamp:
            return held[1]
        if held is not None:
            self._drop(self._held.pop(key)[1])
        if len(self._held) >= self.most:
            self.clear()
        self._held[key] = (stamp, make())
        return self._held[key][1]

    def clear(self) -> None:
        for _, result in self._held.values():
            self._drop(result)
        self._held.clear()

    def __len__(self) -> int:
        return len(self._held)


def stamp(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """What tells that a table was written again: its bytes and its latest file time; None if it isn't there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return None
    size, latest, walk = 0, 0, system.listFiles(where, True)
    while walk.hasNext():
        file = walk.next()
        size, latest = size + file.getLen(), max(latest, file.getModificationTime())
    return size, latest


#: Face tables that are kept decoded on the executors, and their pairs of faces that surely differ.
_TABLES, _NEGATIVES = Cache(8, lambda t: t.unpersist()), Cache(8, lambda t: t.unpersist())


def kept_table(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """`tables.read_faces`, decoded once for as long as the table stays as it is."""
    from .tables import read_faces

    return _TABLES.get((path, version), stamp(spark, path), lambda: read_faces(spark, path, version).persist())


def kept_negatives(spark: SparkSession, path: str, faces: DataFrame) -> DataFrame:
    """`thresholds.same_photo_pairs` of a table's faces, once for as long as the table stays as it is: judgements come on top of it."""
    from ..operators.thresholds import same_photo_pairs

    return _NEGATIVES.get(path, stamp(spark, path), lambda: same_photo_pairs(faces).persist())

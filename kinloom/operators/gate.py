"""Quality gate over detected faces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import reason_root

#: Lower edge and name of each size band, largest first.
BANDS = ((400, "400 px or more"), (200, "200-400 px"), (112, "112-200 px"), (80, "80-112 px"), (50, "50-80 px"), (0, "under 50 px"))


def reject_reason(s: Settings = Settings()) -> Column:
    """The first failing test as text, '' if all pass. Reads height, width, det_score, blur, yaw."""
    aspect = F.col("width") / F.col("height")
    return (
        F.when(F.col("height") < s.min_face_px, F.format_string("too small (%dpx)", F.col("height").cast("long")))
        .when((aspect < s.min_aspect) | (aspect > s.max_aspect), "odd shape")
        .when(F.col("det_score") < s.min_det_score, "low confidence")
        .when(F.col("blur") < s.min_blur_var, "too blurred")
        .when(F.abs("yaw") > s.max_yaw_deg, "turned away")
        .otherwise("")
    )


def quality_score() -> Column:
    return (
        0.40 * F.least(F.lit(1.0), F.col("height") / 200)
        + 0.25 * F.least(F.lit(1.0), F.col("blur") / 200)
        + 0.20 * F.greatest(F.lit(0.0), 1 - F.abs("yaw") / 90)
        + 0.15 * F.col("det_score")
    )


def gated(faces: DataFrame, s: Settings = Settings()) -> DataFrame:
    """faces with reject_reason, accepted, second_class and score."""
    out = faces.withColumn("reject_reason", reject_reason(s)).withColumn("accepted", F.col("reject_reason") == "")
    return out.withColumn("second_class", F.col("accepted") & (F.col("height") < s.second_class_face_px)).withColumn("score", quality_score())


def reasons(faces: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Rejected faces by root of the reason."""
    return gated(faces, s).where(~F.col("accepted")).groupBy(reason_root(F.col("reject_reason")).alias("reason")).agg(F.count("*").alias("n"))


def size_bands(faces: DataFrame) -> DataFrame:
    """Count and share of every band, empty ones too."""
    spark = faces.sparkSession
    band = F.when(F.lit(False), 0)
    for i, (edge, _) in enumerate(BANDS):
        band = band.when(F.col("height") >= edge, i)
    found = faces.groupBy(band.alias("rank")).agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(i, name) for i, (_, name) in enumerate(BANDS)], "rank int, band string")
    total = found.agg(F.sum("n").alias("total"))
    joined = names.join(found, "rank", "left").crossJoin(total)  # one row of totals
    n = F.coalesce("n", F.lit(0))
    return joined.select("band", n.cast("long").alias("n"), F.round(100.0 * n / F.nullif("total", F.lit(0)), 1).alias("pct"))


def accepted_with_counts(faces: DataFrame, version: str, version_col: str = "model_version") -> tuple[DataFrame, DataFrame]:
    """Rows of the version that were accepted, and one row of counts: rejected first, then of another version."""
    stale = F.col("accepted") & (F.col(version_col) != version)
    counts = faces.agg(F.count_if(~F.col("accepted")).alias("rejected"), F.count_if(stale).alias("other_version"), F.count_if(F.col("accepted") & ~stale).alias("kept"))
    return faces.where("accepted").where(F.col(version_col) == version), counts

"""Results as sentences, one row at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C


def clamped_knob(text: Column, now: float, low: float, high: float) -> Column:
    """A knob set by hand: what is no number leaves it as it is."""
    return F.least(F.greatest(F.coalesce(text.try_cast("double"), F.lit(now)), F.lit(low)), F.lit(high))


def matches_name(name: Column, wanted: str) -> Column:
    return F.contains(F.lower(name), F.lit(wanted.strip().lower()))


def risky(height: Column) -> Column:
    """Faces so small that they are easily mistaken."""
    return height < 112


def risky_share(faces: DataFrame) -> DataFrame:
    """One row: faces that are easily mistaken, faces in all, and their share in percent (halves up), 0 without faces."""
    n = faces.agg(F.count_if(risky(F.col("height"))).alias("risky"), F.count("*").alias("faces"))
    return n.withColumn("pct", F.when(F.col("faces") > 0, F.floor(F.col("risky") / F.col("faces") * 100 + 0.5)).otherwise(0).cast("int"))


def small_line_text() -> Column:
    """Of the row that `thresholds.small_face_line` gives."""
    held = F.when(F.col("line").isin(C.SMALL_FLOOR, C.SMALL_CEILING), " It was held at the end of its range.").otherwise("")
    return F.when(F.col("basis") == "default", F.format_string("Using the cautious %.2f for small faces: only %d of them stand beside a known person.", "line", "pairs")).otherwise(
        F.concat(F.format_string("Small faces join within %.2f: of %d that surely are someone else, the closest is at %.2f.", "line", "pairs", "closest"), held)
    )


def verdict_text() -> Column:
    """What judgements say (row: judged, wrong, split_off, people_split): wrong merges first, then splits."""
    return (
        F.when(F.col("judged") == 0, "Nothing has been judged yet.")
        .when(F.col("wrong") > 0, F.concat(F.format_string("%d ", "wrong"), F.when(F.col("wrong") == 1, "face is").otherwise("faces are"), F.lit(" with the wrong person: someone would see a stranger's photos.")))
        .when(F.col("split_off") > 0, F.format_string("Nobody is mixed up, but %d faces that belong together are spread over %d piles.", F.col("split_off"), F.when(F.col("people_split") > 0, F.col("people_split")).otherwise(2)))
        .otherwise("All that was judged is right.")
    )


def evidence_text() -> Column:
    """Of the row that `thresholds.evidence_cut` gives: distances are from face to face."""
    return (
        F.when(F.col("floor").isNull() | F.col("ceiling").isNull(), "Judge pairs of both kinds to measure a line.")
        .when(F.col("floor") >= F.col("ceiling"), F.format_string("The same person reaches %.3f, other people start at %.3f: no line parts them, %.2f does least harm.", "floor", "ceiling", "cut"))
        .otherwise(F.format_string("The same person reaches %.3f, other people start at %.3f; %.2f lies between.", "floor", "ceiling", "cut"))
    )


def merge_line_text() -> Column:
    """Of the row that `thresholds.merge_line` gives."""
    base = (
        F.when(F.col("basis") == "default", F.format_string("Using the usual line of %.2f: only %d pairs to learn from.", "line", "pairs"))
        .when(F.col("basis") == "judged", F.format_string("Line %.2f, measured on %d pairs that surely differ, people's judgements included.", "line", "pairs"))
        .otherwise(F.format_string("Line %.2f, measured on %d pairs that surely differ; the closest of them are at %.2f.", "line", "pairs", "closest"))
    )
    more = F.when(F.col("duplicates") > 0, F.format_string(" %d pairs look like the same face twice and were left out.", "duplicates")).otherwise("")
    limit = F.when(F.col("line") == C.MERGE_CEILING, " It was held at its upper limit.").when(F.col("line") == C.MERGE_FLOOR, " It was held at its lower limit.").otherwise("")
    return F.concat(base, more, limit)


def score_text() -> Column:
    """Of the row that `scoring.pairwise` gives."""
    return F.when(F.col("precision") == 1.0, F.format_string("No two people were mixed up; %.1f%% of pairs were found.", F.col("recall") * 100)).otherwise(
        F.format_string("%.1f%% of grouped pairs are right; %.1f%% of pairs were found.", F.col("precision") * 100, F.col("recall") * 100)
    )

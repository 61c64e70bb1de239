"""Durations, forecasts and stamps as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import FALLBACK_SECONDS_PER_PHOTO


def _whole(x: Column) -> Column:
    """Halves go to the even neighbour."""
    return F.bround(x).cast("long")


def duration_text(seconds: Column) -> Column:
    s = _whole(seconds)
    return (
        F.when(seconds.isNull() | (seconds <= 0), "not recorded")
        .when(seconds < 1, "under 1s")
        .when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm %02ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%dh %02dm", F.floor(s / 3600), F.floor((s % 3600) / 60)))
    )


def forecast_text(seconds: Column) -> Column:
    s = _whole(seconds)
    m = _whole(s / 60)
    return (
        F.when(seconds.isNull() | (seconds <= 0), "no time at all")
        .when(s < 60, F.format_string("%d seconds", s))
        .when(m < 60, F.format_string("%d min", m))
        .otherwise(F.format_string("%dh %02dm", F.floor(m / 60), m % 60))
    )


def spent_text(seconds: Column) -> Column:
    """Time spent so far, cut to whole units; null stays null."""
    s = seconds.cast("long")
    return (
        F.when(s.isNull(), None)
        .when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm", F.floor(s / 60)))
        .otherwise(F.format_string("%dh %dm", F.floor(s / 3600), F.floor((s % 3600) / 60)))
    )


def left_text(seconds: Column) -> Column:
    """Time that is left: cut to seconds, then rounded to minutes; null counts as 0."""
    s = F.coalesce(seconds, F.lit(0)).cast("long")
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%d min", _whole(s / 60)))
        .otherwise(F.format_string("%dh %dm", F.floor(s / 3600), _whole((s % 3600) / 60)))
    )


def forecast_seconds(photos: Column, rate: Column) -> Column:
    return F.least(F.greatest(photos, F.lit(0)), F.lit(2_000_000)) * F.coalesce(rate, F.lit(FALLBACK_SECONDS_PER_PHOTO))


def exif_stamp(text: Column) -> Column:
    """Two notations, no zone; null if neither fits."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss")]).cast("timestamp_ntz")


def local_clock(stamp: Column, zone: str) -> Column:
    """An ISO stamp (without a zone: UTC) on the clock of a zone."""
    return F.from_utc_timestamp(F.try_to_timestamp(stamp), zone)


def relative_date(stamp: Column, today: Column) -> Column:
    days = F.date_diff(today, F.to_date(stamp))
    day = F.when(days == 0, "Today").when(days == 1, "Yesterday").otherwise(F.concat_ws(" ", F.dayofmonth(stamp).cast("string"), F.date_format(stamp, "MMM yyyy")))
    hour = F.hour(stamp) % 12
    return F.format_string("%s, %d:%02d %s", day, F.when(hour == 0, 12).otherwise(hour), F.minute(stamp), F.when(F.hour(stamp) < 12, "am").otherwise("pm"))

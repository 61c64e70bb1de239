"""Event summaries, dashboard groups, progress and the review model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import content_key, link_slug
from .blocks import numbered
from .rollup import size_class

#: Steps of a run, and the phases in which each is under way.
STEPS = (("checking", 1, "Check the source"), ("manifest", 2, "List the photos"), ("loading", 3, "Load the models"), ("processing", 4, "Find the faces"), ("consolidating", 5, "Tidy up"), ("clustering", 6, "Group the people"))


def photo_tallies(photos: DataFrame) -> DataFrame:
    """Per event: faces accepted and detected, photos with faces, with exactly one, the most in one, percent usable."""
    acc, det = F.coalesce("accepted_count", F.lit(0)), F.coalesce("detected_count", F.lit(0))
    t = photos.groupBy("event_id").agg(
        F.sum(acc).cast("long").alias("accepted"), F.sum(det).cast("long").alias("detected"), F.count_if(acc > 0).alias("with_faces"), F.count_if(acc == 1).alias("with_one"), F.max(acc).cast("long").alias("most")
    )
    return t.withColumn("usable_pct", F.when(F.col("detected") > 0, F.round(100.0 * F.col("accepted") / F.col("detected"), 1)).otherwise(0.0))


def summaries(events: DataFrame, progress: DataFrame, timing: DataFrame, tallies: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each event from inputs that are grouped already: a label's name beats the id, its reviewer the journal's."""
    j = events.join(progress, "event_id", "left").join(timing, "event_id", "left").join(tallies, "event_id", "left").join(labels, "event_id", "left")
    processed = F.coalesce("processed", F.lit(0))
    return j.select(
        "event_id", F.coalesce(F.nullif("display_name", F.lit("")), F.col("event_id").cast("string")).alias("name"), F.coalesce(F.nullif("label_reviewer", F.lit("")), F.nullif("reviewer", F.lit(""))).alias("reviewer"),
        F.coalesce("last_run_at", "created_at").alias("filed"), processed.alias("processed"), F.coalesce("failed", F.lit(0)).alias("failed"), size_class(F.col("photo_count"), processed).alias("size_class"),
        F.when(F.col("photo_count") > 0, F.least(F.lit(100.0), F.round(100.0 * processed / F.col("photo_count"), 1))).otherwise(0.0).alias("pct"), (F.coalesce("accepted", F.lit(0)) > 0).alias("has_faces"),
        ((F.coalesce("accepted", F.lit(0)) > 0) & (processed < 10)).alias("too_small"), F.coalesce("mean_rate", F.lit(C.FALLBACK_SECONDS_PER_PHOTO)).alias("rate"),
    )


def size_groups(events: DataFrame) -> DataFrame:
    """Groups of events in a fixed order, empty ones dropped: events and photos of each."""
    rank = F.when(F.col("size_class") == "large", 1).when(F.col("size_class") == "medium", 2).otherwise(3)
    return events.groupBy("size_class", rank.alias("place")).agg(F.count("*").alias("events"), F.sum("photos").cast("long").alias("photos"))


def newest_first(events: DataFrame) -> DataFrame:
    """Events with their place (from 0) by size, date and id, all falling."""
    return numbered(events, [F.col("photos").desc(), F.col("filed").desc(), F.col("event_id").desc()], "place")


def step_states(jobs: DataFrame) -> DataFrame:
    """A row for each step of each job (job_id, phase, failed, pct): todo, now, done or failed; percent on the fourth."""
    steps = F.explode(F.array(*[F.struct(F.lit(n).alias("step"), F.lit(title).alias("title")) for _, n, title in STEPS]))
    at = F.when(F.col("phase") == "done", len(STEPS) + 1)
    for phase, n, _ in STEPS:
        at = at.when(F.col("phase") == phase, n)
    j = jobs.withColumn("at", F.coalesce(at, F.lit(0))).select("*", steps.alias("s")).select("*", "s.step", "s.title")
    state = F.when(F.col("step") < F.col("at"), "done").when((F.col("step") == F.col("at")) & F.col("failed"), "failed").when(F.col("step") == F.col("at"), "now").otherwise("todo")
    return j.select("job_id", "step", "title", state.alias("state"), F.when((F.col("step") == 4) & (F.col("at") == 4), F.col("pct")).alias("pct"))


def active_jobs(jobs: DataFrame) -> DataFrame:
    """The latest unfinished job of each event (event_id, job_id, phase, started)."""
    open_ = jobs.where(~F.col("phase").isin("done", "failed", "stopped"))
    return open_.groupBy("event_id").agg(F.max_by("job_id", "started").alias("job_id"))


def remaining(done: Column, total: Column, rate: Column) -> tuple[Column, Column]:
    """Seconds to go and percent done."""
    return F.greatest(total - done, F.lit(0)) * rate, F.when(total > 0, F.round(F.least(F.lit(100.0), 100.0 * done / total), 1)).otherwise(0.0)


def resumed(done: Column, resumed_from: Column, seconds: Column) -> tuple[Column, Column]:
    """Photos of this run and its seconds, at least a hundredth."""
    return F.greatest(F.lit(0), done - resumed_from), F.greatest(F.lit(0.01), seconds)


def free_ids(links: DataFrame, taken: DataFrame, stamp: str) -> DataFrame:
    """(link, event_id): the id a link asks for, with the day's stamp (mmdd) if it is taken, and a number from 2 if that is too.

    Each link is answered by itself; the smallest free number counts."""
    asked = links.select("link", link_slug(F.col("link")).alias("base")).withColumn("dated", F.concat("base", F.lit(f"-{stamp}")))
    used = taken.select("event_id").distinct()
    parts = rf"^(.*-{stamp})(?:-([2-9]|[1-9]\d+))?$"
    stem, number = F.regexp_extract("event_id", parts, 1), F.regexp_extract("event_id", parts, 2)
    numbers = used.where(stem != "").groupBy(stem.alias("dated")).agg(F.collect_set(F.when(number == "", 1).otherwise(number.try_cast("int"))).alias("ns"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size("ns") + 1), "ns"))
    found = asked.join(used.select(F.col("event_id").alias("base"), F.lit(True).alias("used")), "base", "left").join(numbers, "dated", "left")
    again = F.when(F.col("ns").isNull() | (free == 1), F.col("dated")).otherwise(F.concat("dated", F.lit("-"), free.cast("string")))
    return found.select("link", F.when(F.col("used").isNull(), F.col("base")).otherwise(again).alias("event_id"))


def faces_of_photo(faces: DataFrame) -> DataFrame:
    """Face ids of each photo, read from the ids."""
    return faces.groupBy(F.split("face_id", "_")[0].alias("photo_id")).agg(F.array_join(F.array_sort(F.collect_list("face_id")), ",").alias("faces"))


def pile_keys(members: DataFrame) -> DataFrame:
    """(event_id, person_id, group_key): the key stays the same however persons are numbered."""
    return members.where("person_id is not null").groupBy("event_id", "person_id").agg(content_key(F.collect_list("face_id")).alias("group_key"), F.count("*").alias("size"))


def approvals(piles: DataFrame, judgements: DataFrame) -> DataFrame:
    """piles with the reviewer and record of a live approval of exactly these faces, if any."""
    ok = judgements.where("kind = 'PERSON_OK'").groupBy(F.col("subject").alias("group_key")).agg(F.max_by(F.struct("reviewer", "record_id"), "record_id").alias("j"))
    return piles.join(ok, "group_key", "left").select("event_id", "person_id", "group_key", "size", "j.reviewer", "j.record_id")


def review_model(members: DataFrame, judgements: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """A row for each pile: its faces by falling quality, approval, majority truth label and the faces that don't share it."""
    m = members.where("person_id is not null")
    if truth is not None:
        m = m.join(truth, "face_id", "left")
    else:
        m = m.withColumn("label", F.lit(None).cast("string"))
    count = m.where("label is not null").groupBy("event_id", "person_id", "label").agg(F.count("*").alias("n"))
    best = count.groupBy("event_id", "person_id").agg(F.max(F.struct("n", "label")).alias("b")).select("event_id", "person_id", F.col("b.label").alias("majority"))
    m = m.join(best, ["event_id", "person_id"], "left")
    alien = F.col("label").isNotNull() & (F.col("label") != F.col("majority"))
    face = F.struct((-F.col("quality")).alias("k"), F.col("face_id"), alien.alias("alien"))
    grouped = m.groupBy("event_id", "person_id").agg(F.transform(F.array_sort(F.collect_list(face)), lambda f: F.struct(f["face_id"].alias("face_id"), f["alien"].alias("alien"))).alias("faces"), F.first("majority").alias("majority"), F.count_if(alien).alias("aliens"))
    piles = approvals(pile_keys(members), judgements)
    return grouped.join(piles, ["event_id", "person_id"])


def live_view(tail: DataFrame, photos_done: Column | int) -> DataFrame:
    """Totals of a face tail: faces accepted and detected, small ones (under 112), photos without any face."""
    seen = tail.agg(F.count("*").alias("detected"), F.count_if("accepted").alias("accepted"), F.count_if(F.col("accepted") & (F.col("height") < 112)).alias("under_112"), F.countDistinct("photo_id").alias("photos_seen"))
    done = photos_done if isinstance(photos_done, Column) else F.lit(photos_done)
    return seen.withColumn("photos_without", F.greatest(F.lit(0), done - F.col("photos_seen")))

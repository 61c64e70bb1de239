"""Queries over event summaries, jobs and the review model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events, scoring
from . import planted
from .faces import CELL, FACES, PRED, _pred

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark, d, t):
    return spark.read.parquet(f"{d}/{t}.parquet")


PHOTOS = "photos AS (SELECT o_custkey % 30 AS event_id, o_orderkey AS photo_id, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 4 END AS accepted_count, o_orderkey % 6 AS detected_count FROM orders)"


def _photos(spark, d):
    return read(spark, d, "orders").selectExpr("o_custkey % 30 AS event_id", "o_orderkey AS photo_id", "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 4 END AS accepted_count", "o_orderkey % 6 AS detected_count")


TALLIES = """tallies AS (SELECT event_id, coalesce(sum(accepted_count), 0)::BIGINT AS accepted, sum(detected_count)::BIGINT AS detected, count_if(coalesce(accepted_count, 0) > 0) AS with_faces, count_if(accepted_count = 1) AS with_one, max(coalesce(accepted_count, 0))::BIGINT AS most FROM photos GROUP BY 1)"""


@query(f"WITH {PHOTOS}, {TALLIES} SELECT *, CASE WHEN detected > 0 THEN round(100.0 * accepted / detected, 1) ELSE 0.0 END AS usable_pct FROM tallies")
def photo_tallies(spark, d):
    return events.photo_tallies(_photos(spark, d))


SUMMARY = f"""{PHOTOS}, {TALLIES}, ev AS (SELECT c_custkey % 40 AS event_id, count(*) * 20 AS photo_count, min(c_name) AS created_at FROM customer GROUP BY 1), prog AS (SELECT event_id, count_if(photo_id % 5 <> 0) AS processed, count_if(photo_id % 5 = 0) AS failed FROM photos GROUP BY 1),
timing AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'r' || event_id END AS reviewer, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'x' || event_id END AS last_run_at, CASE WHEN event_id % 2 = 0 THEN 1.5 END AS mean_rate FROM tallies),
label AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'Event ' || event_id END AS display_name, CASE WHEN event_id % 7 = 0 THEN 'boss' END AS label_reviewer FROM tallies WHERE event_id % 2 = 1)"""


@query(
    f"""WITH {SUMMARY}, j AS (SELECT *, coalesce(processed, 0) AS p FROM ev LEFT JOIN prog USING (event_id) LEFT JOIN timing USING (event_id) LEFT JOIN tallies USING (event_id) LEFT JOIN label USING (event_id))
SELECT event_id, coalesce(nullif(display_name, ''), event_id::VARCHAR) AS name, coalesce(nullif(label_reviewer, ''), nullif(reviewer, '')) AS reviewer, coalesce(last_run_at, created_at) AS filed, p AS processed, coalesce(failed, 0) AS failed,
  CASE WHEN greatest(photo_count, p) >= 500 THEN 'large' WHEN greatest(photo_count, p) >= 100 THEN 'medium' ELSE 'small' END AS size_class, CASE WHEN photo_count > 0 THEN least(100.0, round(100.0 * p / photo_count, 1)) ELSE 0.0 END AS pct,
  coalesce(accepted, 0) > 0 AS has_faces, coalesce(accepted, 0) > 0 AND p < 10 AS too_small, coalesce(mean_rate, 2.27) AS rate FROM j"""
)
def event_summaries(spark, d):
    photos = _photos(spark, d)
    tallies = events.photo_tallies(photos)
    ev = read(spark, d, "customer").groupBy((F.col("c_custkey") % 40).alias("event_id")).agg((F.count("*") * 20).alias("photo_count"), F.min("c_name").alias("created_at"))
    prog = photos.groupBy("event_id").agg(F.count_if(F.col("photo_id") % 5 != 0).alias("processed"), F.count_if(F.col("photo_id") % 5 == 0).alias("failed"))
    timing = tallies.selectExpr("event_id", "CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('r', event_id) END AS reviewer", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('x', event_id) END AS last_run_at", "CASE WHEN event_id % 2 = 0 THEN 1.5D END AS mean_rate")
    label = tallies.where("event_id % 2 = 1").selectExpr("event_id", "CASE WHEN event_id % 5 = 0 THEN '' ELSE concat('Event ', event_id) END AS display_name", "CASE WHEN event_id % 7 = 0 THEN 'boss' END AS label_reviewer")
    return events.summaries(ev, prog, timing, tallies.select("event_id", "accepted"), label)


SIZED = "sized AS (SELECT o_custkey AS event_id, count(*) * 40 AS photos, max(o_orderdate) AS filed FROM orders GROUP BY 1), c AS (SELECT *, CASE WHEN photos >= 500 THEN 'large' WHEN photos >= 100 THEN 'medium' ELSE 'small' END AS size_class FROM sized)"


def _sized(spark, d):
    from ..operators.rollup import size_class

    s = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("event_id")).agg((F.count("*") * 40).alias("photos"), F.max("o_orderdate").alias("filed"))
    return s.withColumn("size_class", size_class(F.col("photos"), F.lit(0)))


@query(f"WITH {SIZED} SELECT size_class, CASE size_class WHEN 'large' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS place, count(*) AS events, sum(photos)::BIGINT AS photos FROM c GROUP BY 1, 2")
def size_groups(spark, d):
    return events.size_groups(_sized(spark, d))


@query(f"WITH {SIZED} SELECT event_id, photos, filed, row_number() OVER (ORDER BY photos DESC, filed DESC, event_id DESC) AS place FROM c")
def newest_events(spark, d):
    return events.newest_first(_sized(spark, d)).select("event_id", "photos", "filed", (F.col("place") + 1).alias("place"))


JOBS = "jobs AS (SELECT o_orderkey AS job_id, o_custkey % 60 AS event_id, CASE o_orderkey % 8 WHEN 0 THEN 'queued' WHEN 1 THEN 'checking' WHEN 2 THEN 'manifest' WHEN 3 THEN 'loading' WHEN 4 THEN 'processing' WHEN 5 THEN 'consolidating' WHEN 6 THEN 'clustering' ELSE 'done' END AS phase, o_orderkey % 3 = 0 AS failed, (o_orderkey % 100)::DOUBLE AS pct FROM orders)"


def _jobs(spark, d):
    phase = F.element_at(F.array(*map(F.lit, ("queued", "checking", "manifest", "loading", "processing", "consolidating", "clustering", "done"))), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 60).alias("event_id"), phase.alias("phase"), (F.col("o_orderkey") % 3 == 0).alias("failed"), (F.col("o_orderkey") % 100).cast("double").alias("pct"), F.col("o_orderkey").alias("started"))


@query(
    f"""WITH {JOBS}, steps(step, phase_name, title) AS (VALUES (1, 'checking', 'Check the source'), (2, 'manifest', 'List the photos'), (3, 'loading', 'Load the models'), (4, 'processing', 'Find the faces'), (5, 'consolidating', 'Tidy up'), (6, 'clustering', 'Group the people')),
placed AS (SELECT j.*, CASE WHEN phase = 'done' THEN 7 ELSE coalesce(s.step, 0) END AS here FROM jobs j LEFT JOIN steps s ON phase_name = phase)
SELECT job_id, steps.step, title, CASE WHEN steps.step < here THEN 'done' WHEN steps.step = here AND failed THEN 'failed' WHEN steps.step = here THEN 'now' ELSE 'todo' END AS state, CASE WHEN steps.step = 4 AND here = 4 THEN pct END AS pct FROM placed CROSS JOIN steps"""
)
def step_states(spark, d):
    return events.step_states(_jobs(spark, d))


@query(f"WITH {JOBS} SELECT event_id, max(job_id) AS job_id FROM jobs WHERE phase <> 'done' GROUP BY 1")
def active_jobs(spark, d):
    return events.active_jobs(_jobs(spark, d))


@query("SELECT o_orderkey AS job_id, greatest(500 - o_orderkey % 600, 0) * 2.5 AS seconds, round(least(100.0, 100.0 * (o_orderkey % 600) / 500), 1) AS pct, greatest(0, o_orderkey % 600 - 100) AS processed FROM orders")
def job_eta(spark, d):
    done = F.col("o_orderkey") % 600
    left, pct = events.remaining(done, F.lit(500), F.lit(2.5))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), left.alias("seconds"), pct.alias("pct"), events.resumed(done, F.lit(100), F.lit(1.0))[0].alias("processed"))


@query(f"WITH {FACES} SELECT split_part(face_id, '_', 1) AS photo_id, string_agg(face_id, ',' ORDER BY face_id) AS faces FROM faces GROUP BY 1")
def faces_of_photo(spark, d):
    return events.faces_of_photo(planted.faces(spark, d))


KEYS = "piles AS (SELECT event_id, pred AS person_id, 'grp:' || substr(sha1(string_agg(item, '|' ORDER BY item)), 1, 16) AS group_key, count(*) AS size FROM pred WHERE pred IS NOT NULL GROUP BY 1, 2)"


def _members(spark, d):
    p = _pred(planted.faces(spark, d))
    return p.select("event_id", F.col("item").alias("face_id"), F.col("pred").alias("person_id"), F.col("truth"))


def _approved(members):
    k = events.pile_keys(members).where("person_id % 3 = 0")
    return k.select(F.lit("PERSON_OK").alias("kind"), F.col("group_key").alias("subject"), F.concat(F.lit("r"), F.col("person_id").cast("string")).alias("reviewer"), F.concat_ws("-", "event_id", "person_id").alias("record_id"))


@query(f"WITH {FACES}, {PRED}, {KEYS} SELECT event_id, person_id, group_key, size, CASE WHEN person_id % 3 = 0 THEN 'r' || person_id END AS reviewer, CASE WHEN person_id % 3 = 0 THEN event_id || '-' || person_id END AS record_id FROM piles")
def pile_approvals(spark, d):
    m = _members(spark, d)
    return events.approvals(events.pile_keys(m), _approved(m))


@query(
    f"""WITH {FACES}, {PRED}, {CELL}, {KEYS}, home AS (SELECT event_id, pred, arg_max(truth, n * 1000 + truth) AS major FROM cell GROUP BY 1, 2)
SELECT event_id, pred AS person_id, count(*) AS size, 'L' || any_value(major) AS majority, count_if(truth <> major) AS aliens, arg_max(item, quality * 1e6 - row) AS first_face FROM (SELECT p.*, f.quality, row_number() OVER (ORDER BY item) AS row FROM pred p JOIN faces f ON f.face_id = p.item) JOIN home USING (event_id, pred) GROUP BY 1, 2"""
)
def review_model(spark, d):
    f = planted.faces(spark, d)
    m = _members(spark, d).join(f.select("face_id", "quality"), "face_id")
    truth = m.select("face_id", F.concat(F.lit("L"), F.col("truth").cast("string")).alias("label"))
    out = events.review_model(m.drop("truth"), _approved(m), truth)
    return out.select("event_id", "person_id", "size", "majority", "aliens", F.col("faces")[0]["face_id"].alias("first_face"))


@query(f"WITH {FACES} SELECT count(*) AS detected, count_if(height >= 50) AS accepted, count_if(height >= 50 AND height < 112) AS under_112, count(DISTINCT photo_id) AS photos_seen, greatest(0, 300 - count(DISTINCT photo_id)) AS photos_without FROM faces")
def live_view(spark, d):
    return events.live_view(planted.faces(spark, d).withColumn("accepted", F.col("height") >= 50), 300)


@query(f"WITH {FACES}, {PRED} SELECT event_id, truth, count(DISTINCT pred) AS persons FROM pred GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY persons DESC, truth) = 1")
def worst_split(spark, d):
    s = scoring.splits(_pred(planted.faces(spark, d)))
    best = s.groupBy("event_id").agg(F.max(F.struct("persons", (-F.col("truth")).alias("k"))).alias("b"))
    return best.select("event_id", (-F.col("b.k")).alias("truth"), "b.persons")


@query("SELECT doc_id, least(greatest(coalesce(try_cast(CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE (doc_id % 200)::VARCHAR END AS DOUBLE) , 42.0), 1.0), 150.0) AS knob, contains(lower(source), 'rc1') AS shown FROM documents")
def knobs_and_names(spark, d):
    from ..operators import sentences

    x = read(spark, d, "documents")
    raw = F.when(F.col("doc_id") % 3 == 0, "x").otherwise((F.col("doc_id") % 200).cast("string"))
    return x.select("doc_id", sentences.clamped_knob(raw, 42.0, 1.0, 150.0).alias("knob"), sentences.matches_name(F.col("source"), " RC1").alias("shown"))


@query(f"WITH {FACES}, {PRED}, {CELL}, t AS (SELECT event_id, truth, sum(n) AS n, max(n) AS top FROM cell GROUP BY 1, 2) SELECT event_id, round(sum(top) / sum(n), 6) AS completeness FROM t GROUP BY 1")
def completeness(spark, d):
    c = _pred(planted.faces(spark, d)).where("pred is not null").groupBy("event_id", "truth", "pred").agg(F.count("*").alias("n")).groupBy("event_id", "truth").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    return c.groupBy("event_id").agg(F.round(F.sum("top") / F.sum("n"), 6).alias("completeness"))

"""Queries over planted faces: gate, vectors, thresholds, identities, scoring."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import vector as V
from ..functions.text import content_key
from ..operators import cluster, gate, scoring, thresholds
from . import planted

QUERIES: dict = {}
ORACLES: dict = {}
DOT = "list_dot_product"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


FACES, COLLIDE, HARD = planted.sql(), planted.sql(collide=True), planted.sql(1.25)
REASON = """CASE WHEN height < 50 THEN printf('too small (%dpx)', height) WHEN width / height < 0.4 OR width / height > 2.5 THEN 'odd shape'
  WHEN det_score < 0.6 THEN 'low confidence' WHEN blur < 12 THEN 'too blurred' WHEN abs(yaw) > 50 THEN 'turned away' ELSE '' END"""
SCORE = "0.40 * least(1.0, height / 200) + 0.25 * least(1.0, blur / 200) + 0.20 * greatest(0.0, 1 - abs(yaw) / 90) + 0.15 * det_score"
GATED = f"gated AS (SELECT *, {REASON} AS reject_reason FROM faces)"


@query(f"WITH {FACES}, {GATED} SELECT face_id, reject_reason, reject_reason = '' AS accepted, reject_reason = '' AND height < 80 AS second_class FROM gated")
def gate_decision(spark, d):
    return gate.gated(planted.faces(spark, d)).select("face_id", "reject_reason", "accepted", "second_class")


@query(f"WITH {FACES}, {GATED} SELECT split_part(reject_reason, ' (', 1) AS reason, count(*) AS n FROM gated WHERE reject_reason <> '' GROUP BY 1")
def gate_reasons(spark, d):
    return gate.reasons(planted.faces(spark, d))


@query(f"WITH {FACES} SELECT face_id, round({SCORE}, 6) AS score FROM faces")
def quality_score(spark, d):
    return planted.faces(spark, d).select("face_id", F.round(gate.quality_score(), 6).alias("score"))


@query(
    f"""WITH {FACES}, bands(edge, top, band) AS (VALUES (400, 100000, '400 px or more'), (200, 400, '200-400 px'), (112, 200, '112-200 px'), (80, 112, '80-112 px'), (50, 80, '50-80 px'), (0, 50, 'under 50 px'))
SELECT band, count(face_id) AS n, round(100.0 * count(face_id) / (SELECT count(*) FROM faces), 1) AS pct FROM bands LEFT JOIN faces ON height >= edge AND height < top GROUP BY band"""
)
def size_bands(spark, d):
    return gate.size_bands(planted.faces(spark, d))


@query(f"WITH {FACES}, v AS (SELECT *, CASE WHEN vec_id % 10 = 0 THEN 'old' ELSE 'new' END AS version, height >= 50 AS ok FROM faces) SELECT count_if(NOT ok) AS rejected, count_if(ok AND version <> 'new') AS other_version, count_if(ok AND version = 'new') AS kept FROM v")
def version_filter_counts(spark, d):
    v = planted.faces(spark, d).withColumn("model_version", F.when(F.col("vec_id") % 10 == 0, "old").otherwise("new")).withColumn("accepted", F.col("height") >= 50)
    return gate.accepted_with_counts(v, "new")[1]


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, len(embedding)::INT AS size FROM embeddings")
def vec_norm(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 5).alias("norm"), F.size("embedding").alias("size"))


@query(f"WITH {FACES} SELECT a.face_id AS a, b.face_id AS b, round(1 - {DOT}(a.x, b.x), 6) AS d FROM faces a JOIN faces b ON a.event_id = b.event_id AND a.photo_id = b.photo_id AND a.face_id < b.face_id")
def pair_distance(spark, d):
    return thresholds.same_photo_pairs(planted.faces(spark, d), None).select("a", "b", F.round("d", 6).alias("d"))


CENT = f"""summed AS (SELECT label, i, sum((0.5 + quality) * x[i]) / sum(0.5 + quality) AS v FROM faces, unnest(range(1, len(x) + 1)) AS t(i) GROUP BY label, i),
cents AS (SELECT label, list(v ORDER BY i) AS c FROM summed GROUP BY label),
units AS (SELECT label, list_transform(c, lambda v: v / sqrt({DOT}(c, c))) AS c FROM cents)"""


@query(f"WITH {FACES}, {CENT} SELECT label, i::INT AS i, round(c[i], 6) AS v FROM units, unnest(range(1, len(c) + 1)) AS t(i)")
def centroid_weighted(spark, d):
    c = cluster.centroids(planted.faces(spark, d).select("label", "x", "quality"), ["label"])
    return c.select("label", F.posexplode("centroid").alias("k", "c")).select("label", (F.col("k") + 1).alias("i"), F.round("c", 6).alias("v"))


@query(f"WITH {FACES}, {CENT}, near AS (SELECT face_id, u.label AS person, 1 - {DOT}(x, c) AS dist FROM faces f CROSS JOIN units u) SELECT face_id, arg_min(person, dist) AS person, round(min(dist), 6) AS d FROM near GROUP BY face_id")
def nearest_centroid(spark, d):
    from ..operators.search import nearest_persons

    f = planted.faces(spark, d)
    c = cluster.centroids(f.select("label", "x", "quality"), ["label"]).withColumnRenamed("label", "person")
    near = nearest_persons(f.select(F.col("face_id").alias("q"), F.col("x").alias("qx")), c, line=3.0, margin=0.0)  # no one is further than 2
    return near.select(F.col("q").alias("face_id"), "person", "d")


@query(f"WITH {FACES}, {CENT} SELECT label, min(height) AS min_height, max(height) AS max_height, round(max(1 - {DOT}(x, c)), 6) AS furthest FROM faces JOIN units USING (label) GROUP BY label")
def spread(spark, d):
    f = planted.faces(spark, d)
    c = cluster.centroids(f.select("label", "x", "quality"), ["label"])
    far = V.unit_distance(F.col("x"), F.col("centroid"))
    return f.join(c, "label").groupBy("label").agg(F.min("height").alias("min_height"), F.max("height").alias("max_height"), F.round(F.max(far), 6).alias("furthest"))


PAIRS = f"pairs AS (SELECT a.event_id, 1 - {DOT}(a.x, b.x) AS d FROM kept a JOIN kept b ON a.event_id = b.event_id AND a.photo_id = b.photo_id AND a.face_id < b.face_id)"
LINE = """SELECT event_id, CASE WHEN count_if(d >= 0.2) >= 200 THEN round(least(greatest(quantile_cont(d, 0.01) FILTER (d >= 0.2) * 0.82, 0.40), 0.62), 2) ELSE 0.55 END AS line,
  round(quantile_cont(d, 0.01) FILTER (d >= 0.2), 6) AS closest, count_if(d >= 0.2) AS pairs, count_if(d < 0.2) AS duplicates, CASE WHEN count_if(d >= 0.2) >= 200 THEN 'measured' ELSE 'default' END AS basis FROM pairs GROUP BY event_id"""


@query(f"WITH {FACES}, kept AS (SELECT * FROM faces WHERE height >= 50), {PAIRS} SELECT event_id, count(*) AS pairs, round(min(d), 6) AS closest, round(avg(d), 6) AS mean FROM pairs GROUP BY event_id")
def same_photo_negatives(spark, d):
    p = thresholds.same_photo_pairs(planted.faces(spark, d).where("height >= 50"))
    return p.groupBy("event_id").agg(F.count("*").alias("pairs"), F.round(F.min("d"), 6).alias("closest"), F.round(F.avg("d"), 6).alias("mean"))


@query(f"WITH {FACES}, kept AS (SELECT * FROM faces WHERE height >= 50), {PAIRS} {LINE}")
def merge_line_auto(spark, d):
    return thresholds.merge_line(thresholds.same_photo_pairs(planted.faces(spark, d).where("height >= 50")))


@query(f"WITH {COLLIDE}, kept AS (SELECT * FROM faces WHERE height >= 50), {PAIRS} {LINE}")
def merge_line_collisions(spark, d):
    return thresholds.merge_line(thresholds.same_photo_pairs(planted.faces(spark, d, collide=True).where("height >= 50")))


SMALL = f"""small AS (SELECT s.event_id, 1 - {DOT}(s.x, b.x) AS d FROM faces s JOIN faces b ON s.event_id = b.event_id AND s.photo_id = b.photo_id AND s.height < 80 AND b.height >= 80)"""


@query(
    f"""WITH {HARD}, {SMALL} SELECT event_id, CASE WHEN count(*) >= 100 THEN round(least(greatest(quantile_cont(d, 0.01) * 0.75, 0.30), 0.55), 2) ELSE 0.38 END AS line, round(quantile_cont(d, 0.01), 6) AS closest, count(*) AS pairs,
  CASE WHEN count(*) >= 100 THEN 'measured' ELSE 'default' END AS basis FROM small GROUP BY event_id"""
)
def small_face_line(spark, d):
    f = planted.faces(spark, d, 1.25)
    s = f.where("height < 80").select("event_id", "photo_id", F.col("x").alias("xs"))
    pairs = s.join(f.where("height >= 80").select("event_id", "photo_id", "x"), ["event_id", "photo_id"])
    return thresholds.small_face_line(pairs.select("event_id", V.unit_distance(F.col("xs"), F.col("x")).alias("d")))


JUDGED = f"judged AS (SELECT a.event_id, round(1 - {DOT}(a.x, b.x), 6) AS d, a.label = b.label AS same FROM faces a JOIN faces b ON a.event_id = b.event_id AND b.vec_id IN (a.vec_id + 3, a.vec_id + 10))"


def _judged(f):
    b = f.select("event_id", F.col("label").alias("lb"), F.col("vec_id").alias("vb"), F.col("x").alias("xb"))
    near = f.withColumn("vb", F.explode(F.array(F.col("vec_id") + 3, F.col("vec_id") + 10)))
    return near.join(b, ["event_id", "vb"]).select("event_id", F.round(V.unit_distance(F.col("x"), F.col("xb")), 6).alias("d"), (F.col("label") == F.col("lb")).alias("same"))


@query(
    f"""WITH {HARD}, {JUDGED}, ends AS (SELECT event_id, max(d) FILTER (same) AS floor, min(d) FILTER (NOT same) AS ceiling, count_if(same) AS ns, count_if(NOT same) AS nd FROM judged GROUP BY 1),
ds AS (SELECT DISTINCT event_id, d FROM judged), nx AS (SELECT *, lead(d) OVER (PARTITION BY event_id ORDER BY d) AS nxt FROM ds),
cuts AS (SELECT event_id, CASE WHEN nxt IS NULL THEN least(1.0, d + 0.05) ELSE round((d + nxt) / 2, 4) END AS cut, d AS upto FROM nx UNION ALL SELECT event_id, greatest(0.0, min(d) - 0.05), -1 FROM ds GROUP BY 1),
costs AS (SELECT c.event_id, c.cut, round(3 * count_if(NOT same AND d <= upto) / greatest(any_value(nd), 1) + count_if(same AND d > upto) / greatest(any_value(ns), 1), 9) AS cost FROM cuts c JOIN judged USING (event_id) JOIN ends USING (event_id) GROUP BY 1, 2, c.upto),
ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY cost, cut) AS k FROM costs)
SELECT event_id, round(floor, 6) AS floor, round(ceiling, 6) AS ceiling, CASE WHEN coalesce(floor < ceiling, true) THEN round((coalesce(floor, ceiling) + coalesce(ceiling, floor)) / 2, 3) ELSE round(cut, 4) END AS cut,
  CASE WHEN coalesce(floor < ceiling, true) THEN 0.0 ELSE cost END AS cost FROM ends JOIN ranked USING (event_id) WHERE k = 1"""
)
def evidence_cut(spark, d):
    return thresholds.evidence_cut(_judged(planted.faces(spark, d, 1.25)))


@query(f"WITH {FACES} SELECT event_id, face_id, min(face_id) OVER (PARTITION BY event_id, label) AS \"group\" FROM faces WHERE height >= 80")
def pass1_linkage(spark, d):
    """The planted labels are what pass 1 has to find."""
    return cluster.pass1(planted.faces(spark, d).where("height >= 80"))


NUMBERED = f"""{FACES}, first AS (SELECT event_id, label, count(*) AS n, min(face_id) AS f FROM faces WHERE height >= 80 GROUP BY 1, 2),
numbered AS (SELECT event_id, label, CASE WHEN n >= 3 THEN (row_number() OVER (PARTITION BY event_id ORDER BY n DESC, f) - 1)::INT END AS person_id FROM first)"""


@query(f"WITH {NUMBERED} SELECT event_id, face_id, person_id FROM faces LEFT JOIN numbered USING (event_id, label)")
def identities(spark, d):
    """All passes; the planted labels are what they have to find, small faces included."""
    return cluster.identities(planted.faces(spark, d))


# Splitting, merging and suppressing are greedy: the SQL walks through them step by step, with what has been decided so far in a list.
_PLUS = "list_transform(range(1, len(x) + 1), lambda i: {} + w * x[i])"
SPLIT = f"""marked AS (SELECT event_id, label, face_id, photo_id, x, 0.5 + quality AS w, row_number() OVER (PARTITION BY event_id, label ORDER BY quality DESC, face_id) AS k FROM faces WHERE height >= 80),
double AS (SELECT event_id, label FROM marked GROUP BY 1, 2 HAVING count(*) > count(DISTINCT photo_id)),
walk(event_id, label, k, st) AS (SELECT event_id, label, k, [{{'f': [face_id], 'p': [photo_id], 's': list_transform(x, lambda v: w * v)}}] FROM marked SEMI JOIN double USING (event_id, label) WHERE k = 1 UNION ALL
  SELECT event_id, label, k, CASE WHEN best IS NULL THEN list_append(st, {{'f': [face_id], 'p': [photo_id], 's': list_transform(x, lambda v: w * v)}})
    ELSE list_transform(st, lambda o, j: CASE WHEN j = list_position(ds, best) THEN {{'f': list_append(o.f, face_id), 'p': list_append(o.p, photo_id), 's': {_PLUS.format("o.s[i]")}}} ELSE o END) END
  FROM (SELECT *, list_min(list_filter(ds, lambda v: v < 0.42)) AS best FROM (SELECT m.*, w.st, list_transform(w.st, lambda o: CASE WHEN list_contains(o.p, photo_id) THEN 9.0 ELSE 1 - {DOT}(o.s, x) / sqrt({DOT}(o.s, o.s)) END) AS ds
    FROM walk w JOIN marked m ON m.event_id = w.event_id AND m.label = w.label AND m.k = w.k + 1))),
parts AS (SELECT event_id, unnest(st).f AS f FROM (SELECT event_id, label, arg_max(st, k) AS st FROM walk GROUP BY 1, 2))"""


@query(
    f"""WITH RECURSIVE {COLLIDE}, {SPLIT} SELECT event_id, unnest(f) AS face_id, list_min(f) AS "group" FROM parts
UNION ALL SELECT event_id, face_id, min(face_id) OVER (PARTITION BY event_id, label) AS "group" FROM marked ANTI JOIN double USING (event_id, label)"""
)
def repair_groups(spark, d):
    """Photos that hold a label twice: linkage finds the labels, and they must be split."""
    return cluster.pass1(planted.faces(spark, d, collide=True).where("height >= 80"))


FRAGMENT = "(vec_id // 4) % 5"
MERGE = f"""frag AS (SELECT *, min(face_id) OVER (PARTITION BY event_id, label, {FRAGMENT}) AS g FROM faces WHERE height >= 80),
{CENT.replace("label, i", "event_id, g, i").replace("SELECT label, list", "SELECT event_id, g, list").replace("SELECT label, list_transform", "SELECT event_id, g, list_transform").replace("GROUP BY label)", "GROUP BY event_id, g)").replace("FROM faces,", "FROM frag,")},
held AS (SELECT event_id, g, list(DISTINCT photo_id) AS p FROM frag GROUP BY 1, 2),
pairs AS (SELECT a.event_id, a.g AS a, b.g AS b, row_number() OVER (PARTITION BY a.event_id ORDER BY 1 - {DOT}(a.c, b.c), a.g, b.g) AS k FROM units a JOIN units b ON a.event_id = b.event_id AND a.g < b.g AND 1 - {DOT}(a.c, b.c) < 0.55),
walk(event_id, k, st, stopped) AS (SELECT event_id, 0, list({{'g': g, 'r': g, 'p': p}}), 0 FROM held GROUP BY event_id UNION ALL
  SELECT event_id, k, CASE WHEN ra = rb OR shared THEN st ELSE list_transform(st, lambda o: CASE WHEN o.r = ra OR o.r = rb THEN {{'g': o.g, 'r': least(ra, rb), 'p': o.p}} ELSE o END) END, stopped + (ra <> rb AND shared)::INT
  FROM (SELECT *, list_has_any(flatten(list_transform(list_filter(st, lambda o: o.r = ra), lambda o: o.p)), flatten(list_transform(list_filter(st, lambda o: o.r = rb), lambda o: o.p))) AS shared
    FROM (SELECT q.event_id, q.k, w.st, w.stopped, list_filter(w.st, lambda o: o.g = q.a)[1].r AS ra, list_filter(w.st, lambda o: o.g = q.b)[1].r AS rb FROM walk w JOIN pairs q ON q.event_id = w.event_id AND q.k = w.k + 1))),
last AS (SELECT event_id, arg_max(st, k) AS st, arg_max(stopped, k) AS stopped FROM walk GROUP BY 1)"""


def _fragments(f):
    """Every label in up to five groups, dealt by ids: several of them share photos."""
    part = F.min("face_id").over(Window.partitionBy("event_id", "label", F.floor(F.col("vec_id") / 4) % 5))
    return f.select("event_id", "face_id", part.alias("group"))


@query(f"""WITH RECURSIVE {COLLIDE}, {MERGE}, each AS (SELECT event_id, unnest(st) AS o, stopped FROM last) SELECT event_id, o.g AS "group", o.r AS root, stopped::BIGINT AS blocked FROM each""")
def pass2_merge(spark, d):
    """Fragments merge closest first, but never two that share a photo."""
    f = planted.faces(spark, d, collide=True).where("height >= 80")
    return cluster.pass2(f, _fragments(f))


ATTACH = f"""big AS (SELECT event_id, label, photo_id, x, quality FROM faces WHERE height >= 80),
{CENT.replace("label, i", "event_id, label, i").replace("SELECT label, list", "SELECT event_id, label, list").replace("GROUP BY label)", "GROUP BY event_id, label)").replace("FROM faces,", "FROM big,")},
reach AS (SELECT s.event_id, face_id, photo_id, u.label, 1 - {DOT}(s.x, u.c) AS d FROM faces s JOIN units u ON s.event_id = u.event_id WHERE s.height < 80),
near AS (SELECT event_id, face_id, photo_id, arg_min(label, d) AS label FROM reach GROUP BY 1, 2, 3 HAVING min(d) < 0.38),
won AS (SELECT event_id, label, photo_id, min(face_id) AS face_id FROM near ANTI JOIN big USING (event_id, label, photo_id) GROUP BY 1, 2, 3)"""


@query(f"WITH {COLLIDE}, {ATTACH} SELECT f.event_id, f.face_id, w.label AS person_id FROM faces f LEFT JOIN won w ON w.event_id = f.event_id AND w.face_id = f.face_id WHERE f.height < 80")
def attach_small(spark, d):
    """Small faces next to persons that are the labels; four neighbours share a photo, so some come too late or meet their own person."""
    f = planted.faces(spark, d, collide=True)
    big, small = f.where("height >= 80"), f.where("height < 80")
    return cluster.attach_small(big, big.select("event_id", "face_id", F.col("label").alias("person_id")), small, 0.38)


@query(
    f"""WITH {planted.sql(loners=True)}, first AS (SELECT event_id, CASE WHEN vec_id % 17 = 0 THEN -1 - vec_id % 64 ELSE label END AS label, count(*) AS n FROM faces WHERE height >= 80 GROUP BY 1, 2)
SELECT f.event_id, face_id, NULL::INT AS person_id FROM faces f LEFT JOIN first g ON g.event_id = f.event_id AND g.label = CASE WHEN vec_id % 17 = 0 THEN -1 - vec_id % 64 ELSE f.label END WHERE coalesce(n, 0) < 3"""
)
def leftovers(spark, d):
    """Faces that are alone, or nearly, in their direction belong to no one."""
    return cluster.identities(planted.faces(spark, d, loners=True)).where("person_id is null")


# Scoring is tested on assignments made up from ids, the same on both engines.
PRED = f"pred AS (SELECT event_id, face_id AS item, label AS truth, photo_id, CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 7 = 0 THEN (label + 1) % 10 WHEN vec_id % 5 = 0 THEN label + 20 ELSE label END AS pred FROM faces)"


def _pred(f):
    v, lab = F.col("vec_id"), F.col("label")
    p = F.when(v % 11 == 0, None).when(v % 7 == 0, (lab + 1) % 10).when(v % 5 == 0, lab + 20).otherwise(lab)
    return f.select("event_id", F.col("face_id").alias("item"), lab.alias("truth"), "photo_id", p.cast("long").alias("pred"))


@query(
    f"""WITH {FACES}, {PRED}, pairs AS (SELECT a.event_id, coalesce(a.pred = b.pred, false) AS claimed, a.truth = b.truth AS is_true FROM pred a JOIN pred b ON a.event_id = b.event_id AND a.item < b.item),
s AS (SELECT event_id, count_if(claimed) AS c, count_if(is_true) AS t, count_if(claimed AND is_true) AS k FROM pairs GROUP BY 1), q AS (SELECT event_id, CASE WHEN c = 0 THEN 1.0 ELSE k / c END AS p, CASE WHEN t = 0 THEN 1.0 ELSE k / t END AS r FROM s)
SELECT event_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM q"""
)
def eval_pairs(spark, d):
    return scoring.pairwise(_pred(planted.faces(spark, d)))


CELL = "cell AS (SELECT event_id, pred, truth, count(*) AS n FROM pred WHERE pred IS NOT NULL GROUP BY 1, 2, 3)"


@query(f"WITH {FACES}, {PRED}, {CELL} SELECT event_id, pred, count(*) AS labels, sum(n)::BIGINT AS size, arg_max(truth, n * 1000 - truth) AS majority, round(max(n) / sum(n), 6) AS purity FROM cell GROUP BY 1, 2 HAVING count(*) > 1")
def contamination(spark, d):
    return scoring.contamination(_pred(planted.faces(spark, d)))


@query(f"WITH {FACES}, {PRED} SELECT event_id, truth, count(*) AS faces, count(DISTINCT pred) AS persons, count_if(pred IS NULL) AS leftovers FROM pred GROUP BY 1, 2")
def splits(spark, d):
    return scoring.splits(_pred(planted.faces(spark, d)))


@query(f"WITH {FACES}, {PRED}, {CELL}, home AS (SELECT event_id, truth, arg_max(pred, n * 1000 - pred) AS home FROM cell GROUP BY 1, 2) SELECT event_id, item, truth, pred, home FROM pred LEFT JOIN home USING (event_id, truth) WHERE pred IS NULL OR pred <> home")
def misplaced(spark, d):
    return scoring.misplaced(_pred(planted.faces(spark, d)))


@query(
    f"""WITH {FACES}, {PRED}, c AS (SELECT event_id, count(DISTINCT pred) AS people, count(DISTINCT photo_id) * 8 AS photos, count_if(pred IS NULL) AS leftovers FROM pred GROUP BY 1), r AS (SELECT *, people / photos * 1000 AS rate FROM c)
SELECT event_id, round(rate, 3) AS per_1000, concat_ws('; ', CASE WHEN photos >= 200 AND rate < 10 THEN 'few people' END, CASE WHEN photos >= 200 AND rate > 125 THEN 'many people' END, CASE WHEN leftovers > 0 THEN 'leftovers' END) AS alarms FROM r"""
)
def sanity(spark, d):
    p = _pred(planted.faces(spark, d))
    return scoring.sanity(p.groupBy("event_id").agg(F.countDistinct("pred").alias("people"), (F.countDistinct("photo_id") * 8).alias("photos"), F.count_if(F.col("pred").isNull()).alias("leftovers")))


@query(
    f"""WITH {FACES}, {PRED}, two AS (SELECT a.item AS a, b.item AS b, a.pred AS pa, b.pred AS pb, a.truth = b.truth AS same FROM pred a JOIN pred b ON a.event_id = b.event_id AND a.photo_id + 2 = b.photo_id)
SELECT count_if(same) AS same_pairs, count_if(NOT same) AS different_pairs, round(count_if(same AND pa = pb) / count_if(same), 6) AS recall, round(1 - count_if(NOT same AND pa = pb) / count_if(NOT same), 6) AS merge_safety FROM two"""
)
def judged_score(spark, d):
    p = _pred(planted.faces(spark, d))
    b = p.select("event_id", (F.col("photo_id") - 2).alias("photo_id"), F.col("item").alias("b"), F.col("truth").alias("tb"))
    two = p.join(b, ["event_id", "photo_id"]).select("event_id", F.col("item").alias("a"), "b", (F.col("truth") == F.col("tb")).alias("same"))
    return scoring.judged_score(two.where("same"), two.where("not same"), p.select("event_id", "item", "pred"))


EVENT_CENT = CENT.replace("label, i", "event_id, label, i").replace("SELECT label, list", "SELECT event_id, label, list").replace("GROUP BY label)", "GROUP BY event_id, label)")


@query(
    f"""WITH {HARD}, {EVENT_CENT}, cover AS (SELECT event_id, label, arg_max(face_id, quality * 1e6 - vec_id / 1e6) AS cover FROM faces GROUP BY 1, 2),
g AS (SELECT * FROM units JOIN cover USING (event_id, label)), p AS (SELECT a.event_id, a.label AS a, b.label AS b, a.cover AS face_a, b.cover AS face_b, round(1 - {DOT}(a.c, b.c), 6) AS gap FROM g a JOIN g b ON a.event_id = b.event_id AND a.label < b.label)
SELECT *, CASE WHEN gap <= 0.8 THEN 'same?' ELSE 'different?' END AS verdict FROM p WHERE gap BETWEEN 0.6000000000000001 AND 0.95 ORDER BY gap, event_id, a, b LIMIT 40"""
)
def review_candidates(spark, d):
    f = planted.faces(spark, d, 1.25)
    t = cluster.person_table(f, f.select("event_id", "face_id", F.col("label").alias("person_id")))
    return scoring.candidates(t, 0.8)


@query(f"WITH {FACES} SELECT label, 'grp:' || substr(sha1(string_agg(face_id, '|' ORDER BY face_id)), 1, 16) AS group_key FROM faces GROUP BY label")
def content_keys(spark, d):
    return planted.faces(spark, d).groupBy("label").agg(content_key(F.collect_list("face_id")).alias("group_key"))


@query(
    """WITH s(k, p1, p2, m, sc, sp, auto) AS (VALUES (0, 0.42, 0.55, 3, 0.38, 1, 1), (1, 0.5, 0.6123, 2, 0.3, 0, 1), (2, 0.00005, 1.0, 10, 0.38001, 1, 0))
SELECT k, printf('p1=%.4f:p2=%.4f:min=%d:sc=%.4f:sp=%d:auto=%d', p1::DOUBLE, p2::DOUBLE, m, sc::DOUBLE, sp, auto) AS signature FROM s"""
)
def signature_text(spark, d):
    """Of settings as the environment gives them."""
    given = [
        {}, {"PASS1_THRESHOLD": "0.5", "PASS2_THRESHOLD": "0.6123", "MIN_FACES_PER_PERSON": "2", "SECOND_CLASS_ASSIGN": "0.3", "SAME_PHOTO_RULE": "off"},
        {"PASS1_THRESHOLD": "0.00005", "PASS2_THRESHOLD": "1", "MIN_FACES_PER_PERSON": "10", "SECOND_CLASS_ASSIGN": "0.38001", "SECOND_CLASS_AUTO": "0", "SAME_PHOTO_RULE": " "},
    ]
    rows = [(k, Settings.from_env(env={f"KINLOOM_{n}": v for n, v in g.items()}).signature()) for k, g in enumerate(given)]
    return spark.createDataFrame(rows, "k int, signature string")


@query(f"WITH {FACES}, r AS (SELECT event_id, label, face_id, quality, row_number() OVER (PARTITION BY event_id, label ORDER BY quality DESC, face_id) AS k FROM faces) SELECT event_id, label, k::INT AS k, face_id, quality FROM r WHERE k <= 60")
def person_top_faces(spark, d):
    from ..operators.review import top_faces

    return top_faces(planted.faces(spark, d), ["event_id", "label"], 60)


@query(
    f"""WITH {FACES}, {PRED}, {CELL}, g AS (SELECT event_id, pred, sum(n)::BIGINT AS size, count(*) > 1 AS mixed, pred % 3 = 0 AS approved FROM cell GROUP BY 1, 2)
SELECT event_id, pred, size, mixed, approved, (row_number() OVER (PARTITION BY event_id ORDER BY mixed DESC, approved, size DESC, pred))::INT AS place FROM g"""
)
def review_order(spark, d):
    from ..operators.review import review_order as order

    p = _pred(planted.faces(spark, d)).where("pred is not null").groupBy("event_id", "pred").agg(F.count("*").alias("size"), (F.countDistinct("truth") > 1).alias("mixed"))
    return order(p.withColumn("approved", F.col("pred") % 3 == 0))


@query(f"WITH {FACES} SELECT face_id, round(100.0 * width / 800, 3) AS left_pct, round(100.0 * height / 600, 3) AS height_pct FROM faces WHERE photo_id % 5 <> 0")
def bbox_percent(spark, d):
    from ..operators.review import box_percent

    f = planted.faces(spark, d)
    photos = f.select("event_id", "photo_id").distinct().withColumn("width", F.when(F.col("photo_id") % 5 == 0, 0).otherwise(800)).withColumn("height", F.lit(600))
    boxes = f.select("face_id", "event_id", "photo_id", F.col("width").alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("w"), F.col("height").cast("double").alias("h"))
    return box_percent(boxes, photos).select("face_id", F.col("x_pct").alias("left_pct"), F.col("h_pct").alias("height_pct"))


@query(f"WITH {FACES} SELECT label, face_id, photo_id FROM faces WHERE label = 3 ORDER BY photo_id, face_id LIMIT 20 OFFSET 20")
def person_photos_page(spark, d):
    from ..operators.review import page

    return page(planted.faces(spark, d).where("label = 3").select("label", "face_id", "photo_id"), ["photo_id", "face_id"], number=2, per=20)


PROBE = "probe AS (SELECT vec_id AS q, x AS qx FROM faces WHERE vec_id % 50 = 0)"


@query(
    f"""WITH {FACES}, {CENT}, {PROBE}, t1 AS (SELECT q, label, 1 - {DOT}(qx, c) AS d, row_number() OVER (PARTITION BY q ORDER BY 1 - {DOT}(qx, c), label) AS k FROM probe CROSS JOIN units),
best AS (SELECT a.q, a.label, a.d, b.d - a.d AS margin FROM t1 a JOIN t1 b ON a.q = b.q AND a.k = 1 AND b.k = 2)
SELECT q, CASE WHEN d < 0.55 AND margin >= 0.05 THEN label END AS person, round(d, 6) AS d, round(margin, 6) AS margin FROM best"""
)
def two_tier_search(spark, d):
    """Queries are the vectors whose id 50 divides, as stated."""
    from ..operators.search import nearest_persons

    f = planted.faces(spark, d)
    c = cluster.centroids(f.select("label", "x", "quality"), ["label"]).withColumnRenamed("label", "person")
    return nearest_persons(f.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("x").alias("qx")), c, 0.55, 0.05)


@query(f"WITH {FACES}, {PROBE}, n AS (SELECT q, face_id, 1 - {DOT}(qx, x) AS d FROM probe JOIN faces ON vec_id <> q), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(d, 6), face_id) AS k FROM n) SELECT q, face_id, round(d, 6) AS d FROM r WHERE k <= 10")
def face_search(spark, d):
    """The ten nearest faces of each query (every 50th vector), over all faces."""
    from ..operators.search import nearest_faces

    f = planted.faces(spark, d)
    return nearest_faces(f.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("x").alias("qx")), f, 10)


@query(
    f"""WITH {FACES}, h AS (SELECT face_id, vec_id, list_sum(list_transform(range(1, 33), lambda i: CASE WHEN x[i] > 0 THEN (1::BIGINT << (i - 1)) ELSE 0 END))::BIGINT AS phash FROM faces)
SELECT a.face_id, min(b.face_id) FILTER (a.phash = b.phash) AS class, count(*) - 1 AS links FROM h a JOIN h b ON bit_count(xor(a.phash, b.phash)) < 6 GROUP BY a.face_id"""
)
def near_dup_hashes(spark, d):
    """For every face the class of equal hashes it is in, and how many others are near."""
    from ..operators.search import hash_classes

    bits = [F.when(F.element_at("x", i) > 0, F.lit(1 << (i - 1))).otherwise(0).cast("long") for i in range(1, 33)]
    h = planted.faces(spark, d).select("face_id", sum(bits[1:], bits[0]).alias("phash"))
    return hash_classes(h, "face_id", "phash", below=6, bits=32).withColumnRenamed("id", "face_id")


# What reviewers called different, made up from ids, on the assignments above.
DIFFERENT = "diff AS (SELECT a.item AS a, b.item AS b FROM pred a JOIN pred b ON a.event_id = b.event_id AND a.photo_id + 2 = b.photo_id AND a.truth <> b.truth)"


def _different(p):
    b = p.select("event_id", (F.col("photo_id") - 2).alias("photo_id"), F.col("item").alias("b"), F.col("truth").alias("tb"))
    return p.join(b, ["event_id", "photo_id"]).where("truth <> tb").select(F.col("item").alias("a"), "b")


@query(
    f"""WITH {FACES}, {PRED}, {DIFFERENT}, named AS (SELECT item, 'T' || truth AS label, pred FROM pred WHERE photo_id % 3 <> 0), support AS (SELECT label, pred, count(*) AS n FROM named GROUP BY 1, 2),
two AS (SELECT a, b, x.pred, coalesce(sa.n, 0) AS na, coalesce(sb.n, 0) AS nb FROM diff JOIN pred x ON x.item = a JOIN pred y ON y.item = b AND y.pred = x.pred LEFT JOIN named la ON la.item = a LEFT JOIN named lb ON lb.item = b
  LEFT JOIN support sa ON sa.label = la.label AND sa.pred = x.pred LEFT JOIN support sb ON sb.label = lb.label AND sb.pred = x.pred)
SELECT a, b, pred, CASE WHEN na <= nb THEN a ELSE b END AS face FROM two"""
)
def wrong_faces(spark, d):
    p = _pred(planted.faces(spark, d))
    labels = p.where("photo_id % 3 <> 0").select("item", F.concat(F.lit("T"), F.col("truth").cast("string")).alias("label"))
    return scoring.blamed(_different(p), p.select("item", "pred"), labels)


@query(f"WITH {FACES}, {PRED}, {DIFFERENT} SELECT a, b, x.pred FROM diff JOIN pred x ON x.item = a JOIN pred y ON y.item = b AND y.pred = x.pred ORDER BY a, b LIMIT 20")
def merged_examples(spark, d):
    p = _pred(planted.faces(spark, d))
    return scoring.merged_examples(_different(p), p.select("item", "pred"))


@query(f"WITH {FACES} SELECT count_if(height < 112) AS risky, count(*) AS faces, floor(count_if(height < 112) / count(*) * 100 + 0.5)::INT AS pct FROM faces")
def risky_faces(spark, d):
    from ..operators.sentences import risky_share

    return risky_share(planted.faces(spark, d))

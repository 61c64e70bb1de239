"""Clustering and thresholds on vectors at known distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.config import Settings
from kinloom.operators import blocks, cluster, graph, linkage, scoring, thresholds


def unit(x):
    return x / np.linalg.norm(x)


def around(base, n, spread, seed):
    """n unit vectors at distance 1 - 1/sqrt(1 + spread^2) from base."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        v = rng.normal(size=len(base))
        v -= base * (v @ base)
        out.append(unit(base + spread * unit(v)))
    return np.array(out)


def bases(n, dim=64):
    return np.linalg.qr(np.random.default_rng(1).normal(size=(dim, n)))[0].T


def naive_linkage(x, threshold):
    groups = [[i] for i in range(len(x))]
    d = 1 - x @ x.T
    while len(groups) > 1:
        best = min((np.mean([d[i, j] for i in a for j in b]), p, q) for p, a in enumerate(groups) for q, b in enumerate(groups) if p < q)
        if best[0] >= threshold:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("seed", range(6))
def test_linkage_equals_the_plain_version(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([around(b, rng.integers(2, 9), rng.uniform(0.3, 1.4), seed) for b in bases(6)])
    labels = cluster.average_linkage(x, 0.42)
    assert {frozenset(np.flatnonzero(labels == g).tolist()) for g in set(labels)} == naive_linkage(x, 0.42)


@pytest.mark.parametrize("seed", range(4))
def test_linkage_from_means_equals_the_plain_version(seed, monkeypatch):
    """With all distances held of 4 clusters at most; loose people, some vectors twice."""
    monkeypatch.setattr(linkage, "HELD", 4)
    x = np.vstack([around(b, 12, s, seed * 10 + i) for i, (b, s) in enumerate(zip(bases(4), (0.3, 0.9, 1.1, 1.3)))])
    x = np.vstack([x, x[::9]])
    labels = cluster.average_linkage(x, 0.42)
    assert {frozenset(np.flatnonzero(labels == g).tolist()) for g in set(labels)} == naive_linkage(x, 0.42)


@pytest.mark.parametrize("spread", [0.3, 1.1])
def test_linkage_takes_memory_in_proportion(spread):
    import tracemalloc

    x = around(bases(1, 16)[0], 6000, spread, 1)
    tracemalloc.start()
    labels = cluster.average_linkage(x, 0.42)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(labels) == 6000 and peak < 80e6  # all distances are 288 MB


def test_linkage_of_one_and_none():
    assert cluster.average_linkage(bases(1), 0.4).tolist() == [0] and cluster.average_linkage(np.zeros((0, 4)), 0.4).tolist() == []


def test_threshold_is_strict():
    x = np.array([[1.0, 0.0], [0.5, np.sqrt(0.75)]])
    assert len(set(cluster.average_linkage(x, 1 - float(x[0] @ x[1])))) == 2 and len(set(cluster.average_linkage(x, 0.51))) == 1


def frame(spark, people, height=200):
    """people: list of (vectors, photos)."""
    rows, k = [], 0
    for person, (x, photos) in enumerate(people):
        for v, p in zip(x, photos):
            rows.append((0, f"{p:06d}_{person:02d}{k:03d}", int(p), k, person, [float(c) for c in v], 0.5 + (k % 10) / 20, height))
            k += 1
    return spark.createDataFrame(rows, "event_id long, face_id string, photo_id long, vec_id long, label long, x array<double>, quality double, height int")


def test_no_person_has_two_faces_of_a_photo(spark):
    b = unit(bases(2)[0] + 0.35 * bases(2)[1])  # two people so close that only the rule keeps them apart
    f = frame(spark, [(around(bases(2)[0], 6, 0.2, 1), range(6)), (around(b, 6, 0.2, 2), range(6))])
    free = cluster.identities(f, Settings(same_photo_rule=False)).join(f.select("face_id", "photo_id"), "face_id")
    assert free.groupBy("person_id", "photo_id").count().agg(F.max("count")).first()[0] == 2  # the data really tests the rule
    got = cluster.identities(f).join(f.select("face_id", "photo_id"), "face_id")
    assert got.where("person_id is not null").groupBy("person_id", "photo_id").count().agg(F.max("count")).first()[0] == 1
    assert got.count() == f.count() and got.select("face_id").distinct().count() == f.count()


def test_repartitioning_and_repeats_change_nothing(spark):
    f = frame(spark, [(around(b, 7, 0.8, i), range(7 * (i % 2), 7 * (i % 2) + 7)) for i, b in enumerate(bases(5))])
    first = sorted(map(tuple, cluster.identities(f).collect()))
    assert first == sorted(map(tuple, cluster.identities(f.repartition(5)).collect())) == sorted(map(tuple, cluster.identities(f.orderBy(F.col("face_id").desc())).collect()))


def test_small_faces_never_found_a_person(spark):
    small = frame(spark, [(around(bases(2)[0], 5, 0.1, 1), range(5))], height=60)
    assert {r.person_id for r in cluster.identities(small).collect()} == {None}


def test_blocks_only_split(spark):
    f = frame(spark, [(around(b, 30, 0.3, i), range(30)) for i, b in enumerate(bases(4))])
    cells = cluster.blocked(f, limit=50)
    assert cells.count() == f.count() and cells.groupBy("block").count().agg(F.max("count")).first()[0] <= 50
    labelled = cluster.pass1(cells.drop("block")).join(f.select("face_id", "label"), "face_id")
    assert labelled.groupBy("group").agg(F.countDistinct("label").alias("n")).agg(F.max("n")).first()[0] == 1
    small = cluster.blocked(f, limit=7)
    assert small.groupBy("block").count().agg(F.max("count")).first()[0] <= 7 and small.count() == f.count()


def test_blocks_of_faces_that_are_alike(spark):
    """K-means can't part equal vectors; no cell is left too large, and no face is lost."""
    f = frame(spark, [(np.repeat(bases(1), 60, axis=0), range(60))])
    f = f.unionByName(f.withColumn("event_id", F.lit(None).cast(f.schema["event_id"].dataType)))
    cells = cluster.blocked(f, limit=20)
    assert cells.count() == 120 and cells.groupBy("event_id", "block").count().agg(F.max("count")).first()[0] <= 20


def groups_of(rows):
    return {(r.event_id, r.face_id): r.group for r in rows.collect()}


def test_a_large_event_is_linked_as_a_whole(spark):
    """12,300 faces of one person, three of each vector, are one group, beside an event that is small."""
    x = np.repeat(around(bases(1, 8)[0], 4100, 0.3, 1), 3, axis=0)
    f = frame(spark, [(x, range(len(x)))]).unionByName(frame(spark, [(x[:5], range(5))]).withColumn("event_id", F.lit(1).cast("long")))
    got = groups_of(cluster.pass1(f))
    assert len(got) == 12_305 and {event: g for (event, _), g in got.items()} == {0: "000000_00000", 1: "000000_00000"} and len(set(got.values())) == 1


@pytest.mark.parametrize("rule", [True, False])
def test_linkage_by_parts_and_rounds_equals_one_matrix(spark, rule):
    """Loose people that touch, single faces, copies, and photos that come twice; a limit of 12 needs rounds, one of 100 parts only."""
    rng = np.random.default_rng(8)
    people = [(around(b, 40, s, i), rng.permutation(60)[:40]) for i, (b, s) in enumerate(zip(bases(6), (0.3, 0.6, 0.9, 1.1, 1.3, 0.9)))]
    people += [(np.repeat(bases(7)[6:], 30, axis=0), range(30)), (around(unit(bases(1)[0] + 0.5 * bases(2)[1]), 20, 0.5, 9), rng.integers(0, 9, 20))]
    f = frame(spark, people)
    f = f.unionByName(f.where("label < 3").withColumn("event_id", F.lit(None).cast("long")))
    settings = Settings(same_photo_rule=rule)
    whole = groups_of(cluster.pass1(f, settings))
    assert len(whole) == f.count() and 20 < len(set(whole.values())) < 250
    for limit in (12, 100):
        assert groups_of(cluster.pass1(f.repartition(3), settings, limit=limit)) == whole


def test_nearest_and_forest_equal_all_distances():
    rng = np.random.default_rng(2)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.normal(size=(1500, 6)), rng.normal(size=(1100, 6))))
    d, own = 1 - x @ y.T, 1 - x @ x.T
    np.fill_diagonal(own, np.inf)
    to_y, dx, to_x, dy = linkage.nearest(x, y)
    assert (to_y == d.argmin(1)).all() and (to_x == d.argmin(0)).all() and np.allclose(dx, d.min(1)) and np.allclose(dy, d.min(0))
    assert (linkage.nearest(x)[0] == own.argmin(1)).all() and np.allclose(linkage.nearest(x)[1], own.min(1))
    for below in (0.005, 0.02, 0.1):
        part = np.arange(len(x) + len(y))
        for i, j in zip(*np.nonzero(d < below)):
            part[part == part[len(x) + j]] = part[i]
        a, b = linkage.forest(x, y, below)
        assert len(a) == len(part) - len(set(part)) and (d[a, b] < below).all()  # as few as can be, and none that joins nothing


def naive_split(x, photo, quality, threshold):
    buckets = []
    for k in sorted(range(len(x)), key=lambda k: (-quality[k], k)):
        free = [b for b in buckets if photo[k] not in b["photos"]]
        d = [1 - x[k] @ b["sum"] / np.linalg.norm(b["sum"]) for b in free]
        if d and min(d) < threshold:
            b = free[int(np.argmin(d))]
        else:
            buckets.append(b := {"photos": set(), "sum": np.zeros(x.shape[1]), "rows": []})
        b["photos"].add(photo[k])
        b["sum"] = b["sum"] + (0.5 + quality[k]) * x[k]
        b["rows"].append(k)
    return [sorted(b["rows"]) for b in buckets]


def test_a_large_event_is_split_as_a_whole(spark):
    """12,300 faces of one person, two in a photo or three: no cell comes between those that belong together."""
    x = around(bases(1, 8)[0], 4100, 0.3, 1)[np.arange(12_300) % 4100]
    f = frame(spark, [(x, np.arange(12_300) // 2 % 5000)])
    rows = sorted((r.face_id, r.photo_id, r.quality, r.x) for r in f.collect())
    face, photo, quality, vectors = zip(*rows)
    expected = {(0, face[k]): face[part[0]] for part in naive_split(np.array(vectors), photo, quality, 0.42) for k in part}
    assert len(set(expected.values())) > 1 and groups_of(cluster.pass1(f)) == expected


def test_splitting_takes_memory_in_proportion(spark):
    import tracemalloc

    x, quality = around(bases(1, 4)[0], 20_000, 0.3, 1), np.arange(20_000) % 7 / 7
    tracemalloc.start()
    parts = cluster.split_conflicts(x, np.maximum(np.arange(20_000), 1), quality, 0.42)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(parts) == 2 and sum(map(len, parts)) == 20_000 and peak < 50e6


def test_faces_without_an_event(spark):
    f = frame(spark, [(around(bases(2)[0], 6, 0.1, 1), range(6)), (around(bases(2)[1], 5, 0.1, 2), range(5))])
    none = f.withColumn("event_id", F.lit(None).cast(f.schema["event_id"].dataType)).withColumn("face_id", F.concat(F.lit("9"), "face_id"))
    got = cluster.identities(f.unionByName(none)).collect()
    assert len(got) == 22 and sorted(r.person_id for r in got if r.event_id is None) == sorted(r.person_id for r in got if r.event_id is not None) == [0] * 6 + [1] * 5


def test_the_second_face_of_a_photo_is_left_over(spark):
    """As in `leftovers` at size: equal vectors, two of them in one photo; the worse of the two belongs to no one, nor does a small face of a photo that is taken."""
    x = np.repeat(bases(1), 6, axis=0)
    f = frame(spark, [(x, [0, 1, 2, 3, 3, 2])]).withColumn("height", F.when(F.col("face_id").endswith("5"), 60).otherwise(200))
    f = f.withColumn("quality", F.substring("face_id", -1, 1).cast("double") / 10)
    got = {r.face_id[-1]: r.person_id for r in cluster.identities(f).collect()}
    assert got == {"0": 0, "1": 0, "2": 0, "3": None, "4": 0, "5": None}


def test_a_line_for_each_event(spark):
    f = frame(spark, [(around(bases(1)[0], 12, 0.9, 1), range(12))])
    kind = f.schema["event_id"].dataType
    f = f.withColumn("event_id", F.lit(1).cast(kind)).unionByName(f.withColumn("event_id", F.lit(2).cast(kind)))
    lines = spark.createDataFrame([(1, 0.0), (2, 1.9)], "event_id int, line double").withColumn("event_id", F.col("event_id").cast(kind))
    roots = {r.event_id: r.n for r in cluster.pass2(f, cluster.pass1(f, Settings(pass1_threshold=0.05)), line=lines).groupBy("event_id").agg(F.countDistinct("root").alias("n")).collect()}
    assert roots[1] > 1 and roots[2] == 1


def test_exact_quantiles(spark):
    rng = np.random.default_rng(4)
    v = {"a": rng.uniform(0.2, 1.2, 5000), "b": rng.uniform(0, 2, 7), "c": np.array([0.5]), "d": np.repeat([0.1, 0.9, 5.0], 50)}
    rows = spark.createDataFrame([(k, float(x)) for k, xs in v.items() for x in xs] + [("a", None)], "k string, x double")
    for q in (0.01, 0.5, 0.999):
        got = {r.k: r.quantile for r in blocks.quantile(rows, ["k"], "x", q).collect()}
        assert all(np.isclose(got[k], np.quantile(xs, q)) for k, xs in v.items()) and len(got) == 4


def test_close_pairs_in_chunks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = spark.createDataFrame([(k % 2, f"g{k:03d}", v.tolist(), 0.5) for k, v in enumerate(x)], "event_id long, `group` string, centroid array<double>, line double")
    expected = {(f"g{a:03d}", f"g{b:03d}") for a in range(300) for b in range(a + 1, 300) if a % 2 == b % 2 and 1 - x[a] @ x[b] < 0.5}
    for size in (16, 2048):
        chunked = blocks.within
        blocks.within = lambda *a, size=size, **k: chunked(*a, **(k | {"size": size}))
        try:
            got = [(r.a, r.b) for r in cluster.close_pairs(g).collect()]
        finally:
            blocks.within = chunked
        assert len(got) == len(expected) and set(got) == expected


def test_blame(spark):
    pred = spark.createDataFrame([(f, 0) for f in "abcdef"] + [("x", 1)], "item string, pred long")
    labels = spark.createDataFrame([("a", "T1"), ("b", "T1"), ("c", "T2"), ("d", None)], "item string, label string")
    pairs = spark.createDataFrame([("a", "c"), ("c", "a"), ("a", "e"), ("e", "f"), ("a", "x")], "a string, b string")
    got = {(r.a, r.b): r.face for r in scoring.blamed(pairs, pred, labels).collect()}
    assert got == {("a", "c"): "c", ("c", "a"): "c", ("a", "e"): "e", ("e", "f"): "e"}
    assert [tuple(r) for r in scoring.merged_examples(pairs, pred, 2).collect()] == [("a", "c", 0), ("a", "e", 0)]


def test_centroids_are_unit(spark):
    f = frame(spark, [(around(bases(1)[0], 4, 0.5, 1), range(4))])
    c = np.array(cluster.centroids(f.select("label", "x", "quality"), ["label"]).first().centroid)
    assert abs(np.linalg.norm(c) - 1) < 1e-9
    x, q = np.array([r.x for r in f.collect()]), np.array([r.quality for r in f.collect()])
    assert np.allclose(c, cluster.weighted_centroid(x, q))


def line_of(spark, d, judged=None):
    pairs = spark.createDataFrame([(0, float(v)) for v in d], "event_id long, d double")
    return thresholds.merge_line(pairs, judged).first()


def test_merge_line(spark):
    calibration = [0.36, 0.39, 0.41, 0.45, 0.56, *np.linspace(0.667, 0.95, 495)]
    got = line_of(spark, calibration)
    assert got.basis == "measured" and got.line == pytest.approx(0.55, abs=0.01) and got.line < got.closest
    polluted = line_of(spark, [*np.linspace(0.61, 0.95, 500), *[0.02] * 25])
    assert polluted.duplicates == 25 and polluted.line == line_of(spark, np.linspace(0.61, 0.95, 500)).line
    assert line_of(spark, [0.9] * 12).basis == "default" and line_of(spark, [0.9] * 12).line == 0.55
    assert line_of(spark, [0.95] * 500).line == 0.62 and line_of(spark, [0.30] * 500).line == 0.40
    judged = spark.createDataFrame([(0, 0.5)] * 20, "event_id long, d double")
    assert line_of(spark, [0.9] * 500, judged).basis == "judged"


def test_small_face_line(spark):
    of = lambda d: thresholds.small_face_line(spark.createDataFrame([(0, float(v)) for v in d], "event_id long, d double")).first()
    assert of([0.7] * 50 + [0.75] * 100 + [0.8] * 100).line == pytest.approx(0.52, abs=0.01)
    assert of([0.3] * 200).line == 0.30 and of([0.95] * 200).line == 0.55 and of([0.5] * 99).basis == "default"


def test_pair_budget_keeps_whole_photos(spark):
    f = frame(spark, [(bases(6)[[i] * 4], range(4)) for i in range(6)])
    assert thresholds.same_photo_pairs(f, None).count() == 60
    assert thresholds.same_photo_pairs(f, 20).count() == 30  # the second photo starts within the budget and counts in full


def test_truth_of_claims(spark):
    claims = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("x", "y")], "a string, b string")
    out = {r.node: r.label for r in graph.truth(claims, spark.createDataFrame([("b",), ("y",)], "node string")).collect()}
    assert out == {"a": "T1", "c": "T1", "d": "T2", "e": "T2"}  # b is left out but still passes claims on
    diff = spark.createDataFrame([("c", "a"), ("a", "d")], "a string, b string")
    assert [tuple(r) for r in graph.contradictions(graph.components(claims), diff).collect()] == [("a", "c")]


def test_chains_close(spark):
    chain = spark.range(60).selectExpr("id AS a", "id + 1 AS b")
    assert {tuple(r) for r in graph.components(chain).collect()} == {(i, 0) for i in range(61)}


def test_pairwise_without_claims_is_precise(spark):
    one = spark.createDataFrame([(0, "a", None, 1), (0, "b", None, 1)], "event_id long, item string, pred long, truth long")
    assert tuple(scoring.pairwise(one).first()) == (0, 1.0, 0.0, 0.0)

"""Journals, readers, text, geometry, streams and the vision interface."""

import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kinloom.config import Settings
from kinloom.functions import geometry, text, timefmt, vector
from kinloom.operators import journal, vision
from kinloom.sources import legacy, listing, tables
from kinloom.streaming import streams


def test_torn_lines_are_skipped(spark, tmp_path):
    (tmp_path / "state.jsonl").write_text('{"photo_id":"000001","status":"done","batch":1,"new_key":3}\n\n{"photo_id":"000002","status":"failed","error":"x"}\n{"photo_id":"0000')
    got = tables.read_journal(spark, str(tmp_path / "state.jsonl"), tables.STATE)
    assert sorted((r.photo_id, r.status, r.batch) for r in got.collect()) == [("000001", "done", 1), ("000002", "failed", None)]
    kept = tables.read_journal(spark, str(tmp_path / "state.jsonl"), tables.STATE, keep_broken=True)
    assert [r.broken for r in kept.collect() if r.broken] == ['{"photo_id":"0000']


def test_uncommitted_attempts_are_ignored(spark):
    faces = spark.createDataFrame([("1", 1, "1_00", 1), ("1", 2, "1_00", 3), ("2", 1, "2_00", 5), ("3", 7, "3_00", 6)], "photo_id string, batch long, face_id string, line_no long")
    state = spark.createDataFrame([("1", 1, "failed", 2), ("1", 2, "done", 4), ("3", 7, "done", 7), ("3", None, "failed", 8)], "photo_id string, batch long, status string, line_no long")
    assert [(r.face_id, r.batch) for r in journal.committed(faces, state).collect()] == [("1_00", 2)]


def test_pending_can_retry(spark):
    m = spark.createDataFrame([("a",), ("b",), ("c",)], "photo_id string")
    log = spark.createDataFrame([("a", "done"), ("b", "failed")], "photo_id string, status string")
    assert [r[0] for r in journal.pending(m, log, "photo_id").collect()] == ["c"]
    assert sorted(r[0] for r in journal.pending(m, log, "photo_id", retry=log.where("status = 'failed'")).collect()) == ["b", "c"]


def test_retractions(spark):
    j = spark.createDataFrame([("r1", None, False), ("r2", None, None), ("r3", "r1", True)], "record_id string, subject string, retracted boolean")
    assert [r.record_id for r in journal.live(j).collect()] == ["r2"]


def test_faces_round_trip_and_replace_one_event(spark, tmp_path):
    path = str(tmp_path / "faces")
    make = lambda e, v: spark.sql(f"select '{e}' event_id, 'f' face_id, true accepted, '{v}' embedding_model_version")
    tables.write_faces(make("a", "v1").union(make("b", "v1")), path)
    tables.write_faces(make("b", "v2"), path)
    assert {(r.event_id, r.embedding_model_version) for r in tables.read_faces(spark, path).collect()} == {("a", "v1"), ("b", "v2")}
    plan = tables.read_faces(spark, path, "v2")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(embeddi" in plan


def test_upsert(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, name string, who string")
    c = spark.createDataFrame([(1, None, "z"), (2, "", None), (3, "n", None)], "k long, name string, who string")
    assert sorted(map(tuple, tables.upsert(t, c, "k").collect())) == [(1, "a", "z"), (2, None, "y"), (3, "n", None)]


def test_document_defaults(spark, tmp_path):
    (tmp_path / "label.json").write_text("{ not json")
    assert tables.read_document(spark, str(tmp_path / "label.json"), "display_name string", {"display_name": "?"}).first().display_name == "?"


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    tables.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    tables.write_ndjson(rows.coalesce(1), str(tmp_path / "n"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "n")).collect()] == [{"k": 1, "v": "a"}, {"k": 2}]
    tables.append_journal(rows, str(tmp_path / "j"))
    tables.append_journal(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4


def test_older_embedding_files(spark, tmp_path):
    x = np.arange(12, dtype="<f4").reshape(3, 4)
    (tmp_path / "e.f32").write_bytes(x.tobytes() + b"torn")
    got = legacy.read_raw_rows(spark, str(tmp_path / "e.f32"), 4).orderBy("row").collect()
    assert [r.embedding for r in got] == x.tolist()
    assert legacy.align(900) == 1148 and legacy.align(4096) == 0
    half = pa.array([[0.5, 1.5], []], pa.list_(pa.float16()))
    pq.write_table(pa.table({"face_id": ["a", "b"], "embedding": half}), tmp_path / "h.parquet")
    assert {r.id: r.embedding for r in legacy.read_half_precision(spark, str(tmp_path / "h.parquet")).collect()} == {"a": [0.5, 1.5], "b": []}


def test_folder_scan(spark, tmp_path):
    for p in ("b/2.JPG", "a/10.jpg", "a/clip.mov", "0.png", "a b/x.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(b"12")
    (tmp_path / "a" / "deep").mkdir()
    (tmp_path / "a" / "deep" / "empty.srw").write_bytes(b"")
    (tmp_path / "a" / ".jpg").write_bytes(b"1")
    files = listing.scan_folder(spark, str(tmp_path))
    assert {(r.path, r.sub_album, r.kind, r.size) for r in files.collect()} == {
        ("0.png", "", "image", 2), ("a/10.jpg", "a", "image", 2), ("a/clip.mov", "a", "video", 2), ("a b/x.txt", "a b", "other", 2), ("b/2.JPG", "b", "image", 2), ("a/deep/empty.srw", "deep", "raw", 0), ("a/.jpg", "a", "other", 1)
    }
    assert [(r.path, r.photo_id) for r in listing.manifest(files).orderBy("photo_id").collect()] == [("0.png", "000000"), ("a/10.jpg", "000001"), ("b/2.JPG", "000002")]
    assert listing.scan_stats(files).first().asDict() == {"n_image": 3, "n_raw": 1, "n_video": 1, "n_other": 2, "bytes": 11}
    assert {r.album: r.n for r in listing.album_counts(files).collect()} == {"(root)": 1, "a": 1, "b": 1}


@pytest.mark.parametrize("seconds, shown", [(None, "not recorded"), (0, "not recorded"), (0.3, "under 1s"), (5, "5s"), (65, "1m 05s"), (2.5, "2s"), (3.5, "4s"), (60.5, "1m 00s"), (59.5, "1m 00s"), (1932, "32m 12s"), (4027, "1h 07m")])
def test_durations(spark, seconds, shown):
    assert spark.range(1).select(timefmt.duration_text(F.lit(seconds).cast("double"))).first()[0] == shown


def test_forecast(spark):
    assert spark.range(1).select(timefmt.forecast_text(timefmt.forecast_seconds(F.lit(5000), F.lit(2.27)))).first()[0] == "3h 09m"
    shown = lambda s: spark.range(1).select(timefmt.forecast_text(F.lit(s).cast("double"))).first()[0]
    assert [shown(s) for s in (0, 2.5, 59.5, 89.6, 90, 150, 3599)] == ["no time at all", "2 seconds", "1 min", "2 min", "2 min", "2 min", "1h 00m"]
    both = spark.createDataFrame([(59.9,), (90.0,), (3599.0,), (7290.0,), (None,)], "s double").select(timefmt.spent_text(F.col("s")).alias("a"), timefmt.left_text(F.col("s")).alias("b")).collect()
    assert [(r.a, r.b) for r in both] == [("59s", "59s"), ("1m", "2 min"), ("59m", "60 min"), ("2h 1m", "2h 2m"), (None, "0s")]


@pytest.mark.parametrize("x0, width, keep", [(5, 100, True), (-5, 100, True), (-30, 100, False), (-0.1, 0.5, True), (-0.2, 0.5, False)])
def test_boxes_past_a_tile_edge(spark, x0, width, keep):
    row = [(float(x0), 10.0, float(x0 + width), 50.0, 640, 0, 640, 640, 2000, 640)]
    box = spark.createDataFrame(row, "x0 double, y0 double, x1 double, y1 double, tx0 int, ty0 int, w int, h int, width int, height int")
    assert (geometry.on_photo(box).count() == 1) == keep
    assert geometry.on_photo(box.withColumn("tx0", F.lit(0))).count() == 1  # the edge of the photo


def test_faces_are_aligned():
    import numpy as np

    rng = np.random.default_rng(2)
    for scale in (1.0, 0.13):  # nearly as it is, and shrunk from a large picture
        size = int(130 / scale)
        y, x = np.mgrid[:size, :size]
        image = np.stack([x * 255 / size, y * 255 / size, rng.integers(0, 2, (size, size)) * 200], axis=2).astype(np.uint8)
        points = geometry.FACE_TEMPLATE / scale + 5 / scale
        face, found = geometry.aligned(image, points)
        assert face.shape == (112, 112, 3) and abs(found - scale) < 1e-6
        want = (np.arange(112) + 5) * 255 / 130
        assert np.abs(face[56, :, 0] - want).max() < 4 and np.abs(face[:, 56, 1] - want).max() < 4
        if scale < 0.5:
            assert abs(face[..., 2].mean() - 100) < 5 and face[..., 2].std() < 40  # noise is averaged, not picked
    assert geometry.aligned(image, np.zeros((5, 2))) == (None, 0.0)
    a = np.arange(6).reshape(2, 3)
    assert [geometry.upright(a, k).tolist() for k in range(1, 9)] == [[[0, 1, 2], [3, 4, 5]], [[2, 1, 0], [5, 4, 3]], [[5, 4, 3], [2, 1, 0]], [[3, 4, 5], [0, 1, 2]], [[0, 3], [1, 4], [2, 5]], [[3, 0], [4, 1], [5, 2]], [[5, 2], [4, 1], [3, 0]], [[2, 5], [1, 4], [0, 3]]]


def test_addresses(spark):
    rows = spark.createDataFrame([("r2://b/events/x",), ("/bare/path",), ("r2://b/../x",), ("s3://b",)], "u string")
    assert [r.ok for r in rows.select(text.uri_parts(F.col("u"))[3].alias("ok")).collect()] == [True, False, False, True]


def test_vectors(spark):
    r = spark.range(1).select(
        vector.cosine_distance_or_null(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("n"), vector.cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z"),
        vector.unit(F.array(F.lit(0.0), F.lit(0.0))).alias("u"), vector.guarded(F.array(F.lit(1.0)), 3).alias("g"),
    ).first()
    assert r.n is None and r.z == 1.0 and r.u == [0.0, 0.0] and r.g == [0.0, 0.0, 0.0]


def test_settings_from_the_environment():
    s = Settings.from_env(env={"KINLOOM_PASS2_THRESHOLD": "0.5", "KINLOOM_SAME_PHOTO_RULE": "off", "KINLOOM_MIN_FACE_PX": ""})
    assert (s.pass2_threshold, s.same_photo_rule, s.min_face_px) == (0.5, False, 50) and s.signature() != Settings().signature()


def test_tiles_cover_the_photo(spark):
    p = spark.createDataFrame([(1, 1600, 1200), (2, 6000, 4000), (3, 20000, 20000), (4, 1700, 1650)], "photo_id int, width int, height int")
    got = geometry.tile_grid(p, 2560.0).toPandas()
    assert set(got.photo_id) == {2, 3}
    for photo, (w, h) in {2: (6000, 4000), 3: (20000, 20000)}.items():
        t = got[got.photo_id == photo]
        assert (t.x0 + t.w).max() == w and (t.y0 + t.h).max() == h and t.x0.min() == 0 and (t.x0 >= 0).all()
        xs = sorted({(a, b) for a, b in zip(t.x0, t.x0 + t.w)})
        assert all(b >= c for (_, b), (c, _) in zip(xs, xs[1:]))


def test_suppression_drops_slivers(spark):
    b = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 100.0, 0.9), (1, 1, 0.0, 0.0, 100.0, 20.0, 0.8), (1, 2, 200.0, 0.0, 300.0, 100.0, 0.7), (2, 0, 0.0, 0.0, 100.0, 20.0, 0.5)], "photo_id long, box_id int, x0 double, y0 double, x1 double, y1 double, score double")
    assert sorted((r.photo_id, r.box_id) for r in geometry.suppress(b).collect()) == [(1, 0), (1, 2), (2, 0)]


def test_similarity_recovers_the_transform():
    src = np.array([[0, 0], [10, 0], [0, 10], [7, 3.0]])
    a = np.deg2rad(30)
    m = 1.7 * np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
    got = geometry.similarity(src, src @ m.T + [5, -2])
    assert np.allclose(got, np.hstack([m, [[5], [-2]]])) and np.isnan(geometry.similarity(np.ones((3, 2)), src[:3])).all()


def test_sharpness():
    assert geometry.laplacian_variance(np.full((8, 8), 9)) == 0 < geometry.laplacian_variance(np.random.default_rng(0).integers(0, 255, (8, 8)))


def test_vision_keeps_errors(spark):
    photos = spark.createDataFrame([("a", b"12"), ("b", b""), ("c", b"1")], "path string, content binary")

    def build():
        def detect(content):
            if not content:
                raise ValueError("empty")
            return [{"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "det_score": 0.9, "embedding": [1.0]} for _ in content]

        return detect

    got = vision.process(photos, build).collect()
    assert sorted((r.path, r.face_index, r.error) for r in got if r.error is None) == [("a", 0, None), ("a", 1, None), ("c", 0, None)]
    assert [r.path for r in got if r.error] == ["b"]


def test_stream_equals_batch_after_every_append(spark, tmp_path):
    folder, schema = str(tmp_path / "log"), "photo_id string, status string, line_no long"
    lines = [("1", "failed", 1), ("2", "done", 2), ("1", "done", 3), ("3", "failed", 4), ("2", "failed", 5)]
    for k, line in enumerate(lines):
        tables.append_journal(spark.createDataFrame([line], schema), folder)
        stream = streams.follow_journal(spark, folder, schema, files_per_batch=1)
        got = streams.progress(spark, stream, "photo_id", "status", "line_no").first()
        assert got == journal.progress(spark.createDataFrame(lines[: k + 1], schema), "photo_id", "status", "line_no").first()


def test_late_and_repeated_rows(spark, tmp_path):
    folder = str(tmp_path / "ev")
    for batch in ([("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 10:00:00")], [("b", "2024-01-02 00:00:00")], [("c", "2024-01-01 09:00:00"), ("b", "2024-01-02 00:00:00")], [("d", "2024-01-03 00:00:00")]):
        spark.createDataFrame(batch, "k string, t string").selectExpr("k", "cast(t as timestamp) ts").coalesce(1).write.mode("append").parquet(folder)
        import time

        time.sleep(1.1)  # files are taken by their time
    stream = streams.follow(spark, folder, "k string, ts timestamp", files_per_batch=1)
    assert sorted(r.k for r in streams.drain(streams.once(stream, ["k"], "ts"), "append").collect()) == ["a", "b", "d"]  # c comes too late


def test_claims_of_all_events_against_brute_force(spark):
    from collections import defaultdict

    from kinloom import catalog

    data = "/root/testdata/sf0.001"
    users = [r.user_id for r in spark.read.parquet(f"{data}/events.parquet").select("user_id").distinct().collect()]
    near = defaultdict(set)
    for a in users:
        b = (a * 7 + 3) % 150
        if a != b:
            near[a].add(b)
            near[b].add(a)
    comp = {}
    for start in sorted(near):
        queue = [start]
        while queue:
            x = queue.pop()
            if x not in comp:
                comp[x] = start
                queue += near[x]
    assert {r.node: r.component for r in catalog.QUERIES["components_same_group"](spark, data).collect()} == comp
    groups = defaultdict(list)
    for x, c in comp.items():
        if x % 11:
            groups[c].append(x)
    ranked = sorted((g for g in groups.values() if len(g) > 1), key=lambda g: (-len(g), min(g)))
    assert {r.node: r.label for r in catalog.QUERIES["truth_labels"](spark, data).collect()} == {x: f"T{k}" for k, g in enumerate(ranked, 1) for x in g}
    pairs = {(min(a, b), max(a, b)) for a in users for b in [(a * 3 + 1) % 150] if a in comp and comp[a] == comp.get(b)}
    assert {(r.a, r.b) for r in catalog.QUERIES["contradictions"](spark, data).collect()} == pairs


def test_names_of_whole_texts(spark, tmp_path):
    from kinloom import catalog

    texts = [(1, "\n" * 80 + "a  name"), (2, None), (3, "x" * 50), (4, "a\x00b\u200bc\u00a0d\te\u2028f"), (5, "y" * 39 + " z")]
    spark.createDataFrame([(i, t, "S", "en") for i, t in texts], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.name for r in catalog.QUERIES["names_and_slugs"](spark, str(tmp_path)).collect()} == {1: "a name", 2: "", 3: "x" * 40, 4: "abcd ef", 5: "y" * 39}

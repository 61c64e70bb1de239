"""Judgements, kept results, the report and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from kinloom import cli
from kinloom.operators import events, graph, judgements
from kinloom.operators.journal import live
from kinloom.sources import results, store, tables


def test_judgements_are_checked():
    good = judgements.judgement("SAME_PERSON", " ann ", faces=["0001_00", "0002_00", "0001_00"])
    assert good["same_group"] == ["0001_00", "0002_00"] and good["reviewer"] == "ann"
    for kind, more in (("NO", {}), ("SAME_PERSON", {"faces": ["0001_00"]}), ("DIFFERENT_PEOPLE", {"faces": ["0001_00"]}), ("FACE_WRONG", {}), ("PERSON_OK", {"faces": ["x"]}), ("NAME", {"label": " "}), ("NOTE", {})):
        with pytest.raises(judgements.BadJudgement):
            judgements.judgement(kind, "ann", **more)
    with pytest.raises(judgements.BadJudgement):
        judgements.judgement("NOTE", " ", text="x")


def test_a_wrong_face_takes_the_approval_back_but_keeps_its_claim(spark):
    ok = judgements.judgement("PERSON_OK", "ann", faces=["0001_00", "0002_00", "0003_00"], subject="grp:1")
    j = judgements.frame(spark, [ok])
    more = judgements.face_wrong(j, "0002_00", "grp:1", "bob")
    now = live(judgements.frame(spark, [ok, *more]))
    assert sorted(r.kind for r in now.collect()) == ["FACE_WRONG", "SAME_PERSON"]
    same, _, excluded = judgements.claims(judgements.frame(spark, [ok, *more]))
    assert {r.node for r in graph.truth(same, excluded).collect()} == {"0001_00", "0003_00"}
    assert [r.node for r in excluded.collect()] == ["0002_00"]


def test_judgements_survive_the_journal(spark, tmp_path):
    rows = [judgements.judgement("DIFFERENT_PEOPLE", "ann", faces=["0002_00", "0001_00"]), judgements.judgement("NOTE", "ann", text="é")]
    tables.append_journal(judgements.frame(spark, rows), str(tmp_path / "j"))
    back = tables.read_journal(spark, str(tmp_path / "j"), tables.FEEDBACK)
    assert [tuple(r) for r in judgements.claims(back)[1].collect()] == [("0001_00", "0002_00")]


def test_results_are_kept_by_signature(spark, tmp_path):
    path = str(tmp_path / "r")
    one = spark.sql("select 'a' event_id, 'f' face_id, 0 person_id")
    assert results.kept_result(spark, path, "s1") is None
    results.keep_result(one, path, "s1")
    results.keep_result(one.selectExpr("event_id", "face_id", "1 person_id"), path, "s2")
    assert results.kept_result(spark, path, "s1", "a").first().person_id == 0 and results.kept_result(spark, path, "s3") is None
    assert results.event_catalog(spark, path).count() == 1
    assert not results.keep_summary(one, str(tmp_path / "sum"), default_settings=False)


def face_table(spark, path):
    rows = []
    for person in range(2):
        for k in range(4):
            v = [0.0] * 4
            v[person] = 1.0
            v[2] = 0.05 * k
            rows.append(("ev", f"{k:06d}_{person:02d}", f"{k:06d}", True, "v1", v, 0.5 + 0.1 * k, 200.0))
    tables.write_faces(spark.createDataFrame(rows, "event_id string, face_id string, photo_id string, accepted boolean, embedding_model_version string, embedding array<float>, quality_score float, face_h_px float"), path)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jpg").write_bytes(b"1")
    assert cli.main(["manifest", str(tmp_path / "in"), str(tmp_path / "m")]) == 0
    assert [r.photo_id for r in spark.read.json(str(tmp_path / "m")).collect()] == ["000000"]
    assert cli.main(["verify", str(tmp_path / "in")]) == 0 and json.loads(capsys.readouterr().out.replace("'", '"'))["n_image"] == 1
    assert cli.main(["verify", str(tmp_path / "none")]) == 1
    face_table(spark, str(tmp_path / "faces"))
    assert cli.main(["cluster", str(tmp_path / "faces"), "v1", str(tmp_path / "r"), "--auto"]) == 0
    found = spark.read.parquet(str(tmp_path / "r"))
    assert found.groupBy("person_id").count().orderBy("person_id").collect() == [(0, 4), (1, 4)]
    assert cli.main(["report", str(tmp_path / "faces"), "v1", str(tmp_path / "r.html")]) == 0
    page = (tmp_path / "r.html" / "ev.html").read_text()
    assert "Person 2" in page and page.count("<li>") == 8 and "signature" in page


def test_caches(spark, tmp_path):
    made, dropped = [], []
    cache = results.Cache(3, dropped.append)
    get = lambda key, stamp: cache.get(key, stamp, lambda: made.append(key) or f"{key}{stamp}")
    assert get("a", 1) == get("a", 1) == "a1" and made == ["a"]
    assert get("a", 2) == "a2" and dropped == ["a1"]  # written again
    get("b", 1), get("c", 1)
    assert len(cache) == 3 and get("d", 1) == "d1" and len(cache) == 1 and sorted(dropped) == ["a1", "a2", "b1", "c1"]
    path = str(tmp_path / "faces")
    assert results.stamp(spark, path) is None
    face_table(spark, path)
    one = results.kept_table(spark, path, "v1")
    assert results.kept_table(spark, path, "v1") is one and one.count() == 8
    f = one.select("event_id", "face_id", "photo_id", F.col("embedding").cast("array<double>").alias("x"))
    assert results.kept_negatives(spark, path, f) is results.kept_negatives(spark, path, f) and results.kept_negatives(spark, path, f).count() == 4
    before = results.stamp(spark, path)
    tables.write_faces(spark.read.parquet(path).limit(3).cache(), path)
    assert results.stamp(spark, path) != before and results.kept_table(spark, path, "v1") is not one


def test_object_store(tmp_path):
    s = store.Store(f"file:{tmp_path}")
    s.put_text("r2://b/ev/1/a.json", "é")
    s.put_text("r2://b/ev/1/a.json", "ü")
    s.put_bytes("r2://b/ev/2/b c.bin", b"12")
    with s.open_append("r2://b/ev/2/log") as f:
        f.write(b"x\n")
    with s.open_append("r2://b/ev/2/log") as f:
        f.write(b"y\n")
    (tmp_path / "b" / "ev" / "2" / "half.partial").write_bytes(b"")
    assert s.get_text("r2://b/ev/1/a.json") == "ü" and s.get_bytes("r2://b/ev/2/log") == b"x\ny\n"
    assert list(s.list_keys("r2://b/ev/")) == ["r2://b/ev/1/a.json", "r2://b/ev/2/b c.bin", "r2://b/ev/2/log"] and list(s.list_keys("r2://b/ev/2/l")) == ["r2://b/ev/2/log"]
    assert list(s.list_prefixes("r2://b/ev/")) == ["1", "2"] and list(s.list_keys("r2://none/")) == []
    assert s.public_url("r2://b/ev/2/b c.bin", "r2://b/ev/1/a.json") == "../2/b%20c.bin"
    s.delete("r2://b/ev/2/log")
    s.delete("r2://b/ev/2/log")
    assert not s.exists("r2://b/ev/2/log") and s.exists("r2://b/ev/1/a.json")
    for bad in ("/bare", "r2://b/../x", "r2://b/a/../../x", "r2://"):
        with pytest.raises(store.BadAddress):
            s.get_bytes(bad)


def test_step_states_cover_all_phases(spark):
    jobs = spark.createDataFrame([(1, "processing", False, 40.0), (2, "clustering", True, 0.0), (3, "queued", False, 0.0), (4, "done", False, 0.0)], "job_id long, phase string, failed boolean, pct double")
    got = {}
    for r in events.step_states(jobs).orderBy("job_id", "step").collect():
        got.setdefault(r.job_id, []).append(r.state[0])
    assert {k: "".join(v) for k, v in got.items()} == {1: "dddntt", 2: "dddddf", 3: "tttttt", 4: "dddddd"}

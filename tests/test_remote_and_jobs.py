"""Remote listings, jobs, keyed state and sentences."""

import threading

import pytest
from pyspark.sql import functions as F

from kinloom.operators import sentences
from kinloom.sources import remote
from kinloom.streaming import jobs, state, streams


class Client:
    """Two pages in the root, a folder that contains its parent, and an online document."""

    def page(self, folder, token):
        if folder == "root" and token is None:
            return [{"id": "1", "name": "b.jpg", "size": 3, "kind": "file"}, {"id": "sub", "name": "album", "kind": "folder"}], "next"
        if folder == "root":
            return [{"id": "2", "name": "a.jpg", "size": None, "kind": "file"}, {"id": "3", "name": "notes", "kind": "document"}], None
        return [{"id": "root", "name": "up", "kind": "folder"}, {"id": "4", "name": "c.jpg", "size": 1, "kind": "file"}], None


def test_remote_listing(spark):
    got = remote.listing(spark, Client, ["root"]).orderBy("path").collect()
    assert [(r.source_id, r.path) for r in got] == [("2", "a.jpg"), ("4", "album/c.jpg"), ("1", "b.jpg")]


def test_retries():
    calls, pauses = [], []

    def flaky(error, times):
        calls.append(1)
        if len(calls) <= times:
            raise error
        return "ok"

    assert remote.tried(flaky, remote.RemoteError(503), 3, pause=pauses.append) == "ok" and pauses == [1.0, 2.0, 4.0]
    calls.clear()
    with pytest.raises(remote.RemoteError):
        remote.tried(flaky, remote.RemoteError(403, "not shared"), 1, pause=pauses.append)
    assert len(calls) == 1
    calls.clear()
    with pytest.raises(remote.RemoteError):
        remote.tried(flaky, remote.RemoteError(429), 99, pause=pauses.append)
    assert len(calls) == remote.ATTEMPTS


def test_error_texts(spark):
    rows = spark.createDataFrame([(403, "Rate Limit"), (403, None), (404, ""), (418, "")], "s int, r string")
    assert [r.t for r in rows.select(remote.error_text(F.col("s"), F.col("r")).alias("t")).collect()] == ["too many requests; try again in a while", "the folder is not shared", "the folder was not found", "unexpected answer 418"]


def test_jobs():
    ends, go = [], threading.Event()
    runner = jobs.Runner(lambda j: ends.append((j.job_id, j.phase)))

    def process(job):
        job.total = 3
        for now in (0.0, 1.0, 3.0):
            job.item(now)

    def fail(job):
        raise ValueError("no")

    def slow(job):
        go.wait(10)
        for _ in range(5):
            job.item()

    a = runner.submit("e1", {"manifest": lambda j: None, "processing": process})
    b = runner.submit("e1", {"checking": fail})
    c = runner.submit("e2", {"processing": slow})
    c.stop.set()
    go.set()
    runner.close()
    assert ends == [(0, "done"), (1, "failed"), (2, "stopped")] and a.history == ["queued", "manifest", "processing", "done"]
    assert a.pace == pytest.approx(0.7 * 1 + 0.3 * 2) and a.seconds_left == 0 and b.error == "ValueError: no"
    assert all(j.finished for j in runner.jobs) and runner.active("e1") is None
    with pytest.raises(ValueError):
        runner.submit("e", {"dancing": fail})


def test_status_changes(spark, tmp_path):
    folder, schema = str(tmp_path / "log"), "item string, status string, line_no long"
    import time

    for batch in ([("1", "failed", 1), ("2", "done", 2)], [("1", "done", 3)], [("1", "failed", 0), ("2", "done", 5)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    found = state.changes(streams.follow(spark, folder, schema, files_per_batch=1), "item", "status", "line_no")
    out = []
    query = found.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "s")).foreachBatch(lambda b, n: out.extend(map(tuple, b.collect()))).start()
    query.awaitTermination()
    assert sorted(out, key=repr) == [("1", "failed", "done"), ("1", None, "failed"), ("2", None, "done")]


def test_sentences(spark):
    row = spark.createDataFrame([(0.62, 0.81, 500, 3, "measured")], "line double, closest double, pairs long, duplicates long, basis string")
    text = row.select(sentences.merge_line_text()).first()[0]
    assert text.startswith("Line 0.62, measured on 500 pairs") and "3 pairs look like" in text and text.endswith("upper limit.")
    score = spark.createDataFrame([(1.0, 0.5)], "precision double, recall double").select(sentences.score_text()).first()[0]
    assert score == "No two people were mixed up; 50.0% of pairs were found."
    small = spark.createDataFrame([(0.30, 0.41, 120, "measured"), (0.38, None, 5, "default")], "line double, closest double, pairs long, basis string")
    first, second = (r[0] for r in small.select(sentences.small_line_text()).collect())
    assert first.startswith("Small faces join within 0.30") and first.endswith("range.") and second.startswith("Using the cautious 0.38")
    told = spark.createDataFrame([(0, 0, 0, 0), (9, 1, 4, 2), (9, 3, 0, 0), (9, 0, 4, 0), (9, 0, 0, 0)], "judged long, wrong long, split_off long, people_split long")
    assert [r[0][:12] for r in told.select(sentences.verdict_text()).collect()] == ["Nothing has ", "1 face is wi", "3 faces are ", "Nobody is mi", "All that was"]
    cuts = spark.createDataFrame([(None, 0.4, 0.4), (0.3, 0.5, 0.4), (0.6, 0.5, 0.55)], "floor double, ceiling double, cut double")
    assert [r[0].split()[0] for r in cuts.select(sentences.evidence_text()).collect()] == ["Judge", "The", "The"]

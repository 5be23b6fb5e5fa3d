"""Runs exclude each other, stop at their deadline, and go on where the one before stopped."""

import datetime as dt
import threading
import time

import pytest
from pyspark.sql import functions as F

from lodestrata.streaming import runs
from lodestrata.streaming.events import read, run_available


def test_of_two_runs_at_once_one_does_nothing(spark, tmp_path):
    folder, begun, second = str(tmp_path), [], []

    def other():
        second.append(runs.scheduled(spark, folder, lambda run: begun.append("other")))

    def work(run):
        begun.append("first")
        thread = threading.Thread(target=other)
        thread.start()
        thread.join()

    assert runs.scheduled(spark, folder, work) == "done"
    assert (begun, second) == (["first"], ["skipped"])
    assert runs.scheduled(spark, folder, lambda run: None) == "done"
    assert [tuple(r) for r in runs.history(spark, folder).orderBy("number").select("number", "state").collect()] == [(0, "done"), (1, "done")]


def test_a_run_over_its_cap_stops_and_the_next_goes_on(spark, tmp_path):
    source, sink, state, folder = (str(tmp_path / x) for x in ("in", "out", "state", "runs"))
    for i in range(6):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(source)

    def slow(seconds):
        def wait(batch):
            for part in batch:
                time.sleep(seconds)
                yield part

        return lambda run: run_available(read(spark, source, "id long", 1).mapInPandas(wait, "id long"), sink, state)

    began = time.time()
    assert runs.scheduled(spark, folder, slow(8), cap=10, patience=20, beat=1) == "stopped"
    assert time.time() - began < 40  # six batches of eight seconds aren't waited for
    written = spark.read.schema("id long").parquet(sink).count() if (tmp_path / "out").exists() else 0  # on a slow machine, perhaps no batch was done by then
    assert written < 60
    assert runs.scheduled(spark, folder, slow(0), cap=100) == "done"
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == list(range(60))
    assert [r.state for r in runs.history(spark, folder).orderBy("number").collect()] == ["stopped", "done"]


def test_a_silent_run_is_followed_and_ends(spark, tmp_path, monkeypatch):
    folder, states = str(tmp_path), []

    def work(run):
        monkeypatch.setattr(runs._Folder, "alive", lambda *_: False)  # as if it had been silent
        states.append(runs.scheduled(spark, folder, lambda run: None))
        while True:
            run.check()
            time.sleep(0.1)

    assert runs.scheduled(spark, folder, work, patience=10, beat=1) == "lost"
    assert states == ["done"]


def test_silence_is_measured_by_the_store(spark, tmp_path):
    files = runs._Folder(spark, str(tmp_path))
    files.put("000000000.run", "{}")
    assert files.alive(0, 60) and not files.alive(0, -1)
    files.put("000000000.end", "{}")
    assert not files.alive(0, 60)


def test_work_that_fails_frees_the_lease(spark, tmp_path):
    def work(run):
        spark.range(3).select(F.raise_error(F.lit("broken"))).collect()

    with pytest.raises(Exception, match="broken"):
        runs.scheduled(spark, str(tmp_path), work)
    assert runs.scheduled(spark, str(tmp_path), lambda run: None) == "done"
    assert [r.state for r in runs.history(spark, str(tmp_path)).orderBy("number").collect()] == ["failed", "done"]
    assert runs.history(spark, str(tmp_path / "none")).count() == 0


def test_daily_starts():
    at = dt.datetime(2024, 2, 28, 2, 0)
    assert runs.next_start(at) == dt.datetime(2024, 2, 29, 2, 0)
    assert runs.next_start(dt.datetime(2024, 2, 28, 1, 59)) == at
    with pytest.raises(ValueError):
        runs.scheduled(None, "", None, patience=10, beat=6)

"""Streams: late rows, windows and sessions over several batches."""

import os
import pathlib
import shutil
from datetime import datetime, timedelta

from gradeworks.streaming import monitor

START = datetime(2024, 5, 1)


def write(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/b{i}")
    pathlib.Path(f"{path}/all").mkdir()
    for i in range(len(batches)):
        part = next(pathlib.Path(f"{path}/in/b{i}").glob("part-*"))
        shutil.copy(part, f"{path}/all/{i}.parquet")
        when = (START + timedelta(days=i)).timestamp()
        os.utime(f"{path}/all/{i}.parquet", (when, when))
    return f"{path}/all"


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_windows_drop_late_rows(spark, tmp_path):
    batches = [[(at(1), "a", 0.2), (at(5), "a", None), (at(9), "b", 0.9)], [(at(200), "a", 0.5)], [(at(201), "b", 1.0)], [(at(2), "a", 0.9), (at(205), "a", 0.1)], [(at(600), "b", 1.0)]]
    src = write(spark, tmp_path, batches, "ts timestamp, metric string, score double")
    out = monitor.drain(monitor.windowed(monitor.read_stream(spark, src, 1), {"a": 0.4}, "10 minutes", "30 minutes"), "w").orderBy("start", "metric").collect()
    assert [(r.metric, r.mean, r.n_alerts, r.n) for r in out] == [("a", 0.2, 1, 2), ("b", 0.9, 0, 1), ("a", 0.3, 1, 2), ("b", 1.0, 0, 1)]


def test_conversations_are_put_together(spark, tmp_path):
    batches = [[(1, at(0), "user", "q1"), (2, at(3), "user", "x")], [(1, at(4), "assistant", "a1"), (1, at(60), "user", "q2")], [(9, at(500), "user", "end")]]
    src = write(spark, tmp_path, batches, "conv_id long, ts timestamp, role string, content string")
    out = monitor.drain(monitor.conversations(monitor.read_stream(spark, src, 1), "15 minutes", "10 minutes"), "c").orderBy("conv_id", "start").collect()
    assert [(r.conv_id, [t.content for t in r.turns]) for r in out] == [(1, ["q1", "a1"]), (1, ["q2"]), (2, ["x"])]


def test_alerts_and_scores_need_no_state(spark, tmp_path):
    src = write(spark, tmp_path, [[(1, "a", 0.2), (2, "a", 0.6)], [(3, "b", 0.1), (4, "a", None)]], "sample_id long, metric string, score double")
    out = monitor.drain(monitor.score_alerts(monitor.read_stream(spark, src, 1), {"a": 0.5}), "a").collect()
    assert [(r.sample_id, r.least) for r in out] == [(1, 0.5)]

"""Streams with state over several batches, and scorecards."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gradeworks.operators import scorecards
from gradeworks.streaming import live, monitor

from .test_streaming import at, write

ASKED = "request_id long, ts timestamp, metric string"
REPLIED = "request_id long, reply_ts timestamp, response_json string"


def test_late_repeated_and_lost_replies(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "r").mkdir()
    q = write(spark, tmp_path / "q", [[(1, at(0), "a"), (2, at(1), "a"), (1, at(0), "a")], [(3, at(2), "b"), (1, at(0), "a"), (6, at(4), "b")], [(9, at(5000), "end")]], ASKED)
    r = write(spark, tmp_path / "r", [[(1, at(5), "one"), (1, at(5), "one")], [(2, at(40), "too late"), (1, at(5), "one"), (7, at(9), "nobody asked")], [(6, at(34), "in time"), (9, at(5001), "x"), (10, at(9000), "x")]], REPLIED)
    out = live.settle(monitor.read_stream(spark, q, 1), monitor.read_stream(spark, r, 1), "30 MINUTES", "1 day")
    got = {x.request_id: x for x in monitor.drain(out, "settled").collect()}
    assert {i: (x.ok, x.response_json, x.error) for i, x in got.items() if i < 9} == {1: (True, "one", None), 2: (False, None, "timeout"), 3: (False, None, "timeout"), 6: (True, "in time", None)}
    assert monitor.drain(out, "again").count() == len(got) and got[1].metric == "a"


MESSAGE = "conv_id long, turn int, ts timestamp, role string, content string, closing boolean"


def test_dialogs_equal_a_batch_version(spark, tmp_path):
    r, rows = random.Random(8), []
    for c in range(40):
        n = r.randrange(1, 8)
        made = [(c, t, at(c + t), "user", f"{c}-{t}", t == n - 1 if c % 3 else None) for t in range(n)]
        if c % 5 == 4 and n > 1:
            del made[r.randrange(n - 1)]  # a message is lost
        rows += made + [m for m in made if r.random() < 0.4]
    r.shuffle(rows)
    batches = [rows[i::4] for i in range(4)] + [[(-1, 0, at(10**6), "user", "", False)]]
    src = write(spark, tmp_path, batches, MESSAGE)
    got = monitor.drain(live.dialogs(monitor.read_stream(spark, src, 1), 1200, "20 days"), "dialogs").collect()
    want = live.whole_dialogs(spark.createDataFrame(rows, MESSAGE)).collect()
    key = lambda x: (x.conv_id, x.how, [tuple(t) for t in x.turns])
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) == 40
    assert {x.how for x in got} == {"CLOSED", "TIMED_OUT"}


def test_an_ended_dialog_ignores_repeats_until_its_state_goes(spark, tmp_path):
    one = (1, 0, at(0), "user", "hi", True)
    batches = [[one], [one, (2, 0, at(1), "user", "open", False)], [(9, 0, at(300), "user", "far", False)], [(9, 1, at(301), "user", "far", False)]]
    src = write(spark, tmp_path, batches, MESSAGE)
    got = monitor.drain(live.dialogs(monitor.read_stream(spark, src, 1), 600, "1 minute"), "dialogs").collect()
    assert sorted((x.conv_id, x.how, len(x.turns)) for x in got) == [(1, "CLOSED", 1), (2, "TIMED_OUT", 1)]


def test_a_replayed_batch_changes_no_gate(spark, tmp_path):
    schema = "sample_id long, metric string, score double, ts timestamp"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    sink = live.GateSink(str(tmp_path / "out"), {"a": 0.5, "b": 0.5})
    batches = [[(1, "a", 0.9, at(0)), (2, "a", 0.1, at(0)), (2, "a", 0.2, at(1))], [(1, "b", 0.9, at(2)), (3, "a", None, at(2))], [(2, "a", 0.8, at(3)), (2, "b", 1.0, at(3)), (1, "a", 0.1, at(-5))]]
    gates = lambda: {r.sample_id: (r.passed, r.n_failed) for r in sink.gates(spark).collect()}
    seen = []
    for i, b in enumerate(batches):
        sink(frame(b), i)
        seen.append(gates())
    assert seen == [{1: (False, 1), 2: (False, 2)}, {1: (True, 0), 2: (False, 2), 3: (False, 2)}, {1: (True, 0), 2: (True, 0), 3: (False, 2)}]
    for i in (2, 0, 1, 1):
        sink(frame(batches[i]), i)
        assert gates() == seen[-1]
    assert {(r.sample_id, r.metric): r.score for r in sink.scores(spark).collect()}[1, "a"] == 0.9  # an older score is no news


def test_all_deterministic_metrics_on_a_stream(spark, tmp_path):
    rows = [(1, datetime(2024, 5, 1), "the cat sat", "the cat sat"), (2, datetime(2024, 5, 1), "a dog", "some dog ran"), (3, datetime(2024, 5, 1), None, "x")]
    schema = "sample_id long, ts timestamp, response string, reference string"
    src = write(spark, tmp_path, [rows[:2], rows[2:]], schema)
    names = list(monitor.DETERMINISTIC)
    live_rows = monitor.drain(monitor.scores(monitor.read_stream(spark, src, 1), names), "all").collect()
    table = monitor.scores(spark.createDataFrame(rows, schema), names)
    assert sorted(map(str, live_rows)) == sorted(map(str, table.collect())) and len(live_rows) == 3 * len(names)
    got = {(r.sample_id, r.metric): r.score for r in live_rows}
    assert all(got[1, m] == 1.0 for m in names if m != "bleu") and all(got[3, m] is None for m in names)
    assert abs(got[1, "bleu"] - 0.25**0.25) < 1e-8  # no four words in a row
    assert got[2, "groundedness"] is None and 0 < got[2, "rouge1"] < 1 and table.columns == ["sample_id", "ts", "metric", "score"]


def test_merged_sketches_equal_the_whole(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), r.choice("xy") if r.random() < 0.9 else None, r.random() ** 2 if r.random() < 0.95 else None) for _ in range(4000)]
    s, keys = spark.createDataFrame(rows, "metric string, lang string, score double"), ["metric", "lang"]
    whole = scorecards.sketch(s, keys)
    parts = [scorecards.sketch(s.where(F.pmod(F.xxhash64("score"), F.lit(5)) == k), keys) for k in range(5)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    rounded = lambda df: sorted((str(x.metric), str(x.lang), x.bucket, x.n, round(x.total, 9)) for x in df.collect())
    assert rounded(scorecards.merge(merged, keys)) == rounded(whole)
    sets = [keys, ["metric"], []]
    card = {(x.grouping, x.metric, x.lang): x for x in scorecards.scorecard(whole, sets, keys).collect()}
    true = {(x.grouping, x.metric, x.lang): x for x in scorecards.exact(s, sets, keys).collect()}
    assert card.keys() == true.keys() and len(card) == 6 + 2 + 1
    for k, x in card.items():
        assert x.n == true[k].n and abs(x["mean"] - true[k]["mean"]) < 1e-9
        assert all(0 <= x[q] - true[k][q] <= 1 / scorecards.BUCKETS for q in ("q5", "q50", "q95"))
    assert scorecards.scorecard(scorecards.sketch(s.limit(0), keys), sets, keys).count() == 0

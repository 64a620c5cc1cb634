"""Live judging with state: requests meet replies, messages become conversations, scores change gates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gradeworks.operators import verdicts

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def settle(requests: DataFrame, replies: DataFrame, within: str, late: str) -> DataFrame:
    """Each request (request_id, ts and other columns) with ok, response_json, error and reply_ts, once its fate is known.

    ``replies`` (request_id, reply_ts, response_json) answer a request if they come no later than ``within`` after it.
    A request without such a reply is a failed row with the error ``timeout`` as soon as both streams' watermarks, which run
    ``late`` behind, have passed its time. Repeated requests and replies count once; columns of requests keep
    their names. State goes with the watermarks.
    """
    q = requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["request_id"])
    r = replies.select(F.col("request_id").alias("replied"), "reply_ts", "response_json").withWatermark("reply_ts", late)
    r = r.dropDuplicatesWithinWatermark(["replied"])
    on = F.expr(f"request_id = replied AND reply_ts >= ts AND reply_ts <= ts + INTERVAL {within}")
    both = q.join(r, on, "left_outer")
    ok = F.col("replied").isNotNull()
    return both.select(*requests.columns, ok.alias("ok"), "response_json", F.when(~ok, F.lit("timeout")).alias("error"), "reply_ts")


class Dialogs(StatefulProcessor):
    """One conversation per key: its turns by number, in a map that grows by a turn at a time, and a timer for its end."""

    def __init__(self, gap_ms: int) -> None:
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        text, long = T.StringType(), T.LongType()
        turn = T.StructType([T.StructField("ts", long), T.StructField("role", text), T.StructField("content", text)])
        self.turns = handle.getMapState("turns", T.StructType([T.StructField("turn", long)]), turn)
        about = [T.StructField(n, long) for n in ("count", "last", "end")]
        self.about = handle.getValueState("about", T.StructType([*about, T.StructField("done", T.BooleanType())]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        count, last, end, done = tuple(self.about.get()) if self.about.exists() else (0, None, None, False)
        before = last
        for r in rows:
            ts = int(r["ts"].timestamp() * 1000)
            last = ts if last is None else max(last, ts)
            if done or self.turns.containsKey((r["turn"],)):
                continue  # a repeated message, or one for a conversation that has ended
            self.turns.updateValue((r["turn"],), (ts, r["role"], r["content"]))
            count += 1
            end = r["turn"] if r["closing"] else end
        out = []
        if not done and end is not None and count == end + 1:
            out, done = [self._row(key, "CLOSED")], True
            self.turns.clear()
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.gap)
            self.handle.registerTimer(last + self.gap)
        self.about.update((count, last, end, done))
        return iter(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        done = self.about.exists() and tuple(self.about.get())[3]
        out = [] if done or not self.about.exists() else [self._row(key, "TIMED_OUT")]
        self.turns.clear()
        self.about.clear()
        return iter(out)

    def _row(self, key: Any, how: str) -> Row:
        turns = sorted((k[0], *v) for k, v in self.turns.iterator())
        return Row(conv_id=key[0], how=how, turns=[Row(turn=t, role=role, content=content) for t, _, role, content in turns])

    def close(self) -> None:
        pass


TURNS = "array<struct<turn:bigint,role:string,content:string>>"


def dialogs(messages: DataFrame, gap_seconds: int, late: str) -> DataFrame:
    """conv_id, how, turns: conversations from messages (conv_id, turn from 0, ts, role, content, closing) in any order, some of them repeated.

    A conversation is CLOSED when its closing message and all turns before it are there, and TIMED_OUT, with the
    turns that came, when the watermark (``late`` behind) is ``gap_seconds`` past its last message. Its state is dropped at
    that time too; until then repeats of an ended conversation are ignored. Null conv_ids are one conversation.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "ts", "role", "content", F.coalesce("closing", F.lit(False)).alias("closing"))
    schema = f"conv_id {dict(messages.dtypes)['conv_id']}, how string, turns {TURNS}"
    return rows.withWatermark("ts", late).groupBy("conv_id").transformWithState(statefulProcessor=Dialogs(gap_seconds * 1000), outputStructType=T._parse_datatype_string(schema), outputMode="Append", timeMode="EventTime")


def whole_dialogs(messages: DataFrame) -> DataFrame:
    """What ``dialogs`` gives in the end, from a table."""
    once = messages.groupBy("conv_id", F.col("turn").cast("long").alias("turn")).agg(F.min_by(F.struct("role", "content"), "ts").alias("m"), F.max(F.coalesce("closing", F.lit(False))).alias("closing"))
    turn = F.struct("turn", F.col("m.role").alias("role"), F.col("m.content").alias("content"))
    end = F.max(F.when(F.col("closing"), F.col("turn")))
    how = F.when(F.count("*") == end + 1, "CLOSED").otherwise("TIMED_OUT")
    return once.groupBy("conv_id").agg(how.alias("how"), F.array_sort(F.collect_list(turn)).alias("turns"))


class GateSink:
    """A ``foreachBatch`` sink that keeps the latest score of each sample and metric, and the gates that follow from them.

    ``path`` lies in a folder that driver and executors share. A batch (sample_id, metric, score, ts) replaces the folder of its
    own number only and reads those of earlier ones, so a batch that is replayed, in part or as a whole, changes
    nothing. Of a sample's scores for a metric the one of the latest ts counts, then that of the later batch.
    """

    def __init__(self, path: str, thresholds: dict[str, float]) -> None:
        self.path, self.thresholds = path, thresholds

    def __call__(self, batch: DataFrame, number: int) -> None:
        latest = F.max_by(F.struct("score", "ts"), F.struct("ts", "score"))
        rows = batch.groupBy("sample_id", "metric").agg(latest.alias("s")).select("sample_id", "metric", "s.score", "s.ts")
        rows.write.mode("overwrite").parquet(f"{self.path}/scores/batch={number}")
        spark = batch.sparkSession
        touched = spark.read.parquet(f"{self.path}/scores/batch={number}").select("sample_id").distinct()
        now = self.scores(spark, number).join(touched, "sample_id", "left_semi")
        verdicts.gate(now, self.thresholds).write.mode("overwrite").parquet(f"{self.path}/gates/batch={number}")

    def scores(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """sample_id, metric, score: the latest ones, of batches up to a number."""
        rows = spark.read.schema("sample_id long, metric string, score double, ts timestamp, batch long").parquet(f"{self.path}/scores")
        rows = rows.where(F.col("batch") <= upto) if upto is not None else rows
        return rows.groupBy("sample_id", "metric").agg(F.max_by("score", F.struct("ts", "batch")).alias("score"))

    def gates(self, spark: SparkSession) -> DataFrame:
        """sample_id, passed, n_failed as of the latest batch that had a score of the sample."""
        rows = spark.read.schema("sample_id long, passed boolean, n_failed long, batch long").parquet(f"{self.path}/gates")
        return rows.groupBy("sample_id").agg(F.max_by(F.struct("passed", "n_failed"), "batch").alias("g")).select("sample_id", "g.*")


def run_into(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run a stream over all that is there into a ``foreachBatch`` sink; it starts again where it stopped."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

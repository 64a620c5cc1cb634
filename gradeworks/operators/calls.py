"""Calls of judges and embedding models: one for each distinct request, logged as it is answered, so a run can be taken up again."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gradeworks.functions.batches import parts

#: A key that more than one in so many rows have is frequent; there are no more such keys than this.
FREQUENT = 1000


def join_hot(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` joined with the one row that ``right`` has for each key.

    Rows of frequent keys, of which there are at most FREQUENT, are dealt over tasks by the task that they come from
    and meet copies of their row of ``right`` there. ``left`` is read once to count its keys and once for the result.
    """
    seen = Observation()
    counts = left.groupBy(key).count().observe(seen, F.sum("count").alias("total"))
    top = counts.where(F.col("count") > 1).orderBy(F.desc("count")).limit(FREQUENT).collect()
    often = [(r[0],) for r in top if r[1] * FREQUENT > seen.get["total"]]
    if not often:
        return left.join(right, key)
    spark, k = left.sparkSession, "\x1f".join(left.columns + right.columns)  # a name that no column has
    few = F.broadcast(spark.createDataFrame(often, T.StructType([left.schema[key]])).withColumn(k, F.lit(True)))
    n = F.lit(int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = left.join(few, key, "left").withColumn(k, F.when(F.col(f"`{k}`"), F.pmod(F.spark_partition_id(), n)).otherwise(0))
    copies = F.when(F.col(f"`{k}`"), F.sequence(F.lit(0), n - 1)).otherwise(F.array(F.lit(0)))
    return dealt.join(right.join(few, key, "left").withColumn(k, F.explode(copies)), [key, k]).drop(k)


def answers(hook: Callable, texts: pd.Series, models: pd.Series) -> list[tuple]:
    """(reply or exception, milliseconds) for each text.

    ``hook`` takes texts and models and yields a reply or an exception for each, in order. When it raises, the
    first text that it has not answered is the failed one, and it is called for those after it, so nothing is
    asked twice. A hook that returns a list and raises has answered none; then each text is asked alone.
    """
    out: list[tuple] = []
    while len(out) < len(texts):
        first, since = len(out), time.monotonic()
        try:
            replies = hook(texts.iloc[first:], models.iloc[first:])
        except Exception as e:  # noqa: BLE001
            if len(texts) == 1:
                return [(e, int((time.monotonic() - since) * 1000))]
            return [x for i in range(len(texts)) for x in answers(hook, texts.iloc[i : i + 1], models.iloc[i : i + 1])]
        try:
            for r in replies:
                now = time.monotonic()
                out.append((r, int((now - since) * 1000)))
                since = now
            out += [(ValueError("no reply"), 0)] * (len(texts) - len(out))
        except Exception as e:  # noqa: BLE001
            out.append((e, int((time.monotonic() - since) * 1000)))
    if len(out) > len(texts):
        return [(ValueError("a hook must give one reply for each text"), 0)] * len(texts)
    return out


def run_hook(requests: DataFrame, hook: Callable, text: str, reply: str, kind: str, drop: tuple[str, ...] = (), calls: str | None = None) -> DataFrame:
    """``requests`` (with model_id and ``text``) without ``drop``, with ok, ``reply`` (of type ``kind``), error and duration_ms; a bad call is a failed row.

    The hook gets parts of a batch, of ``batches.SLICE`` bytes of texts each; other columns pass as they are. ``calls`` is a
    column of arrays of structs (model_id and others), each of which is a call of its row's text, with its fields as columns.
    """
    fields = requests.schema[calls].dataType.elementType.fields if calls else []
    kinds = [x for x in requests.dtypes if x[0] != calls] + [(f.name, f.dataType.simpleString()) for f in fields]
    names = [n for n, _ in kinds if n not in drop]
    schema = ", ".join(f"`{n}` {t}" for n, t in kinds if n not in drop) + f", ok boolean, {reply} {kind}, error string, duration_ms long"
    arrow = to_arrow_type(T.StructType.fromDDL(f"r {kind}")["r"].dataType)
    told = ["ok", reply, "error", "duration_ms"]

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi in parts((batch.column(text),)):
            part = batch.slice(lo, hi - lo)
            own = part.column(calls)
            rows = part.drop_columns([calls]).take(pc.list_parent_indices(own))
            made = own.flatten()
            yield pa.RecordBatch.from_arrays([*rows.columns, *made.flatten()], [n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in (each(whole) if calls else [whole])):
            texts = batch.column(text)
            for lo, hi in parts((texts,)):
                part = batch.slice(lo, hi - lo)
                got = answers(hook, part.column(text).to_pandas(), part.column("model_id").to_pandas())
                bad = [isinstance(r, BaseException) or r is None for r, _ in got]
                replies = pa.array([None if b else r for (r, _), b in zip(got, bad, strict=True)], arrow)
                errors = pa.array([str(r) or type(r).__name__ if b and r is not None else None for (r, _), b in zip(got, bad, strict=True)], pa.string())
                made = [pa.array([not b for b in bad], pa.bool_()), replies, errors, pa.array([ms for _, ms in got], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *made], [*names, *told])

    return requests.mapInArrow(run, schema)


class CallLog:
    """Replies on disk, a row for each distinct call, named by a digest of model, iteration and the text's digest.

    ``path`` lies in a folder that driver and executors share. Rows are only ever added. A task's replies are
    there as soon as the task is done (the committer's second algorithm moves them then), so of a job that
    breaks off only the open tasks' calls are lost; where the file system's committer can't do that, ``waves``
    divides the calls over several writes. A call that is logged twice after all counts once.
    """

    def __init__(self, spark: SparkSession, path: str, reply: str = "response_json", kind: str = "string") -> None:
        self.spark, self.path, self.reply, self.kind = spark, path, reply, kind
        self.schema = f"call binary, digest binary, model_id string, iteration string, ok boolean, {reply} {kind}, error string, duration_ms long"
        spark.createDataFrame([], self.schema).write.parquet(self._folder())

    def _folder(self) -> str:
        return f"{self.path}/{uuid.uuid4().hex}"

    def _read(self) -> DataFrame:
        # each write has a folder of its own: scans of one folder count as equal in a plan, whatever files they found
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/*")

    @staticmethod
    def digest(text: Column) -> Column:
        return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))

    @staticmethod
    def call(digest: Column, model: Column, iteration: Column) -> Column:
        """The name of a call. Iterations of one prompt are calls of their own."""
        head = F.concat_ws("\x1f", F.coalesce(model, F.lit("")), iteration.cast("string"), F.hex(digest))
        return F.unhex(F.sha2(head, 256))

    def rows(self) -> int:
        """How many calls have been logged, repeated ones included."""
        return self._read().count()

    def replies(self) -> DataFrame:
        """One row for each logged call: a successful one if there is any."""
        return self._best(self._read(), "call")

    def _best(self, rows: DataFrame, *keys: str) -> DataFrame:
        reply = F.struct(*[c for c in ("digest", "model_id", "iteration", "ok", self.reply, "error", "duration_ms") if c not in keys])
        return rows.groupBy(*keys).agg(F.min_by(reply, F.struct(~F.col("ok"), "duration_ms")).alias("r")).select(*keys, "r.*")

    def ask(self, requests: DataFrame, hook: Callable, text: str = "prompt", waves: int = 1, failed_again: bool = False, tasks: int | None = None, models: list[str] | None = None, iterations: int = 1) -> DataFrame:
        """``requests`` (model_id, ``text``, perhaps iteration and others) with ok, the reply, error and duration_ms of their calls.

        Calls that the log has are not made again, failed ones only with ``failed_again``; of equal requests one is
        made. ``tasks`` is how many calls run at once (default: as many as shuffle partitions). The result is read from
        the log, so using it twice calls nobody. Null texts are asked as empty ones.

        With ``models`` each request goes to each of them, ``iterations`` times, as ``judging.fan_out`` would make it; this way a
        text is named, sorted and shuffled once, and copied for its calls only where they are made.
        """
        to = ("model_id", "model_pos", "iteration")
        if models is None:
            iteration = F.col("iteration") if "iteration" in requests.columns else F.lit(1)
            own = [F.collect_set(F.struct("model_id", iteration.cast("string").alias("iteration"))).alias("to")]
        else:
            requests, iteration, own = requests.drop(*to), F.col("iteration"), []
            each = F.array(*[F.struct(F.lit(x).alias("model_id"), F.lit(i).alias("model_pos"), F.lit(t).alias("iteration")) for i, x in enumerate(models) for t in range(1, iterations + 1)])
        named = requests.withColumn("digest", self.digest(F.col(text)))
        for wave in range(waves):
            mine = named if waves == 1 else named.where(F.pmod(F.xxhash64("digest"), F.lit(waves)) == wave)
            once = mine.groupBy("digest").agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias("text"), *own)
            known = self.replies()
            known = (known.where("ok") if failed_again else known).groupBy("digest").agg(F.collect_set("call").alias("known"))
            calls = F.transform("to" if models is None else each, lambda x: F.struct(self.call(F.col("digest"), x["model_id"], x["iteration"]).alias("call"), x["model_id"].alias("model_id"), x["iteration"].cast("string").alias("iteration")))
            open_ = F.array_distinct(F.filter(calls, lambda x: ~F.coalesce(F.array_contains("known", x["call"]), F.lit(False))))
            todo = once.join(known, "digest", "left").select("digest", "text", open_.alias("calls"))
            if tasks:
                todo = todo.select("digest", "text", F.explode("calls").alias("c")).repartition(tasks, "c.call").select("digest", "text", F.array("c").alias("calls"))
            got = run_hook(todo, hook, "text", self.reply, self.kind, ("text",), "calls")
            got.select(*T.StructType.fromDDL(self.schema).names).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(self._folder())
        told = ["ok", self.reply, "error", "duration_ms"]
        if models is None:
            named = named.withColumn("call", self.call(F.col("digest"), F.col("model_id"), iteration)).drop("digest")
            return join_hot(named, self.replies().select("call", *told), "call").drop("call")
        # one shuffle by text serves both sums; a text has no more calls than it has models and iterations
        by_text = self._best(self._read().repartition("digest"), "digest", "call").groupBy("digest").agg(F.collect_list(F.struct("model_id", "iteration", *told)).alias("got"))
        rows = join_hot(named, by_text, "digest").select(*requests.columns, F.explode("got").alias("got"))
        mine = F.filter(each, lambda x: (x["model_id"] == F.col("got.model_id")) & (x["iteration"].cast("string") == F.col("got.iteration")))
        return rows.select("*", F.explode(mine).alias("to")).select(*requests.columns, *[f"to.{c}" for c in to], *[f"got.{c}" for c in told])

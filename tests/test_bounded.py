"""Tasks hold parts of a batch, not all of it, and results don't depend on the order of rows."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gradeworks.functions import batches
from gradeworks.functions import text as tx
from gradeworks.llm import repeats
from gradeworks.operators import calls, embedding, overlap, similarity, verdicts


def peak(f) -> float:
    """MB that ``f`` allocates at most at a time."""
    tracemalloc.start()
    f()
    out = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out


def test_mean_does_not_depend_on_the_order_of_rows(spark):
    rows = [(1, "m0", 0.41), (1, "m1", 0.7), (1, "m2", 0.99)]  # 2.1 or a little less, by the order of addition
    kind = "sample_id long, model_id string, score double"
    means = {verdicts.model_stats(spark.createDataFrame(r, kind).coalesce(1)).first()["mean"] for r in (rows, rows[::-1])}
    assert means == {(0.41 + 0.7 + 0.99) / 3}


def test_overlap_holds_a_part_of_a_batch():
    rng = random.Random(1)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(300)) for _ in range(3000)]
    a, b = pa.array(texts), pa.array(texts[::-1])
    run = overlap._counter({"char": [1, 2, 3, 4, 5, 6], "word": [1, 2]}).func
    assert peak(lambda: [None for _ in run([(a, b)])]) < 60  # the batch takes 12 MB, its words as objects many times that


def test_tokens_are_those_of_the_column_function(spark):
    texts = ["", "Ab, c", "aéb Жё-1", "x\U0001f600y", "  z", "one\x1ctwo three"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    rows = df.select(F.lower("t").alias("t"), tx.tokenize(F.col("t")).alias("w")).collect()
    hashed, n = batches.tokens(*batches.points([r.t for r in rows]))
    assert n.tolist() == [len(r.w) for r in rows]
    one = {w: batches.tokens(*batches.points([w]))[0][0] for r in rows for w in r.w}
    assert hashed.tolist() == [one[w] for r in rows for w in r.w] and len(set(one.values())) == len(one)


def test_rouge_l_of_rows_in_parts():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(40))) for _ in range(5000)]
    got = pa.concat_arrays(list(similarity._lcs([(pa.array(texts), pa.array(texts[::-1]))]))).to_pylist()
    assert len(got) == 5000 and all(g["lcs"] == similarity.lcs_length(x.split(), y.split()) for g, x, y in zip(got[::50], texts[::50], texts[::-1][::50]))


def test_parts_cover_all_rows():
    texts = [pa.array(["x" * n if n else None for n in (0, 5, 400_000, 1, 0)] * 3)]
    got = list(batches.parts(texts))
    assert [x for lo, hi in got for x in range(lo, hi)] == list(range(15)) and len(got) == 7
    assert list(batches.parts([pa.array([], pa.string())])) == [] and isinstance(got[0][1], (int, np.integer))


def test_hooks_get_parts_of_a_batch(spark):
    rows = spark.range(4000).select(F.lit("m").alias("model_id"), F.concat(F.col("id").cast("string"), F.lit(" "), F.repeat(F.lit("x"), 1000)).alias("prompt")).coalesce(1)
    got = calls.run_hook(rows, lambda texts, models: [str(len(texts))] * len(texts), "prompt", "reply", "string", ("prompt",))
    sizes = [int(r.reply) for r in got.collect()]
    assert len(sizes) == 4000 and max(sizes) < 300 and got.columns == ["model_id", "ok", "reply", "error", "duration_ms"]


def test_chunks_are_made_in_parts_of_a_batch(spark):
    texts = pa.array(["One two three. " * 300] * 3000)  # 13 MB
    run = embedding.split_into_chunks
    made = []
    found = F.arrow_udf
    try:
        F.arrow_udf = lambda f, kind: made.append(f) or (lambda c: c)
        run(F.lit("x"), 10)
    finally:
        F.arrow_udf = found
    sizes = [len(x) for x in made[0]([texts])]
    assert sum(sizes) == 3000 and max(sizes) < 100


def test_repeats_are_cut_in_parts_of_a_batch():
    texts = pa.array([b"one two three four " * 250] * 400)  # 2 MB
    block = [{"lo": i, "hi": i, "ref": {"h": 1, "lo": 0, "id": 1}} for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), texts, pa.array([block] * 400), pa.array([None] * 400, pa.list_(pa.int32()))], ["id", "text", "blocks", "ends"])
    sizes = [b.num_rows for b in repeats._without(35)([batch])]
    assert sum(sizes) == 400 and max(sizes) < 100


def test_blank_and_trimmed(spark):
    texts = [None, "", " \t\n", "  ", " a ", "\x00\x1fb\x00", "c\u0085", " d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(tx.blank(F.col("t"))).collect()] == [True] * 4 + [False] * 4
    assert [r[0] for r in df.select(tx.trimmed(F.col("t"))).collect()] == [None, "", "", "  ", "a", "b", "c\u0085", " d"]

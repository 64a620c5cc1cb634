"""The pipeline against a plain version of each stage on the rows that the stage before it kept."""

import random
import re

import corpus_pipeline
from gradeworks.llm import pii, quality
from gradeworks.llm.queries import tokenizer

from .common import COLUMNS, odd, table
from .test_decontaminate import brute as passages
from .test_near_dedup import brute as groups
from .test_quality import plain as measures


def test_each_stage_on_what_the_one_before_kept(spark, tmp_path):
    r = random.Random(7)
    word = lambda: r.choice(["harbour", "wind", "of", "the", "stone", "market"]) + str(r.randrange(400))
    item = " ".join(f"q{i}" for i in range(60))
    texts = [" ".join(word() for _ in range(120)) for _ in range(60)]
    texts += [" ".join(w + "##" for w in t.split()) for t in texts[:8]]
    texts += [t + " tail" for t in texts[10:16]] + texts[20:24] + [texts[30] + " " + item, item + " " + texts[31]]
    texts += [" ".join(word() for _ in range(70)) + " mail me@x.example.org or +1 (415) 555-2671", "too short", "", None]
    docs = table(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns
        kept[name] = {x.doc_id: x.text for x in out.collect()}
        out = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in kept[name].items()], COLUMNS)

    def fails(t):
        n, _, symbols, _, repeats = measures(t)
        return n < 50 or 100 * repeats > 50 * n or 100 * symbols > 25 * n

    assert set(kept["quality rules"]) == {i for i, t in enumerate(texts) if not fails(t)}
    assert set(kept["near-dedup"]) == {d for d, _, _, k in groups(sorted(kept["quality rules"].items()), 80) if k}
    ids = sorted(kept["near-dedup"])
    found = passages([kept["near-dedup"][i] for i in ids], [item])
    assert set(kept["decontamination"]) == {i for n, i in enumerate(ids) if not found[n]}
    for i, t in kept["personal data"].items():
        assert t == pii.redact(texts[i], pii.base_spans(texts[i]))
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in last} == set(kept["personal data"]) and all(x.round_trip for x in last)


def test_odd_rows_pass_every_stage(spark, tmp_path):
    spark.createDataFrame([(None, None), (2, ""), (3, "a b c d e f g")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd(spark), spark.createDataFrame([], COLUMNS)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns

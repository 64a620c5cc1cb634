import math
import random
from collections import Counter

import pyarrow as pa
import sentencepiece

from gradeworks.llm import piece_sampling as ps
from gradeworks.llm.queries import tokenizer

from ..test_bounded import peak
from .common import odd

MODEL = tokenizer("piece_bpe_32k.model")


def brute(text):
    """Every segmentation of the whole text, led by one space, into the model's pieces, with its chance."""
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    known = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)):
            known[sp.id_to_piece(i).replace(ps.MARK, " ")] = (i, 1 / (2 - sp.get_score(i)))
    out, text = {}, " " + text

    def walk(at, ids, weight):
        if at == len(text):
            out[ids] = weight
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in known:
                i, w = known[text[at:end]]
                walk(end, (*ids, i), weight * w)

    walk(0, (), 1.0)
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def test_runs_of_spaces_have_the_models_distribution():
    lat = ps.Lattices(MODEL)
    for text in ("a   b c", "  if x", "ab  ", "   "):
        want, n = brute(text), 20000
        got = ps._sampled(lat, MODEL, 2, list(range(n)), [text.encode()] * n).to_pylist()
        assert all(r["round_trip"] and math.isclose(r["log_prob"], math.log(want[tuple(r["ids"])]), abs_tol=1e-9) for r in got)
        seen = Counter(tuple(r["ids"]) for r in got if r["sample"] == 1)
        assert all(abs(seen[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 2 / n for k, p in want.items())
        pairs = {d: set() for d in range(n)}
        for r in got:
            pairs[r["doc_id"]].add(tuple(r["ids"]))
        assert all(len(x) == min(2, len(want)) for x in pairs.values())


def test_ends_of_texts_part_runs_of_spaces():
    lat = ps.Lattices(MODEL)
    texts = ["a  ", "  b", " ", "", None, "c\n    d", "a  "]
    batch = lambda x: {(r["doc_id"], r["sample"]): r["ids"] for r in ps._sampled(lat, MODEL, 2, [i for i, _ in x], [t and t.encode() for _, t in x]).to_pylist()}
    every = batch(list(enumerate(texts)))
    assert every == {k: v for x in enumerate(texts) for k, v in batch([x]).items()}
    assert any(len(ps.vocabulary(MODEL)[0][i].strip()) == 0 and len(ps.vocabulary(MODEL)[0][i]) > 1 for v in every.values() for i in v)


def test_table_is_decoded(spark):
    docs = odd(spark)
    out = ps.decoded(ps.sample(docs, MODEL, 2), MODEL)
    want = {(r.doc_id, r.text or "") for r in docs.collect()}
    assert {(r.doc_id, r.text) for r in out.collect()} == want
    stage = ps.stage(docs, MODEL, 1)
    assert stage.count() == docs.count() and ps.stage(docs.limit(0), MODEL).count() == 0


def test_a_task_holds_a_part_of_a_batch():
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(100)) for _ in range(4000)]  # 3.2 MB, all words differ
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array([t.encode() for t in texts])], ["doc_id", "text"])
    ps.lattices(MODEL)
    run = ps.sampler(MODEL, 2)
    sizes = []
    assert peak(lambda: sizes.extend(b.num_rows for b in run(iter([batch])))) < 200
    assert sum(sizes) == 8000 and max(sizes) < 1000


def test_parts_and_forgotten_lattices_change_no_result(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "cat", "x" * 9, "ünï", "  ", "Zq7"]) + str(rng.randrange(50)) for _ in range(rng.randrange(60))) for _ in range(200)] + ["", None, "long " * 5000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t and t.encode() for t in texts], pa.binary())], ["doc_id", "text"])
    whole = [r for b in ps.sampler(MODEL, 2)(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(ps, "PART", 1 << 10)
    monkeypatch.setattr(ps, "MOST_NODES", 100)
    ps.lattices(MODEL).clear()
    assert [r for b in ps.sampler(MODEL, 2)(iter([batch])) for r in b.to_pylist()] == whole

import random

from gradeworks.llm import quality as q
from gradeworks.llm.label_model import fit

from .common import COLUMNS, WORDS, odd, rows, table


def plain(t):
    t = t or ""
    w = WORDS.findall(t)
    seen, cov = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cov.update(j for i in at for j in range(i, i + 3))
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cov))


def test_measures(spark):
    r = random.Random(5)
    texts = [None, "", " \x0b\n", "a", "a a a a", "é b c é b c", "a\n\na\nb\n \na"]
    texts += ["".join(r.choice(["a", "bb", "\U0001f600", " ", " ", "\n", "#", "|", "\t", "é"]) for _ in range(r.randrange(1, 400))) for _ in range(150)]
    out = q.quality(table(spark, texts))
    got = rows(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == [(i, *plain(t)) for i, t in enumerate(texts)]
    assert all(x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words) and (not x.kept or not x.base_failed) for x in out.collect())


def test_odd_rows(spark):
    docs = odd(spark)
    assert q.quality(docs).count() == docs.count()
    assert q.stage(docs).columns == docs.columns
    empty = spark.createDataFrame([], COLUMNS)
    assert q.quality(empty).count() == 0 and q.stage(empty).count() == 0


def test_drops_junk_keeps_prose(spark):
    r = random.Random(1)
    prose = [" ".join(r.choice(["the", "harbour", "wind", "of", "market", "stone", "river"]) + str(r.randrange(90)) for _ in range(200)) for _ in range(150)]
    junk = [" ".join(w.upper() + "!!" for w in p.split()) for p in prose[:10]] + [" ".join(w + "###" for w in p.split()) for p in prose[:10]]
    docs = table(spark, prose + junk)
    got = {x.doc_id: x.kept for x in q.quality(docs).collect()}
    assert all(got[i] for i in range(150)) and not any(got[i] for i in range(150, 170))
    assert sorted(x.doc_id for x in q.stage(docs).collect()) == list(range(150))


def test_label_model_finds_bad_rules(spark):
    r, votes = random.Random(2), []
    for _ in range(4000):
        y = 1 if r.random() < 0.7 else -1
        votes.append(tuple(0 if r.random() < 0.3 else y if r.random() < a else -y for a in (0.95, 0.9, 0.85, 0.5)))
    counts = spark.createDataFrame(votes, "a int, b int, c int, d int").groupBy("a", "b", "c", "d").count().withColumnRenamed("count", "n")
    model = fit(counts, ["a", "b", "c", "d"], 0.5)["rules"]
    assert model["a"][0] > model["c"][0] > abs(model["d"][0]) + 0.5

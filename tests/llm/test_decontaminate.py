import random
from collections import Counter

from gradeworks.llm import decontaminate as dc

from .common import COLUMNS, WORDS, odd, table


def grams(t):
    w = WORDS.findall((t or "").lower())
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])


def brute(texts, items, percent=80):
    out = {}
    for d, t in enumerate(texts):
        w, got = WORDS.findall((t or "").lower()), set()
        for i, x in enumerate(items):
            y, n = Counter(grams(x)), len(WORDS.findall(x or ""))
            for s in range(len(w) - n + 1) if n else ():
                z = Counter(grams(" ".join(w[s : s + n])))
                if 100 * sum((y & z).values()) >= percent * sum((y | z).values()):
                    got.add(i)
        out[d] = sorted(got)
    return out


def test_against_every_window(spark):
    r = random.Random(4)
    word = lambda: f"w{r.randrange(300)}"
    items = [" ".join(word() for _ in range(r.choice([3, 12, 30, 60]))) for _ in range(25)] + [None, "", "one"]
    texts = []
    for i in range(60):
        w = [word() for _ in range(r.randrange(0, 120))]
        x = WORDS.findall(items[i % 25])
        if i % 3:
            if i % 3 == 2:
                x[r.randrange(len(x))] = r.choice(["other", x[0].upper()])
            x = [a.upper() if r.random() < 0.2 else a for a in x]
            at = r.randrange(len(w) + 1)
            w[at:at] = x
        texts.append(" ".join(w))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {x.doc_id: x.item_ids for x in dc.contamination(table(spark, texts), bench).collect()}
    assert got == brute(texts, items) and sum(map(bool, got.values())) > 20
    kept = {x.doc_id for x in dc.stage(table(spark, texts), bench).collect()}
    assert kept == {d for d, x in got.items() if not x}


def test_odd_rows(spark):
    docs = odd(spark)
    bench = spark.createDataFrame([(1, "a b c d e f g"), (2, None), (3, " ")], "item_id long, text string")
    out = dc.contamination(docs, bench)
    assert out.count() == docs.count()
    assert {x.doc_id for x in out.collect() if x.contaminated} == {7, 8}
    kept = dc.stage(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert dc.stage(docs, bench.limit(0)).count() == docs.count()
    assert dc.contamination(spark.createDataFrame([], COLUMNS), bench).count() == 0


def test_windows_between_and_beyond_anchors(spark):
    """Passages cut at the head or tail of a document, with swapped halves, and with words put in."""
    r = random.Random(5)
    fresh = lambda n: [f"x{r.randrange(10**6)}" for _ in range(n)]
    items = [" ".join(fresh(n)) for n in (50, 50, 100, 100, 20)]
    w = [x.split() for x in items]
    texts = [
        " ".join(w[0][2:] + fresh(40)),
        " ".join(fresh(40) + w[1][:-2]),
        " ".join(fresh(30) + w[2][50:] + w[2][:50] + fresh(30)),
        " ".join(fresh(30) + w[3][:60] + fresh(2) + w[3][60:] + fresh(30)),
        " ".join(w[4][1:] + fresh(1)),
        " ".join(w[0][10:] + fresh(40)),
        " ".join(w[0][2:]),
        " ".join(fresh(5) + w[0] + w[0][20:] + w[1] + fresh(5)),
    ]
    want = brute(texts, items)
    assert [want[i] for i in range(7)] == [[0], [1], [2], [3], [4], [], []]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {x.doc_id: x.item_ids for x in dc.contamination(table(spark, texts), bench).collect()}
    assert got == want

import random

import numpy as np
import pyarrow as pa

from gradeworks.llm import components as cc
from gradeworks.llm import near_dedup as nd
from gradeworks.llm.common import cut
from gradeworks.llm.components import components, merged

from .common import COLUMNS, WORDS, odd, rows, table


def brute(docs, percent):
    sets = {}
    for d, t in docs:
        w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    comp = {d: d for d in sets}

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = top(a), top(b)
                comp[max(p, q)] = min(p, q)
    return [(d, len(sets[d]), top(d), top(d) == d) for d in ids]


def test_against_all_pairs(spark):
    r = random.Random(3)
    made = [[f"w{r.randrange(5000)}" for _ in range(r.choice([3, 6, 60, 200]))] for _ in range(40)]
    texts = []
    for words in made:
        for _ in range(r.randrange(1, 9)):
            c = list(words)
            for _ in range(r.randrange(0, 4)):
                c[r.randrange(len(c))] = r.choice(["x", "Y", "w1"])
            texts.append(" ".join(c).upper() if r.random() < 0.2 else " ".join(c))
    r.shuffle(texts)
    got = rows(nd.near_duplicates(table(spark, texts), 85), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute(list(enumerate(texts)), 85)
    # a long chain of small changes in one group
    words, texts = [f"v{i}" for i in range(150)], []
    for i in range(120):
        texts.append(" ".join(words))
        words[(i * 7) % 150] = f"u{i}"
    got = rows(nd.near_duplicates(table(spark, texts), 85), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute(list(enumerate(texts)), 85)


def test_odd_rows(spark):
    docs = odd(spark)
    out = nd.near_duplicates(docs)
    assert out.count() == docs.count()
    by = {r.doc_id: r for r in out.collect()}
    assert by[8].component_id == 7 and not by[8].kept and by[7].kept
    assert by[1].n_shingles == 0 and by[1].component_id == 1 and by[1].kept
    assert by[None].component_id is None and by[None].kept
    kept = nd.stage(docs)
    assert kept.columns == docs.columns
    assert [r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id >= 6].count(7) == 1
    empty = spark.createDataFrame([], COLUMNS)
    assert nd.near_duplicates(empty).count() == 0 and nd.stage(empty).count() == 0
    twins = spark.createDataFrame([(None, "p q r s t u"), (None, "p q r s t u"), (4, "p q r s t u")], "doc_id long, text string")
    assert {r.component_id for r in nd.near_duplicates(twins).collect()} == {4}


def test_sketch_merges_and_estimates():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**63, 900, dtype=np.uint64)
    a, b = np.unique(x[:800]), np.unique(x[50:])
    both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
    ra, rb, rab = nd.registers([a, b, np.union1d(a, b)])
    assert (np.maximum(ra, rb) == rab).all()
    est, keep = nd.likely(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]), 0.85)
    assert abs(est[0] - both / either) < 0.12 and keep[0]
    far = np.unique(np.concatenate([x[:300], r.integers(0, 2**63, 500, dtype=np.uint64)]))
    assert not nd.likely(ra[None], nd.registers([far]), np.array([800]), np.array([len(far)]), 0.85)[1][0]


def test_components(spark):
    edges = [(1, 2), (3, 2), (9, 8), (8, 7), (7, 6), (6, 5), (20, 20)] + [(100, i) for i in range(101, 160)]
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    assert got[3] == 1 and got[9] == 5 and got[20] == 20 and got[159] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_tables_for_stars(spark, monkeypatch):
    """Each step leaves its plan and its tasks in the driver's memory, so a few stars that share leaves must not take many."""
    r, written = random.Random(3), []
    monkeypatch.setattr(cc, "cut", lambda df: written.append(cut(df)) or written[-1])
    components(spark.createDataFrame([(c, r.randrange(5000)) for c in r.sample(range(5000), 6) for _ in range(300)], "a long, b long"))
    assert len(written) <= 8


def test_merged_groups(spark):
    r = random.Random(5)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1100)]
    top = {i: i for pair in links for i in pair}
    for a, b in links * 200:
        top[a] = top[b] = min(top[a], top[b])
    ids = spark.createDataFrame([(i,) for i in top], "id long")
    comp = ids.selectExpr("id", "id AS comp")
    for part in (links[:200], links[200:], []):
        comp = merged(comp, spark.createDataFrame(part, "a long, b long"))
    assert dict(rows(comp)) == top == dict(rows(components(spark.createDataFrame(links, "a long, b long"))))


def test_repeated_ids_and_changed_texts(spark):
    words = [f"w{i}" for i in range(300)]
    a, b = " ".join(words), " ".join(f"v{i}" for i in range(300))
    data = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (9, "q r s t u v"), (9, None), (9, ""), (8, "q r s t u v"), (7, a), (7, "alone here now and then"), (6, "alone here now and then")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = rows(nd.near_duplicates(docs), "doc_id", "component_id")
    want = {1: {1}, 2: {1}, 3: {1}, 7: {1}, 6: {1}, 8: {8}, 9: {8, 9}}
    assert len(got) == len(data) and all(c in want[d] for d, c in got)
    assert sorted(c for d, c in got if d == 9) == [8, 9, 9]
    more = spark.createDataFrame([(i, a if i % 3 else a + f" z{i}") for i in range(600)], "doc_id long, text string")
    assert {c for _, c in rows(nd.near_duplicates(more), "doc_id", "component_id")} == {0}


def templates(r, n, own):
    """Texts of two templates with words of their own, some of them near each other."""
    heads = [[f"h{k}x{i}" for i in range(90)] for k in range(2)]
    texts = []
    for _ in range(n):
        w = heads[r.randrange(2)] + [f"w{r.randrange(own)}" for _ in range(20)]
        texts.append(" ".join(w))
        if r.random() < 0.3:
            w[r.randrange(90)] = "x"
            texts.append(" ".join(w))
    return texts


def test_templates_against_all_pairs(spark, monkeypatch):
    r = random.Random(9)
    for own, most in ((10**6, 64), (12, 64), (12, 1)):
        monkeypatch.setattr(nd, "LIST", most)  # with 1, every list goes by blocks
        texts = templates(r, 60, own)
        got = rows(nd.near_duplicates(table(spark, texts), 85), "doc_id", "n_shingles", "component_id", "kept")
        assert got == brute(list(enumerate(texts)), 85)


def test_index_holds_every_similar_pair(spark):
    r = random.Random(4)
    made = []
    for _ in range(60):
        base = set(r.sample(range(400), r.randrange(5, 80)))
        made.append(base)
        for _ in range(3):
            made.append((base | set(r.sample(range(400), r.randrange(0, 8)))) - set(r.sample(sorted(base), r.randrange(0, min(8, len(base))))))
    made = [np.array(sorted(s), np.int64) for s in {frozenset(m) for m in made} if s]
    sets = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(made)], "id long, set binary")
    some = spark.createDataFrame([(i, len(s)) for i, s in enumerate(made)], "id long, n long")
    lists = {}
    for e in nd._prefixes(some, sets, 85).collect():
        lists.setdefault(e.shingle, []).append((e.id, e.probe))
    met = {frozenset((a, b)) for own in lists.values() for a, p in own for b, q in own if a != b and (p or q)}
    n_links = 0
    for i, a in enumerate(made):
        for j in range(i):
            c = len(np.intersect1d(a, made[j]))
            if 100 * c >= 85 * (len(a) + len(made[j]) - c):
                n_links += 1
                assert frozenset((i, j)) in met
    assert n_links > 20 and len(met) < len(made) ** 2 / 4


def test_template_texts_list_nothing(spark):
    r = random.Random(5)
    head = " ".join(f"h{i}" for i in range(90))
    texts = [f"{head} " + " ".join(f"w{r.randrange(10**9)}" for _ in range(20)) for _ in range(300)]
    sets = table(spark, texts).selectExpr("cast(text as binary) as text").mapInArrow(nd._sets, "id long, set binary")
    some = sets.selectExpr("id", "cast(length(set) / 8 as long) as n")
    assert nd._prefixes(some, sets, 85).count() == 0


def test_parts_cover_columns_and_likelihoods_agree(monkeypatch):
    monkeypatch.setattr(nd, "PART", 10)
    texts = [b"abc", None, b"", b"x" * 100, b"y" * 9, b"z", None]
    found = list(nd._parts(pa.array(texts, pa.binary())))
    assert [i for lo, hi in found for i in range(lo, hi)] == list(range(len(texts))) and len(found) == 3
    assert list(nd._parts(pa.array([], pa.binary()))) == []
    r = np.random.default_rng(1)
    a, b = (r.integers(0, 3, (50, len(nd.FACTORS))).astype(np.uint16) for _ in range(2))
    na, nb = (r.integers(1, 9, 50).astype(float) for _ in range(2))
    whole = nd.likely(a, b, na, nb, 0.5)
    monkeypatch.setattr(nd, "PAIRS", 7)
    assert all((x == y).all() for x, y in zip(whole, nd.likely(a, b, na, nb, 0.5), strict=True))

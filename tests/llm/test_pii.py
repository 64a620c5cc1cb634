import hashlib
import random
import re

from gradeworks.llm import pii

from .common import COLUMNS, odd, rows, table


def plain(t):
    t = t or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_base_spans():
    r = random.Random(6)
    for _ in range(3000):
        t = "".join(r.choice(["a", "@", ".", "-", "b.c", "1", "22", "300", "+4", " ", "(", "é", "4111 1111 1111 1111", "+49 30 123456", "x@y.z"]) for _ in range(r.randrange(1, 30)))
        assert pii.base_spans(t) == plain(t), t
    assert pii.base_spans("a" * 200_000 + "@") == [] and pii.base_spans("1" * 200_000) == []


def test_query_and_stage(spark):
    calls = [f"Call me, phone: 030-{r}-{r + 1} today." for r in range(1000, 1040)]
    texts = [*calls, "mail a.b@c.de and +1 (415) 555-2671", "order 030-1000-2000", "\U0001f600 10.0.0.255 x", None, ""]
    docs = table(spark, texts)
    got = {x.doc_id: x for x in pii.personal(docs).collect()}
    for i, t in enumerate(texts):
        base = sorted(plain(t), key=lambda s: (pii.BASE.index(s[0]), s[1]))
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert all(x in got[i].spans for x in text.split(","))
    assert "phone_local:" in got[0].spans and got[41].spans == ""
    clean = {x.doc_id: x for x in pii.stage(docs).collect()}
    assert clean[0].text == "Call me, phone: [PHONE_LOCAL] today." and clean[0].n_chars == len(clean[0].text)
    assert clean[40].text == "mail [EMAIL] and [PHONE]" and clean[42].text == "\U0001f600 [IP] x" and clean[43].text is None


def test_odd_rows(spark):
    docs = odd(spark)
    assert pii.personal(docs).count() == docs.count()
    out = pii.stage(docs)
    assert out.columns == docs.columns and rows(out.select("doc_id", "text")) == rows(docs.select("doc_id", "text"))
    empty = spark.createDataFrame([], COLUMNS)
    assert pii.personal(empty).count() == 0 and pii.stage(empty).count() == 0


def test_spans_beyond_the_base_patterns(spark):
    r = random.Random(2)
    names, titles = ["Alice Moreau", "Peter Schmidt", "Carmen Ruiz", "John B. Smith"], ["Dr. Okafor Bello", "Frau Lindner Weiss"]
    streets = ["12 Harbour Road", "Gartenstraße 14", "8 rue des Lilas", "Calle de Alcalá 33"]
    good, texts = [], []
    for i in range(240):
        parts = [f"Customer name {r.choice(names)} signed.", f"dear {r.choice(titles)} yes", f"She lives at {r.choice(streets)} now.", f"born {r.randrange(1, 28)}.{r.randrange(1, 12)}.19{r.randrange(40, 99)} there", f"tel: 030 {r.randrange(1000, 9999)} {r.randrange(1000, 9999)} ok"]
        text = parts[i % 5]
        hit = [*names, *titles, *streets]
        s = next((x for x in hit if x in text), None) or re.search(r"[0-9]+\.[0-9]+\.19[0-9]+|030 [0-9]+ [0-9]+", text)[0]
        good.append((text.index(s), text.index(s) + len(s)))
        texts.append(text)
    clean = ["The The of Of Of For For.", "version 12.11.1999 of the build", "order 030 1234 5678 shipped", "Blue Harbour met Green Stone", "item 1999-12-11 released", "page 030 1111 2222"] * 10
    got = {x.doc_id: x.spans for x in pii.personal(table(spark, texts + clean)).collect()}
    found = {i: [tuple(map(int, s.split(":")[1:])) for s in got[i].split(",") if s] for i in got}
    true = sum(good[i] in found[i] for i in range(240))
    every = sum(len(found[i]) for i in found)
    assert true >= 0.95 * 240 and true >= 0.95 * every, (true, every)
    assert not any(found[i] for i in range(240, 300))

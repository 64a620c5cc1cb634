import hashlib
import random

import numpy as np
import pytest

from gradeworks.llm import byte_bpe
from gradeworks.llm import queries as Q

from .common import COLUMNS, odd, table

public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = public.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("plain", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(PATH, public.PATTERN)


def each(encoder, texts):
    ids, n = encoder([t.encode() for t in texts])
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_random_texts(encoder, plain):
    r = random.Random(5)
    signs = [*"ab 's1.,-\n\t\x0b\x1c\x85\xa0 　é×漢字🙂ﬁßЖ́'\"A", " the", "  ", "tion", "aaaa", "'ll", "don't"]
    for _ in range(1500):
        texts = ["".join(r.choices(signs, k=r.randrange(0, 90))) for _ in range(3)]
        assert each(encoder, texts) == [plain.encode_ordinary(t) for t in texts]


def test_every_character_beside_others(encoder, plain):
    for block in range(0, 0x110000, 0x1000):
        chars = [chr(c) for c in range(block, block + 0x1000) if not 0xD800 <= c < 0xE000]
        if chars:
            text = "".join(f"a{c}{c} {c}1'{c}," for c in chars)
            assert each(encoder, [text]) == [plain.encode_ordinary(text)]


def test_long_pieces_by_halves(encoder, plain):
    r = random.Random(1)
    for text in ("a" * 5001, "ab" * 4000 + "a", "漢字" * 2000, "".join(r.choices("abcdefgh", k=20000)), "-=" * 5000, " " * 9999 + "x", "é" * 3333):
        assert encoder.part(text.encode()) == plain.encode_ordinary(text)


def test_joins_equal_direct_merges(encoder):
    r = random.Random(2)
    m = encoder.merges
    for _ in range(3000):
        a, b = (bytes(r.choices(b"aeiounrst \xc3\xa9", k=r.randrange(1, 40))) for _ in range(2))
        assert m.join(m.merge(a), m.merge(b)) == m.merge(a + b)
        assert m.encode(a + b) == m.merge(a + b)


def test_memory_is_bounded(plain, monkeypatch):
    for name in ("MOST", "MOST_SHORT"):
        monkeypatch.setattr(byte_bpe, name, 50)
    e, r = byte_bpe.Encoder(PATH, public.PATTERN), random.Random(3)
    for _ in range(30):
        texts = ["".join(r.choices("abcdefghij ", k=300)) for _ in range(2)]
        assert each(e, texts) == [plain.encode_ordinary(t) for t in texts]
        assert max(len(e.merges.short), len(e.merges.windows)) <= 50


def test_query_round_trip(spark, tmp_path, plain):
    texts = ["Hello, wörld! It's 2024.", None, "", "  \n a", "x" * 3000, "the the the"]
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in Q.op12_byte_bpe(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        ids = plain.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_odd_rows(spark, plain):
    docs = odd(spark)
    coded = byte_bpe.encode(docs, PATH, public.PATTERN)
    back = byte_bpe.decode(coded, PATH)
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, (r["text"] or "").encode()) for r in docs.collect())
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, bytes(r["decoded"])) for r in back.collect()) == want
    assert byte_bpe.encode(spark.createDataFrame([], COLUMNS), PATH, public.PATTERN).count() == 0
    broken = spark.sql("select 1L as doc_id, cast(x'61ff62' as string) as text")
    assert np.frombuffer(byte_bpe.encode(broken, PATH, public.PATTERN).first()["ids"], "<u4").tolist() == plain.encode_ordinary("a�b")

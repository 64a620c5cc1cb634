"""Small inputs that every operator must take, and plain versions to compare with."""

import re

WORDS = re.compile("[^\x20\x09-\x0d]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS)


def odd(spark):
    """Null, empty and blank texts, a long one, a repeated row, a row of nulls, and columns with clashing names."""
    texts = [None, "", " \n\t ", "one", "two words", "word " * 20000, "x" * 50000, "a b c d e f g", "a b c d e f g", "ünïcode \U0001f600 text"]
    docs = table(spark, texts)
    docs = docs.union(docs.where("doc_id = 7")).union(spark.createDataFrame([(None, None, None, None, None)], COLUMNS))
    for name in ("row", "words", "n", "id", "hash", "score", "kept", "start"):
        docs = docs.selectExpr("*", f"'{name}' as `{name}`")
    return docs


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect()), key=lambda r: [(x is None, str(type(x)), x if not isinstance(x, list) else str(x)) for x in r])

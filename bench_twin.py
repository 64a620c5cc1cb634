"""Overlap scores of the same pairs by plain Python in one process, to set beside ``bench.py``; prints pairs a second."""

from __future__ import annotations

import json
import math
import os
import re
import time
from collections import Counter

import pyarrow.parquet as pq

PAIRS = 400


def tokens(t: str) -> list[str]:
    return re.sub(r"[^a-zа-яё0-9\s]", " ", t.lower()).split()


def shared(a: list | str, b: list | str, n: int) -> tuple[int, int, int]:
    x, y = (Counter(tuple(s[i : i + n]) if isinstance(s, list) else s[i : i + n] for i in range(len(s) - n + 1)) for s in (a, b))
    return sum((x & y).values()), sum(x.values()), sum(y.values())


def rouge1(a: str, b: str) -> float:
    o, p, r = shared(tokens(a), tokens(b), 1)
    return 2 * o / (p + r) if p and r else 0.0


def bleu(a: str, b: str) -> float:
    x, y = tokens(a), tokens(b)
    if not x or not y:
        return 0.0
    c = [shared(x, y, n) for n in range(1, 5)]
    logs = sum(math.log((o + 1) / (t + 1) if t else 1 / (len(x) + 1)) for o, t, _ in c)
    return min(1.0, math.exp(logs / 4) * (1 if len(x) >= len(y) else math.exp(1 - len(y) / len(x))))


def chrf(a: str, b: str) -> float:
    out = 0.0
    for n in range(1, 7):
        o, t, r = shared(a.lower(), b.lower(), n)
        out += 1.0 if not t and not r else 0.0 if not o else 5 * (o / t) * (o / r) / (4 * o / t + o / r)
    return out / 6


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    texts = [t for t in pq.read_table(f"{path}/documents.parquet").column("text").to_pylist() if t and " " in t]
    words = [t.split(" ") for t in texts[:: max(1, len(texts) // PAIRS)]]
    pairs = [(" ".join(w[: len(w) - len(w) // 2]), " ".join(w[len(w) - len(w) // 2 :])) for w in words]
    rates = {}
    for f in (rouge1, bleu, chrf):
        began = time.time()
        for a, b in pairs:
            f(a, b)
        rates[f.__name__] = round(len(pairs) / (time.time() - began), 1)
    print(json.dumps({"metric": "pairs a second, one process", "pairs": len(pairs), "rates": rates}))


if __name__ == "__main__":
    main()

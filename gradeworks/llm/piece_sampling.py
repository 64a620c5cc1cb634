"""Distinct sampled segmentations of texts into the pieces of a SentencePiece model, and decoding."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeworks.functions.batches import parts
from gradeworks.llm.words import U, mix, prefix_sums, span_hash

MARK = "▁"
#: Bytes of texts that a task works on at a time; a longer text is taken whole.
PART = 1 << 18
#: Lattice nodes that a task remembers; beyond that it starts anew.
MOST_NODES = 1 << 19


@lru_cache(maxsize=1)
def vocabulary(model: str) -> tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of every id, the id of byte 0, and hash, id (or -1) and log weight of every prefix of a piece, by hash.

    A byte-pair model's scores are merge ranks; a piece weighs 1 / (2 + rank), so that frequent pieces are likelier.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    raw, zero, known = [], sp.piece_to_id("<0x00>"), {}
    for i in range(sp.get_piece_size()):
        special = sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
        raw.append(bytes([i - zero]) if sp.is_byte(i) else b"" if special else sp.id_to_piece(i).replace(MARK, " ").encode())
        if not special and not sp.is_byte(i):
            for n in range(1, len(raw[i])):
                known.setdefault(raw[i][:n], (-1, 0.0))
            known[raw[i]] = (i, -float(np.log(2.0 - sp.get_score(i))))
    assert all(b" " not in x.lstrip(b" ") for x in raw if x != b" "), "a piece of this model reaches from a word into the spaces after it"
    sums = prefix_sums(np.frombuffer(b"".join(known), np.uint8))
    end = np.cumsum([len(x) for x in known])
    h = span_hash(sums, end - np.array([len(x) for x in known]), end)
    order = h.argsort()
    ids, weight = (np.array([x[j] for x in known.values()]) for j in (0, 1))
    return np.array(raw, object), zero, h[order], ids[order], weight[order]


class Lattices:
    """Lattices of words: each node's outgoing pieces with the chance of each, found by sums over all paths to the end.

    A node is a byte of a word with the spaces before it. Characters that no piece has are chains of byte pieces.
    """

    def __init__(self, model: str) -> None:
        _, self.zero, self.hash, self.ids, self.weight = vocabulary(model)
        self.clear()

        # tables by 22 bits of the hash; the second, by other bits, holds what shares a place in the first
        self.slot = np.zeros((2, 1 << 22), np.int32)
        one = (self.hash >> U(42)).astype(np.int64)
        self.slot[0][one] = np.arange(len(one))
        lost = np.flatnonzero(self.slot[0][one] != np.arange(len(one)))
        two = ((self.hash[lost] >> U(20)) & U((1 << 22) - 1)).astype(np.int64)
        self.slot[1][two] = lost
        assert (self.slot[1][two] == lost).all(), "prefixes of this model need another hash"

    def clear(self) -> None:
        self.words, self.first, self.nodes = np.empty(0, U), np.empty(0, np.int64), 0
        self.parts = [np.empty(0), np.empty(0), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)]

    def place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words are, or would have to be, among the known ones, and whether they are known."""
        at = np.searchsorted(self.words, hashes)
        known = at < len(self.words)
        known[known] = self.words[at[known]] == hashes[known]
        return at, known

    def add(self, hashes: np.ndarray, buf: np.ndarray, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Lattices of the new words in buf[start:end], all at once, by ascending hash."""
        size = end - start
        first = np.cumsum(size) - size
        at = np.arange(size.sum())
        pos = at - np.repeat(first - start, size)
        rem = np.repeat(end, size) - pos
        lead = buf[pos]
        tail = (lead & 0xC0) == 0x80
        chars = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        bare = ~tail
        edge: list[tuple] = []
        live, n = np.flatnonzero(bare), 0
        while len(live):
            n += 1
            live = live[rem[live] >= n]
            h = span_hash(sums, pos[live], pos[live] + n)
            x = self.slot[0][(h >> U(42)).astype(np.int64)]
            miss = np.flatnonzero(self.hash[x] != h)
            x[miss] = self.slot[1][((h[miss] >> U(20)) & U((1 << 22) - 1)).astype(np.int64)]
            hit = self.hash[x] == h
            live, x = live[hit], x[hit]
            piece = self.ids[x] >= 0
            own, x = live[piece], x[piece]
            edge.append((own, np.full(len(own), n), self.ids[x], self.weight[x]))
            bare[own[chars[own] == n]] = False
        for own, w in ((np.flatnonzero(bare), -12.0), (np.flatnonzero(tail), 0.0)):
            edge.append((own, np.ones(len(own), int), self.zero + lead[own].astype(int), np.full(len(own), w)))
        node, step, ids, weight = (np.concatenate(c) for c in zip(*edge, strict=True))
        order = np.argsort(node, kind="stable")  # runs that ascend: merged, not sorted
        node, step, ids, weight = node[order], step[order], ids[order], weight[order]
        level = rem[node]
        by_level = np.argsort(level.astype(np.uint16) if level.max(initial=0) < 1 << 16 else level, kind="stable")
        inner = (node, step, ids)
        node, step, ids, weight, level = (x[by_level] for x in (node, step, ids, weight, level))
        beta = np.zeros(len(at) + int(step.max(initial=0)) + 1)
        value = np.empty(len(node))
        cut = np.flatnonzero(np.diff(level, prepend=0))
        final = level == step
        for lo, hi in zip(cut, [*cut[1:], len(level)], strict=True):
            v = weight[lo:hi] + np.where(final[lo:hi], 0.0, beta[node[lo:hi] + step[lo:hi]])
            heads = np.flatnonzero(np.diff(node[lo:hi], prepend=-1))
            top = np.maximum.reduceat(v, heads)
            width = np.diff(heads, append=hi - lo)
            total = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, width)), heads))
            beta[node[lo:hi][heads]] = total
            value[lo:hi] = v - np.repeat(total, width)
        (node, step, ids), ordered = inner, np.empty_like(value)
        ordered[by_level] = value
        value, final = ordered, rem[node] == step
        heads = np.flatnonzero(np.diff(node, prepend=-1))
        width = np.diff(heads, append=len(node))
        cum = np.cumsum(np.exp(value))
        cum -= np.repeat(cum[heads] - np.exp(value[heads]), width)
        cum[heads + width - 1] = 1.0
        more = (self.nodes + node + np.minimum(cum, 1.0), value, ids.astype(np.int32), np.where(final, -1, self.nodes + node + step), len(self.parts[0]) + heads)
        self.parts = [np.concatenate(x) for x in zip(self.parts, more, strict=True)]
        place = self.place(hashes)[0]
        self.words, self.first = np.insert(self.words, place, hashes), np.insert(self.first, place, self.nodes + first)
        self.nodes += len(at)

    def arrays(self) -> list[np.ndarray]:
        """Of each way on: its node plus the summed chances up to it, log chance, id, next node (or -1); and of each node its first way on."""
        return self.parts


@lru_cache(maxsize=1)
def lattices(model: str) -> Lattices:
    """The lattices that a worker's tasks share; results do not depend on what they hold."""
    return Lattices(model)


def uniform(*parts) -> np.ndarray:
    """Numbers in (0, 1) that depend on ``parts`` alone, not on where or in which order they are drawn."""
    x = np.zeros(1, U)
    for p in parts:
        x = _with(x, p)
    return _unit(x)


def _with(x: np.ndarray, part) -> np.ndarray:
    return mix(x + np.asarray(part).astype(U) * U(0x9E3779B97F4A7C15) + U(0xD1B54A32D192ED03))


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> U(12)).astype(np.float64) + 0.5) / 2.0**52


def draw(lat: Lattices, node: np.ndarray, seed: np.ndarray, salt: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One independent segmentation of each word, taken in the order ``at``: log probability, first index into the ids, ids."""
    key, logp, ids, to, _ = lat.arrays()
    steps = []
    cur = node[at]
    total, count = np.zeros(len(node)), np.zeros(len(node), np.int64)
    while len(at):
        e = np.searchsorted(key, cur + _unit(mix(seed[at] + U(salt * 0x632BE59BD9B4E019 + len(steps) * 0x9E3779B9 & 0xFFFFFFFFFFFFFFFF))))
        steps.append((at, ids[e]))
        total[at] += logp[e]
        count[at] += 1
        cur, more = to[e], to[e] >= 0
        at, cur = at[more], cur[more]
    first = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(first[-1], np.int32)
    for k, (a, i) in enumerate(steps):
        out[first[a] + k] = i
    return total, first, out


def other(lat: Lattices, node: int, taken: list[tuple[float, np.ndarray]], u: np.ndarray) -> tuple[float, np.ndarray]:
    """A segmentation of one word outside of ``taken`` (log probability, ids), by taking their mass off each step's chances."""
    _, logp, ids, to, first = lat.arrays()
    left = [(float(np.exp(p)), x) for p, x in taken]
    total, out = 0.0, []
    while node >= 0:
        lo, hi = first[node], first[node + 1] if node + 1 < len(first) else len(ids)
        chance = np.exp(logp[lo:hi])
        weight = chance.copy()
        for mass, x in left:
            weight[ids[lo:hi] == x[len(out)]] -= mass
        weight = np.where(weight > 1e-15, weight, 0.0)
        if not weight.any():  # only rounding is left
            weight = chance
        cum = np.cumsum(weight)
        e = min(int(np.searchsorted(cum, u[len(out) % len(u)] * cum[-1])), hi - lo - 1)
        left = [(mass / chance[e], x) for mass, x in left if x[len(out)] == ids[lo + e]]
        total += float(logp[lo + e])
        out.append(int(ids[lo + e]))
        node = int(to[lo + e])
    return total, np.array(out, np.int32)


def _gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def _rest(lp: np.ndarray) -> np.ndarray:
    """Log of one minus exp(lp); -inf where nothing is left."""
    p = -np.expm1(np.minimum(lp, 0.0))
    with np.errstate(divide="ignore"):
        return np.log(np.where(p > 1e-12, p, 0.0))


def search(lat: Lattices, node: np.ndarray, seed: int, draws: list, lo: int, hi: int, top: float, rests: list[np.ndarray], noise: list[np.ndarray]) -> tuple[list, float]:
    """As many segmentations as ``draws``, of the largest perturbed log probabilities, best first, and the next largest perturbation.

    Top-down search over sets of segmentations: a set is a prefix of words, a word some of whose
    segmentations are taken, and free words after it. The best set gives its best member; what is left of
    it is split by the first word that differs, each part with a Gumbel truncated at its parent's. So the
    result is an exact sample without replacement, and all its members differ. ``top`` is the Gumbel of all
    segmentations; of each draw's words, ``rests`` holds the log mass of all other segmentations and ``noise`` the Gumbels of a split there.
    """
    n, k = hi - lo, len(draws)
    lps = [d[0][lo:hi] for d in draws]
    found: list = []
    queue: list = [(top, None)]  # (largest perturbation, sets it came from)
    while queue and len(found) < k:
        best = max(range(len(queue)), key=lambda q: queue[q][0])
        value, group = queue[best]
        if value == -np.inf:
            break
        s = len(found)
        src, swap, at = np.full(n, s), {}, 0
        lp, taken = lps[s].copy(), []
        if group is None:
            queue.pop(best)
        else:
            i = int(group["g"].argmax())
            group["g"][i] = -np.inf
            queue[best] = (float(group["g"].max()), group)
            old, at = group["of"], group["from"] + i
            src[:at], lp[:at] = old["src"][:at], old["lp"][:at]
            swap = {j: w for j, w in old["swap"].items() if j < at}
            taken = group["taken"] if i == 0 else []
            taken = [*taken, (old["lp"][at], _ids(old, draws, lo, at))]
            lp[at], swap[at] = other(lat, int(node[lo + at]), taken, uniform(seed, at, 1000 + s, np.arange(1, 2 + len(taken[0][1]) * 8)))
        y = {"src": src, "swap": swap, "lp": lp}
        found.append((value, float(lp.sum()), y))
        before = np.concatenate(([0.0], np.cumsum(lp)))[at:n]
        phi = before + rests[s][lo + at : hi]
        if taken:
            phi[0] = before[0] + _rest(np.log(np.array([sum(np.exp(x) for x, _ in taken) + max(np.exp(lp[at]), 1e-300)])))[0]
        with np.errstate(divide="ignore"):
            g = phi + noise[s][lo + at : hi]
            g = np.where(np.isfinite(phi), -np.logaddexp(-value, -g), -np.inf)
        if n:
            queue.append((float(g.max()), {"g": g, "of": y, "from": at, "taken": taken}))
    return found, max((q[0] for q in queue), default=-np.inf)


def _ids(y: dict, draws: list, lo: int, i: int) -> np.ndarray:
    if i in y["swap"]:
        return y["swap"][i]
    _, first, ids = draws[y["src"][i]]
    return ids[first[lo + i] : first[lo + i + 1]]


def _joined(y: dict, draws: list, lo: int, n: int) -> np.ndarray:
    """Ids of a whole segmentation: runs of words from the same draw are taken at once."""
    parts, i = [], 0
    cuts = sorted({0, n, *(np.flatnonzero(np.diff(y["src"])) + 1).tolist(), *y["swap"], *(j + 1 for j in y["swap"])})
    for i, j in zip(cuts, cuts[1:], strict=False):
        if i in y["swap"]:
            parts.append(y["swap"][i])
        else:
            _, first, ids = draws[y["src"][i]]
            parts.append(ids[first[lo + i] : first[lo + j]])
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


def decode(ids: np.ndarray, model: str) -> bytes:
    """The text of a segmentation, in UTF-8."""
    return b"".join(vocabulary(model)[0][ids].tolist())[1:]


SCHEMA = "doc_id long, sample int, ids array<int>, ids_crc32 long, log_prob double, perturbed double, inclusion double, round_trip boolean"


def sampler(model: str, k: int):
    """A ``mapInArrow`` function over (doc_id, text) that returns up to k rows of SCHEMA per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattices(model)
        for batch in batches:
            for lo, hi in parts([batch.column(1)], PART):
                yield _sampled(lat, model, k, *(batch.column(c).slice(lo, hi - lo).to_pylist() for c in (0, 1)))

    return run


def _sampled(lat: Lattices, model: str, k: int, doc_ids: list, texts: list[bytes | None]) -> pa.RecordBatch:
    if lat.nodes > MOST_NODES:
        lat.clear()
    buf = np.frombuffer(b"".join(p for t in texts for p in (b" ", t or b"")) + b" ", np.uint8)
    begin = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    head = buf == 32
    head[1:] &= buf[:-1] != 32
    head[begin] = True
    head = np.flatnonzero(head)
    start, end = head[:-1], head[1:]  # each word with all spaces before it
    first = np.searchsorted(start, begin)
    sums = prefix_sums(buf)
    h = span_hash(sums, start, end)
    kinds, where, inverse = np.unique(h, return_index=True, return_inverse=True)
    fresh = ~lat.place(kinds)[1]
    if fresh.any():
        lat.add(kinds[fresh], buf, sums, start[where[fresh]], end[where[fresh]])
    node = lat.first[lat.place(kinds)[0]][inverse]
    by_node = np.argsort(node, kind="stable")  # equal words together, for the cache's sake
    keys = np.array([(i if i is not None else zlib.crc32(t or b"") + (1 << 40)) & 0xFFFFFFFFFFFFFFFF for i, t in zip(doc_ids, texts, strict=True)], U)
    seeds = mix(keys + U(0x2545F4914F6CDD1D))
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    unit = np.arange(len(start)) - first[row]
    own = mix(seeds[row] + mix(unit.astype(U)))
    draws = [draw(lat, node, own, s, by_node) for s in range(k)]
    base = _with(np.zeros(1, U), seeds)
    tops = _gumbel(_unit(_with(base, 1))).tolist()
    rests = [_rest(d[0]) for d in draws]
    noise = [_gumbel(_unit(_with(_with(base, 2 + s)[row], unit))) for s in range(k)]
    out: list[list] = [[] for _ in range(8)]
    for d, t in enumerate(texts):
        a, b = (int(first[d]), int(first[d + 1])) if t else (0, 0)
        if not t:
            made, limit = [(0.0, 0.0, {"src": np.empty(0, int), "swap": {}, "lp": np.empty(0)})], -np.inf
        else:
            made, limit = search(lat, node, int(seeds[d]), draws, a, b, tops[d], rests, noise)
        for s, (value, lp, y) in enumerate(made):
            ids = _joined(y, draws, a, b - a)
            inside = 1.0 if limit == -np.inf else float(-np.expm1(-np.exp(min(lp - limit, 50.0))))
            for c, v in zip(out, (doc_ids[d], s + 1, ids, zlib.crc32(ids.astype("<i4").tobytes()), lp, value, inside, decode(ids, model) == (t or b"")), strict=True):
                c.append(v)
    types = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "sample", "ids", "ids_crc32", "log_prob", "perturbed", "inclusion", "round_trip"])


def sample(docs: DataFrame, model: str, k: int = 2) -> DataFrame:
    """Up to ``k`` distinct segmentations of each row's text, drawn without replacement in proportion to their weight.

    Rows of SCHEMA: ids_crc32 is over the ids as little-endian 32-bit integers; sample 1 has the largest perturbed log probability; inclusion is the chance that a
    draw with the same threshold includes the segmentation. Seeded by doc_id (without one, by the text), so
    partitions and order don't matter. A text is one word after another, each with the run of spaces before it
    (no piece has a space after another character, which is checked); characters outside of the vocabulary are bytes. Null and
    empty texts give one row without ids; texts with fewer segmentations give fewer rows; repeated rows
    repeat their result. Empty table: no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(sampler(model, k), SCHEMA)


def decoded(samples: DataFrame, model: str) -> DataFrame:
    """``samples`` with ``text``, decoded from ``ids`` (array<int>). Null or no ids give an empty text; ids outside of the vocabulary an error."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        raw = vocabulary(model)[0]
        for part in parts:
            yield pa.array([b"".join(raw[np.asarray(x, np.int64)].tolist())[1:].decode() if x else "" for x in part.to_pylist()], pa.string())

    return samples.withColumn("text", F.arrow_udf(run, "string")("ids"))


def digest(samples: DataFrame) -> DataFrame:
    """``samples`` with the number of the ids in place of the ids."""
    return samples.select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), "ids_crc32", *[F.round(c, 6).alias(c) for c in ("log_prob", "perturbed", "inclusion")], "round_trip")


def stage(docs: DataFrame, model: str, k: int = 1) -> DataFrame:
    """The sampled segmentations of ``docs``, as ``sample`` gives them: null and empty texts one row without ids, repeated rows repeated."""
    return sample(docs, model, k)

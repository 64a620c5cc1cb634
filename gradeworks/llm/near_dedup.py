"""Near-duplicate documents by SetSketch registers, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeworks.llm.common import cut, join_counted, packed, small
from gradeworks.llm.components import components, merged
from gradeworks.llm.words import U, mix, shingles, split

#: Bands and registers in a band: at a similarity of 0.85 a pair shares no band once in two million.
BANDS, ROWS = 25, 5
#: SetSketch parameters: registers are exponents of this base, of minima with this rate.
STEP, RATE, LARGEST = 1.02, 20.0, 65534
#: Sets, and shingles in them, in a block of those that are tested against each other.
BLOCK, BLOCK_SHINGLES = 256, 500_000
#: Sets in a list of the index whose pairs are tested one by one; longer lists are cut into blocks.
LIST = 64
#: Bytes of texts or sets, and pairs of sketches, that a task works on at a time; a longer text is taken whole.
PART, PAIRS = 1 << 18, 1024
FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U)) | U(1)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The SetSketch of each non-empty set of 64-bit hashes; the sketch of a union is the larger of each register."""
    out = np.empty((len(sets), len(FACTORS)), np.uint16)
    if sets:
        at = np.cumsum([0, *(len(s) for s in sets[:-1])])
        every = np.concatenate(sets)
        for i, f in enumerate(FACTORS):
            low = (np.minimum.reduceat(every * f, at).astype(np.float64) + 0.5) / 2.0**64
            least = -np.log1p(-np.minimum(low, 1 - 1e-16)) / RATE
            out[:, i] = np.clip(np.floor(1 - np.log(least) / np.log(STEP)), 0, LARGEST)
    return out


def bands(sketches: np.ndarray) -> np.ndarray:
    """One 64-bit key for the registers of each band."""
    x = sketches.reshape(-1, BANDS, ROWS).astype(U)
    out = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=U)), x.shape[:2]).copy()
    for j in range(ROWS):
        out = mix(out + x[:, :, j] + U(1))
    return out.view(np.int64)


def _chance(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.maximum(x, 0) * (STEP - 1) / STEP) / np.log(STEP)


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Joint estimate of the similarity of sketched sets by maximum likelihood, and whether ``least`` is still plausible.

    The registers that are larger in one, in the other, and equal are a multinomial sample whose chances
    follow from the similarity and the (known) set sizes. Plausible: the likelihood at ``least`` or above
    is within a factor of e^14 of the largest (5.3 standard deviations).
    """
    runs = [_likely(*(x[i : i + PAIRS] for x in (a, b, na, nb)), least) for i in range(0, max(len(a), 1), PAIRS)]
    return tuple(np.concatenate(x) for x in zip(*runs, strict=True))


def _likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    most = np.minimum(u / (1 - u), (1 - u) / u)
    grid = np.linspace(0, 1, 201)[None, :] * most
    p, q = np.maximum(_chance(u - (1 - u) * grid), 1e-12), np.maximum(_chance((1 - u) - u * grid), 1e-12)
    fit = more * np.log(p) + less * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))
    top = np.where(grid >= least - 0.01, fit, -np.inf).max(1)
    return grid[np.arange(len(grid)), fit.argmax(1)], (most[:, 0] >= least - 1e-9) & (top >= fit.max(1) - 14)


def _parts(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of a binary column of about PART bytes, which cover it."""
    at = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        total += n
        if total >= PART:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(column):
        yield at, len(column)


def _print(s: np.ndarray) -> list[int]:
    """128 bits that identify a set."""
    return [int(x.sum(dtype=U).view(np.int64)) for x in (mix(s), mix(s ^ U(0x5851F42D4C957F2D)))]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in _parts(batch.column(1)):
            w = split(batch.column(1).slice(lo, hi - lo).to_pylist(), lower=True)
            sets = [shingles(w.hash[w.first[i] : w.first[i + 1]], 5) for i in range(hi - lo)]
            n = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(n)
            regs = registers([sets[i] for i in some])
            sk, bd, fp = [None] * len(n), [None] * len(n), np.zeros((len(n), 2), np.int64)
            for i, r, k in zip(some, regs, bands(regs), strict=True):
                sk[i], bd[i], fp[i] = r.tobytes(), k, _print(sets[i])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(fp[:, 0]), pa.array(fp[:, 1]), pa.array(sk, pa.binary()), pa.array(bd, pa.list_(pa.int64()))], ["doc_id", "n", "id", "more", "sketch", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in _parts(batch.column(0)):
            w = split(batch.column(0).slice(lo, hi - lo).to_pylist(), lower=True)
            sets = [shingles(w.hash[w.first[i] : w.first[i + 1]], 5) for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([pa.array([_print(x)[0] if len(x) else 0 for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "set"])


def _plausible(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, len(FACTORS)) for c in ("sketch_a", "sketch_b"))
                _, keep = likely(a, b, *(batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b")), least)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        common, total = [], []
        for pair in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            x, y = (np.frombuffer(s.as_buffer(), U) for s in pair)
            common.append(len(np.intersect1d(x, y, assume_unique=True)))
            total.append(len(x) + len(y) - common[-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "common", "total"])


def _crossed(percent: int):
    """Links between two blocks of documents, one for each two groups that are linked in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                x, y = x.as_py(), y.as_py()
                group: dict[int, int] = {}

                def top(g: int, group: dict = group) -> int:
                    while group.setdefault(g, g) != g:
                        g = group[g]
                    return g

                a, b = (np.frombuffer(b"".join(m["sketch"] for m in z), np.uint16).reshape(-1, len(FACTORS)) for z in (x, y))
                na, nb = (np.array([m["n"] for m in z], float) for z in (x, y))
                ga, gb = (np.array([m["comp"] for m in z]) for z in (x, y))
                sets: dict[int, np.ndarray] = {}
                for i in range(len(x)):
                    close = np.flatnonzero((np.minimum(na[i], nb) * 100 >= np.maximum(na[i], nb) * percent) & (gb != ga[i]))
                    if len(close):
                        _, keep = likely(np.broadcast_to(a[i], (len(close), a.shape[1])), b[close], np.full(len(close), na[i]), nb[close], percent / 100)
                        for j in close[keep].tolist():
                            p, q = top(x[i]["comp"]), top(y[j]["comp"])
                            if p != q:
                                s, t = (sets.setdefault(m["id"], np.frombuffer(m["set"], U)) for m in (x[i], y[j]))
                                common = len(np.intersect1d(s, t, assume_unique=True))
                                if common * 100 >= (len(s) + len(t) - common) * percent:
                                    out.append((x[i]["id"], y[j]["id"]))
                                    group[p] = q
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in _parts(batch.column(2)):
            sets = [np.frombuffer(s, np.int64) for s in batch.column(2).slice(lo, hi - lo).to_pylist()]
            own = [np.repeat(batch.column(c).slice(lo, hi - lo).to_numpy(), [len(s) for s in sets]) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(own[0]), pa.array(own[1]), pa.array(np.concatenate(sets))], ["id", "n", "shingle"])


def _prefixes(some: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, shingle, probe): an index of ``some`` sets (id, n) in which every two that are similar enough share a shingle that one of them probes.

    In an order of all shingles by rarity, the first one that two sets share has at least as many shingles of each
    set from there on as the two have in common. The smaller set, of n shingles, shares 2tn/(1+t) at least and
    probes those before; the larger one, of m, shares tm at least and lists those before. A shingle of one set
    alone comes first and is listed nowhere, so a set made of a common template and enough words of its own lists none.
    """
    rows = some.join(sets, "id").select("id", "n", "set").mapInArrow(_shingled, "id long, n long, shingle long")
    counts = rows.groupBy("shingle").agg(F.count("*").alias("rows")).where("rows > 1").withColumn("df", F.col("rows"))
    total = some.agg(F.sum("n")).first()[0]
    shared = join_counted(rows, counts, ["shingle"], total)
    own = Window.partitionBy("id")
    ranked = shared.withColumn("k", F.count("*").over(own)).where(F.col("k") * 100 >= F.col("n") * percent).withColumn("at", F.row_number().over(own.orderBy("df", "shingle")))
    long = F.col("k") + 1 - F.ceil(F.col("n") * percent / 100 - 1e-9)
    short = F.col("k") + 1 - F.ceil(F.col("n") * (2 * percent) / (100 + percent) - 1e-9)
    return ranked.where(F.col("at") <= long).select("id", "shingle", (F.col("at") <= short).alias("probe"))


def _grid(apart: DataFrame, nodes: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between groups of ``apart`` (id, comp, band and its centre), by blocks of about BLOCK sets that share a band."""
    cluster = components(apart.select(F.col("id").alias("a"), F.col("centre").alias("b"))).select("id", F.col("comp").alias("cluster"))
    rest = cut(apart.select("id", "comp").distinct().join(cluster, "id").join(nodes.select("id", "n"), "id"))
    blocks = lambda size, n: F.greatest(F.ceil(size / BLOCK), F.ceil(n / BLOCK_SHINGLES))
    sizes = rest.groupBy("cluster", "comp").agg(F.count("*").alias("size"), F.sum("n").alias("length"))
    sizes = sizes.withColumn("own", (F.col("size") >= BLOCK) | (F.col("length") >= BLOCK_SHINGLES))
    few = sizes.where("not own").groupBy("cluster").agg(blocks(F.sum("size"), F.sum("length")).alias("few"))
    many = rest.join(sizes, ["cluster", "comp"]).join(few, "cluster", "left")
    block = F.when(F.col("own"), F.xxhash64("comp", F.pmod(F.xxhash64("id"), blocks(F.col("size"), F.col("length"))))).otherwise(F.xxhash64("cluster", F.pmod(F.xxhash64("comp"), F.col("few"))))
    placed = cut(many.select("id", "comp", F.when(F.col("own"), F.col("comp")).alias("pure"), block.alias("block")))
    packs = cut(placed.join(sketches, "id").join(sets, "id").groupBy("block").agg(F.collect_list(F.struct("id", "comp", "n", "sketch", "set")).alias("pack")))
    met = cut(apart.select("id", "band").join(placed.select("id", "pure", "block"), "id").groupBy("band", "block").agg(F.first("pure").alias("pure")))
    grid = met.select("band", F.col("block").alias("x"), F.col("pure").alias("p")).join(met.select("band", F.col("block").alias("y"), F.col("pure").alias("q")), "band")
    grid = grid.where((F.col("x") <= F.col("y")) & ~F.coalesce(F.col("p") == F.col("q"), F.lit(False))).select("x", "y").distinct()
    for x in "xy":
        grid = grid.join(packs.select(F.col("block").alias(x), F.col("pack").alias(f"pack_{x}")), x)
    return cut(grid.select("pack_x", "pack_y").mapInArrow(_crossed(percent), "a long, b long"))


def near_duplicates(docs: DataFrame, percent: int = 85, star_rounds: int = 3) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of at least ``percent`` / 100 of their 5-word shingle sets.

    One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable), kept.
    The graph's nodes are the distinct sets; rows that repeat a doc_id with different texts link their sets.
    Sets that share a band of SetSketch registers are candidates: they are
    tested against a centre of their band first: the smallest id, then the one that shares most bands, then
    any. What those links leave apart within a band goes into an index of rare shingles (``_prefixes``), in which similar sets
    must meet: texts of one template don't, however many they are. Sets of short lists are tested pair by pair, long
    lists are cut into blocks of about BLOCK sets and blocks that share a list are tested against each other, so no
    candidate link between groups is left untested and none within a group is needed. Tested means: a plausible
    joint likelihood of the sketches, then the full sets.

    Null and empty texts (and those of white space only): n_shingles 0, linked with nothing, kept. Rows
    without doc_id take part; their component_id is the smallest doc_id linked, else null, and they are kept
    only if it is null. Rows that repeat a doc_id are one document. Empty table: no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    sigs = cut(docs.mapInArrow(_sketch, "doc_id long, n long, id long, more long, sketch binary, bands array<long>"))
    full = sigs.where("n > 0")
    # the set's 128 bits tell sets apart; its first 64 name it
    nodes = cut(full.groupBy("id", "more").agg(F.count("*").alias("rows"), F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")))
    several = full.where("doc_id is not null").groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("doc_id", "a")
    same_doc = cut(full.select("doc_id", F.col("id").alias("b")).join(several, "doc_id").where("a <> b").select("a", "b").distinct())
    dealt = nodes.select("id", F.explode("bands").alias("band"))
    crowded = dealt.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band")
    shared = cut(dealt.join(crowded, "band"))
    ids = cut(shared.select("id").distinct())
    # the text of a set is that of one of its rows: of those of its smallest doc_id, or of any without one
    lead = nodes.join(ids, "id", "left_semi").select("doc").distinct()
    known = docs.join(small(lead.where("doc is not null").select(F.col("doc").alias("doc_id")), ids.count()), "doc_id", "left_semi").select("text")
    fresh = known.union(docs.where("doc_id is null").select("text")).mapInArrow(_sets, "id long, set binary").join(ids, "id", "left_semi")
    sets = cut(fresh.groupBy("id").agg(F.first("set").alias("set")))
    sketches = nodes.select("id", "n", "sketch")

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = (sketches.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
        likely_ = pairs.join(a, "a").join(b, "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_plausible(percent / 100), "a long, b long")
        a, b = (sets.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
        found = likely_.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(_shared, "a long, b long, common long, total long")
        return found.where(F.col("common") * 100 >= F.col("total") * percent).select("a", "b")

    degree = cut(shared.join(shared.groupBy("band").agg(F.count("*").alias("c")), "band").groupBy("id").agg(F.sum("c").alias("degree")))
    comp = ids.select("id", F.col("id").alias("comp"))
    if not same_doc.isEmpty():  # sets that one document links may share no band
        linked = same_doc.select(F.explode(F.array("a", "b")).alias("id"))
        comp = ids.union(linked).distinct().select("id", F.col("id").alias("comp"))
        comp = merged(cut(comp), same_doc)
    for turn in range(star_rounds):
        member = shared.join(comp, "id").join(degree, "id")
        best = [-F.col("id"), F.struct("degree", "id"), F.xxhash64("id", F.lit(turn))][min(turn, 2)]
        mixed = member.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max_by("id", best).alias("centre")).where("lo <> hi").select("band", "centre")
        to = comp.select(F.col("id").alias("centre"), F.col("comp").alias("other"))
        pairs = member.join(mixed, "band").join(to, "centre").where("comp <> other").select("id", "centre")
        if turn == 0:
            pairs = pairs.groupBy("id").agg(F.min("centre").alias("centre"))
        pairs = cut(pairs.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct())
        if pairs.isEmpty():
            break
        new = cut(verified(pairs))
        if not new.isEmpty():
            comp = merged(comp, new)
    member = shared.join(comp, "id")
    mixed = member.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    ids_apart = cut(member.join(mixed.select("band"), "band").select("id").distinct())
    entries = cut(_prefixes(ids_apart.join(nodes.select("id", "n"), "id"), sets, percent)) if not ids_apart.isEmpty() else None
    if entries is not None and not entries.isEmpty():
        long = F.col("members") > LIST
        by_list = entries.groupBy("shingle").agg(F.count("*").alias("members")).where("members > 1")
        listed = entries.join(by_list, "shingle").join(comp, "id")
        # short lists: those that probe meet the others
        few = listed.where(~long)
        probe, other = few.where("probe").select("shingle", F.col("id").alias("p"), F.col("comp").alias("pc")), few.select("shingle", F.col("id").alias("q"), F.col("comp").alias("qc"))
        pairs = probe.join(other, "shingle").where("pc <> qc").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
        new = cut(verified(pairs))
        if not new.isEmpty():
            comp = merged(comp, new)
        member = entries.join(by_list.where(long).select("shingle"), "shingle").join(comp, "id").withColumnRenamed("shingle", "band")
        mixed = member.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("id").alias("centre"), F.max("probe").alias("probe")).where("lo <> hi and probe").select("band", "centre")
        apart = cut(member.join(mixed, "band").select("id", "comp", "centre", "band"))
        new = _grid(apart, nodes, sketches, sets, percent) if not apart.isEmpty() else None
        if new is not None and not new.isEmpty():
            comp = merged(comp, new)
    of = cut(nodes.join(comp, "id", "left").select("id", "rows", "doc", F.coalesce("comp", "id").alias("comp")))
    least = of.groupBy("comp").agg(F.min("doc").alias("group"), F.count("*").alias("sets"))
    linked, alone = least.where("sets > 1").select("comp", "group"), of.select("id", "rows", F.col("doc").alias("group"), "comp")
    group_of = cut(alone.join(linked.withColumnRenamed("group", "linked"), "comp", "left").select("id", "rows", F.coalesce("linked", "group").alias("group")))
    total = max(sigs.count(), 1)
    some = sigs.select("doc_id", "n", "id")
    out = some.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("group"))
    out = out.union(join_counted(some.where("n > 0"), group_of, ["id"], total).select("doc_id", "n", "group"))
    kept = F.coalesce(F.col("doc_id") == F.col("group"), F.col("group").isNull())
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("group").alias("component_id"), kept.alias("kept"))


def stage(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one document of each group; all columns stay.

    Rows that repeat both id and text are one document, and one of them stays. Rows without an id stay, as do
    null, empty and wordless texts. An empty table gives no rows.
    """
    p = packed(docs).withColumn("hash", F.xxhash64("text"))
    found = near_duplicates(docs, percent).where("kept").select("doc_id").distinct()
    named = p.where("doc_id is not null").join(found, "doc_id", "left_semi")
    once = named.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "hash").orderBy("doc_id"))).where("nth = 1")
    return once.select("row.*").unionByName(p.where("doc_id is null").select("row.*"))

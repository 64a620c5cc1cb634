"""Merkle fixity audit of archive records: trees over key ranges, compared from the root down; and the archive files."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradeworks.llm.common import cut, join_counted

#: Key ranges of a node that its parent joins, at least.
FAN = 64
#: The same in an audit: few levels, and a node's line of children stays below a tenth of a megabyte.
WIDE = 1024
#: The columns of a node.
NODE = ["side", "none", "node"]


def record(url: Column, body: Column) -> Column:
    """The bytes of a WARC resource record."""
    body = F.coalesce(body.cast("string"), F.lit("")).cast("binary")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url.cast("string"), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def leaves(records: DataFrame) -> DataFrame:
    """(side, key, index, start, n_bytes, digest) of ``records`` (key: long, record: binary, side: boolean, false if lacking) in the order of key, then digest.

    index and start count the records and bytes of the same side before: within a range partition by a window, across
    partitions by a table of two rows per partition at most. Null keys come first.
    """
    side = F.col("side") if "side" in records.columns else F.lit(False)
    rows = records.select(side.alias("side"), F.col("key").cast("long").alias("key"), F.coalesce(F.col("record"), F.lit(b"")).alias("record"))
    rows = rows.select("side", "key", F.octet_length("record").cast("long").alias("n_bytes"), F.sha2("record", 256).alias("digest"))
    order = ["side", "key", "digest"]
    rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("part", F.shiftright("at", 33))
    sums = rows.groupBy("side", "part").agg(F.min("at").alias("at0"), F.count("*").alias("n"), F.sum("n_bytes").alias("b"))
    before = Window.partitionBy("side").orderBy("part")
    base = sums.select("side", "part", "at0", (F.sum("n").over(before) - F.col("n")).alias("n0"), (F.sum("b").over(before) - F.col("b")).alias("b0"))
    own = F.sum("n_bytes").over(Window.partitionBy("side", "part").orderBy("at")) - F.col("n_bytes")
    placed = rows.withColumn("own", own).join(base, ["side", "part"])
    return placed.select("side", "key", (F.col("n0") + F.col("at") - F.col("at0")).alias("index"), (F.col("b0") + F.col("own")).alias("start"), "n_bytes", "digest")


def _numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """``rows``, which follow each other in ``index`` within ``by``, with their number there: index less the first one's."""
    first = rows.groupBy(*by).agg(F.min("index").alias("first"), F.count("*").alias("rows"))
    return join_counted(rows, first, by, max(rows.count(), 1)).withColumn(name, F.col("index") - F.col("first")).drop("first")


def _node(levels: int, fan: int) -> list[Column]:
    """Whether a record has no key, and its lowest node: the key, or one by its bytes."""
    hashed = F.pmod(F.xxhash64("digest"), F.lit(min(fan ** (levels - 1), 2**60)).cast("long"))
    return [F.col("key").isNull().alias("none"), F.coalesce("key", hashed).alias("node")]


def tree(leaf: DataFrame, levels: int, fan: int = FAN) -> list[DataFrame]:
    """Nodes (side, none, node, start, n_bytes, digest) of each level: the lowest holds the records of each key, the last is the root of each side.

    A node stands for a range of ``fan`` ranges below it, empty ones left out. Its digest is that of its
    children's: of each its place in the range, its offset from the node's first byte, its length and its digest. So a lost,
    added or moved record changes the nodes above it and no others. The records of one key are hashed in
    chunks of ``fan`` first. Records without a key have no place: they are dealt by their digests and counted.
    The two lowest levels are written; those above have at most one node in ``fan`` squared keys and follow from them.
    """
    none = leaf.where("key is null").groupBy("side", "key", "digest").agg(F.count("*").alias("nth"), F.sum("n_bytes").alias("n_bytes")).withColumn("start", F.lit(0).cast("long"))
    keyed = _numbered(leaf.where("key is not null"), ["side", "key"], "nth").select(*none.columns)
    child = F.struct("nth", "digest", "start", "n_bytes").alias("c")
    chunk = F.when(F.col("key").isNotNull(), F.floor(F.col("nth") / fan)).otherwise(0).alias("chunk")
    line = lambda c: F.concat_ws(":", c["nth"].cast("string"), (c["start"] - F.col("start")).cast("string"), c["n_bytes"].cast("string"), c["digest"])
    digest = F.sha2(F.array_join(F.transform("c", line), ","), 256).alias("digest")
    sums = [F.array_sort(F.collect_list("c")).alias("c"), F.min("c.start").alias("start"), F.sum("c.n_bytes").alias("n_bytes")]
    rows = keyed.unionByName(none).select("side", *_node(levels, fan), chunk, child).groupBy(*NODE, "chunk").agg(*sums)
    rows, out = rows.select(*NODE, F.struct(F.col("chunk").alias("nth"), digest, "start", "n_bytes").alias("c")), []
    for level in range(levels + 1):
        nodes = rows.groupBy(*NODE).agg(*sums).select(*NODE, "start", "n_bytes", digest)
        out.append(cut(nodes) if level < 2 else nodes)
        up = F.floor(F.col("node") / fan).cast("long") if level < levels - 1 else F.lit(0).cast("long")
        none = F.col("none") if level < levels - 1 else F.lit(False)
        nth = (F.col("node") * 2 + F.col("none").cast("int")).alias("nth")
        rows = out[-1].select("side", none.alias("none"), up.alias("up"), F.struct(nth, "digest", "start", "n_bytes").alias("c")).withColumnRenamed("up", "node")
    return out


def differing(levels: list[DataFrame], fan: int = FAN) -> DataFrame:
    """(none, node) of the keys whose records differ between the sides: from the roots down, only children of differing nodes are compared."""
    bad, last = None, len(levels) - 1
    for level in range(last, -1, -1):
        nodes = levels[level]
        if bad is not None:
            whole = level == last - 1  # the root's children all have the same parent
            up = F.lit(0).cast("long") if whole else F.floor(F.col("node") / fan).cast("long")
            none = F.lit(False) if whole else F.col("none")
            parent = bad.select(F.col("none").alias("p"), F.col("node").alias("up"))
            nodes = nodes.withColumn("p", none).withColumn("up", up).join(parent, ["p", "up"], "left_semi")
        what = F.struct("n_bytes", "digest")
        ours, theirs = (F.max(F.when(F.col("side") == side, what)) for side in (False, True))
        bad = nodes.groupBy("none", "node").agg(ours.alias("ours"), theirs.alias("theirs")).where("not (ours <=> theirs)").select("none", "node")
    return cut(bad)


def audit(records: DataFrame, replica: DataFrame, fan: int = WIDE) -> DataFrame:
    """One row per record of either side: key, record (index), start, n_bytes, digest, state.

    state: intact, altered (the replica's record of that key has other bytes), missing (the replica lacks
    it) or added (only the replica has it; index and start are those there). Records are told apart by key;
    those that repeat a key are paired in the order of their digests, equal ones first; those without a key
    by their bytes alone, so an altered one is missing and another added. So a lost or added record is
    located alone. Null keys come first. Null urls, bodies and records count as empty. Empty tables: no
    rows, or every record missing or added.
    """
    sides = [x.select("key", "record", F.lit(side).alias("side")) for x, side in ((records, False), (replica, True))]
    leaf = cut(leaves(sides[0].union(sides[1])))
    span = leaf.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")).first()
    levels, ranges = 1, max(abs(span["lo"] or 0), abs(span["hi"] or 0), span["n"]) + 1  # keyless records need as many nodes
    while ranges > 1:
        ranges, levels = -(-ranges // fan), levels + 1
    bad = differing(tree(leaf, levels, fan), fan)
    rows = leaf.select(*_node(levels, fan), "*")
    same = rows.where("not side").join(bad, ["none", "node"], "left_anti").withColumn("state", F.lit("intact"))
    # in keys that differ, equal records are intact; what is left of a key is paired in order
    hurt = _numbered(cut(rows.join(bad, ["none", "node"], "left_semi")), [*NODE, "digest"], "copy")
    hurt = hurt.withColumn("equal", F.count("*").over(Window.partitionBy("none", "node", "digest", "copy")) == 2)
    rest = Window.partitionBy(*NODE, "equal", F.when(F.col("none") | F.col("equal"), F.col("index"))).orderBy("index")
    hurt = hurt.withColumn("pair", F.row_number().over(rest))
    other = F.count("*").over(Window.partitionBy("none", "node", "equal", "pair", F.when(F.col("none") | F.col("equal"), F.struct("side", "index")))) == 2
    alone = F.when(F.col("side"), "added").otherwise("missing")
    hurt = hurt.withColumn("state", F.when(F.col("equal"), "intact").when(other, "altered").otherwise(alone)).where("not side or state = 'added'")
    cols = ["key", F.col("index").alias("record"), "start", "n_bytes", "digest", "state"]
    return same.select(*cols).union(hurt.select(*cols))


def write_warc(records: DataFrame, folder: str, compression: str = "none") -> None:
    """Write ``record`` (binary) of each row to files in ``folder``, by Spark's writer, so on any file system and committed as a whole.

    A record ends with a line end, as WARC records do; to others one is added, and null ones count as empty. With the
    compression ``gzip`` a file is one member of many records. An existing folder is an error; an empty table leaves
    a folder without records.
    """
    body = F.coalesce(F.col("record").cast("binary"), F.lit(b""))
    ended = F.substring(body, -2, 2) == F.lit(b"\r\n")
    text = F.when(ended, F.substring(body, F.lit(1), F.octet_length(body) - 2)).otherwise(body)
    # the text writer puts the bytes of a string down as they are and ends each with the line end
    records.select(text.cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", compression).text(folder)


#: Where a record may begin after a damaged one, and a gzip member.
START, MEMBER = b"\r\n\r\nWARC/1.", b"\x1f\x8b\x08"
#: Bytes that are decompressed at a time where a member is damaged, and of records in a batch.
STEP, FULL = 1 << 14, 1 << 22


def _inflated(content: bytes, at: int) -> tuple[bytes, int, bool]:
    """The bytes of the gzip member at a place, where the next one begins, and whether it is undamaged."""
    member = zlib.decompressobj(31)
    try:
        raw = member.decompress(content[at:])
        if member.eof:
            return raw, len(content) - len(member.unused_data), True
    except zlib.error:
        member, some = zlib.decompressobj(31), []
        try:
            for i in range(at, len(content), STEP):
                some.append(member.decompress(content[i : i + STEP]))
        except zlib.error:
            pass
        raw = b"".join(some)
    after = content.find(MEMBER, at + 1)
    while after >= 0:  # the next place where a member with a record begins
        try:
            if zlib.decompressobj(31).decompress(content[after : after + STEP], 5) == b"WARC/":
                return raw, after, False
        except zlib.error:
            pass
        after = content.find(MEMBER, after + 1)
    return raw, len(content), False


def _records(raw: bytes, whole: bool) -> Iterator[tuple[int, str | None, bytes, bytes, bool]]:
    """(place, url, body, record, whole) of each record in ``raw``; after one whose length is wrong it goes on where the next one begins."""
    at = 0
    while at < len(raw):
        head, found, rest = raw[at : at + (1 << 16)].partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
        n = fields.get("Content-Length", "").strip()
        body = at + len(head) + 4
        end = body + int(n) + 4 if found and n.isdecimal() and len(n) < 16 else -1
        good = end >= 0 and raw[end - 4 : end] == b"\r\n\r\n" and raw[at : at + 7] == b"WARC/1."
        if not good:
            after = raw.find(START, at)
            end = len(raw) if after < 0 else after + 4
        yield at, fields.get("WARC-Target-URI"), raw[body : end - 4 if good else end], raw[at:end], good and (whole or end < len(raw))
        at = end


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each file, some megabytes in a batch."""
    names = ["file", "offset", "place", "size", "url", "body", "record", "whole"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.bool_()]
    rows, held = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            left, at = content.as_py(), 0
            while at < len(left):
                packed = left[at : at + 3] == MEMBER
                raw, end, fine = _inflated(left, at) if packed else (left[at:], len(left), True)
                if packed and not raw:
                    rows.append((path, at, 0, end - at, None, b"", b"", False))
                for place, url, body, one, whole in _records(raw, fine):
                    rows.append((path, at, place, end - at, url, body, one, whole) if packed else (path, at + place, 0, len(one), url, body, one, whole))
                    held += len(one)
                    if held > FULL:
                        yield out()
                        rows, held = [], 0
                at = end
    if rows:
        yield out()


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(file, offset, place, size, url, body, record, whole) of each record in the WARC files of ``folder``, packed by gzip or not.

    offset and size are those of the record's gzip member in the file, and place is where it begins within; unpacked,
    they are those of the record. A damaged member gives what can be read of it, with ``whole`` false, and reading
    goes on at the next one; so does a record whose length isn't what its header says. Several records in a
    member are told apart. Files are read through Spark, each by one task and of two gigabytes at most; names that begin
    with _ or . are no data. A folder without files gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(folder)
    return files.select("path", "content").mapInArrow(_members, "file string, offset long, place long, size long, url string, body binary, record binary, whole boolean")


def audit_files(spark: SparkSession, folder: str, replica: str) -> DataFrame:
    """``audit`` of the WARC files of two folders, by url: url, state, file, offset, place, whole of each record.

    The place is that in ``folder``, of added records that in the replica. Records that repeat url and bytes share the first
    one's place. A url that is damaged itself makes a missing record and an added one.
    """
    sides = [read_warc(spark, f).withColumn("key", F.shiftright(F.xxhash64(F.coalesce("url", F.lit(""))), 2)) for f in (folder, replica)]
    found = audit(*[x.select("key", "record") for x in sides])
    where = F.min(F.struct("file", "offset", "place", "whole", "url")).alias("w")
    places = [x.groupBy("key", F.sha2("record", 256).alias("digest")).agg(where).withColumn("replica", F.lit(r)) for x, r in zip(sides, (False, True), strict=True)]
    at = places[0].union(places[1])
    rows = found.select("key", "digest", "state", (F.col("state") == "added").alias("replica")).join(at, ["key", "digest", "replica"])
    return rows.select("w.url", "state", "w.file", "w.offset", "w.place", "w.whole")

"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where it is unset and all tasks run in this process (tests) a folder of our own is taken; on a
    cluster a folder of one machine would lose rows, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not known.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


_written: dict[str, list[str]] = {}


def drop_cuts(spark: SparkSession) -> None:
    """Delete the tables that ``cut`` wrote in this session; call it once the results that read them are written."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, as a Parquet table in the shared folder, and read it from there.

    The rows survive the loss of executors, and later steps plan with the table's real size (a
    checkpoint keeps the estimate of its plan, which squares with each join of a loop). The result may be
    lazy, so the table stays until ``drop_cuts``.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def boundary(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that the optimizer neither inlines into later steps nor computes twice."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))


def words(text: Column) -> Column:
    """Words of a text: maximal runs of characters other than ASCII white space; null has none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def small(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """Broadcast ``df`` if its counted rows (a few numbers each) are at most ``limit``; beyond that the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


#: A key that more than one in so many rows have is frequent: there can be no more such keys than this.
FREQUENT = 1000


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``left`` joined with ``right``, which has a row per key and in ``rows`` how many of the ``total`` rows of ``left`` have it.

    Rows of frequent keys stay where they are and meet a broadcast of at most FREQUENT rows; only the others are
    shuffled, so no task gets more than a small share of the rows by one key.
    """
    often = F.col("rows") * FREQUENT > total
    few = right.where(often).drop("rows")
    stay = left.join(F.broadcast(few), keys)
    move = left.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(right.where(~often).drop("rows"), keys)
    return stay.unionByName(move)


def key(text: Column) -> Column:
    """A 128-bit key of a text."""
    return F.md5(text)


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` as (row, doc_id, text): no column that a caller's table has can clash with ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

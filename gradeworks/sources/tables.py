"""Files of samples, messages, judge replies and scores: schema-bound readers, and score tables that replace one metric at a time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CALLS = "array<struct<name:string,arguments:map<string,string>>>"
#: Tables by name. Values of arguments and metadata are JSON texts, so the number 5500 and the text "5500" differ.
SCHEMAS = {
    "samples": f"sample_id long, user_input string, response string, reference string, retrieved_contexts array<string>, rubric map<string,string>, metadata map<string,string>, user_input_messages array<struct<role:string,content:string,tool_calls:{CALLS}>>, tool_calls {CALLS}, reference_tool_calls {CALLS}, reference_topics array<string>, lang string",
    "messages": f"sample_id long, turn int, role string, content string, tool_calls {CALLS}, ts timestamp",
    "judge_results": "sample_id long, metric string, step_name string, step_index int, step_type string, item_idx int, iteration int, model_id string, ok boolean, response_json string, error string, duration_ms long",
    "scores_by_model": "sample_id long, metric string, model_id string, score double",
    "scores": "sample_id long, metric string, score double, status string",
}
#: Maps whose values may be any JSON.
OPEN = ("arguments", "metadata")
BAD = "unreadable"


def _loose(kind: T.DataType, name: str = "") -> T.DataType:
    """The type to parse JSON with: any value in open maps."""
    if isinstance(kind, T.MapType) and name in OPEN:
        return T.MapType(kind.keyType, T.VariantType())
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_loose(kind.elementType, name))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _loose(f.dataType, f.name)) for f in kind.fields])
    return kind


def _texts(x: Column, kind: T.DataType, name: str = "") -> Column:
    """A column of a loose type with every open value as its JSON text."""
    if isinstance(kind, T.MapType) and name in OPEN:
        return F.transform_values(x, lambda _k, v: F.to_json(v))
    if isinstance(kind, T.ArrayType) and _loose(kind, name) != kind:
        return F.transform(x, lambda e: _texts(e, kind.elementType, name))
    if isinstance(kind, T.StructType) and _loose(kind, name) != kind:
        return F.when(x.isNotNull(), F.struct(*[_texts(x[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]))
    return x


def schema_of(table: str) -> T.StructType:
    return T._parse_datatype_string(SCHEMAS[table])


def parse_json(lines: DataFrame, table: str) -> DataFrame:
    """The columns of ``table`` from JSON texts (``value``), and unreadable: the text of a row that is no such JSON or has no sample_id, else null.

    Fields that the text lacks are null, others are ignored, blank and null texts give no row. What can be read of an
    unreadable row is kept, so one wrong field doesn't hide the others.
    """
    schema = schema_of(table)
    loose = T.StructType([*_loose(schema).fields, T.StructField("broken", T.StringType())])
    p = lines.where(F.length(F.trim("value")) > 0).select("value", F.from_json("value", loose, {"columnNameOfCorruptRecord": "broken"}).alias("p"))
    bad = F.col("p").isNull() | F.col("p.broken").isNotNull() | F.col("p.sample_id").isNull()
    return p.select(*[_texts(F.col(f"p.{f.name}"), f.dataType, f.name).alias(f.name) for f in schema.fields], F.when(bad, F.col("value")).alias(BAD))


def read_json(spark: SparkSession, path: str | list[str], table: str) -> DataFrame:
    """``parse_json`` of the lines of the files at ``path``."""
    return parse_json(spark.read.text(path), table)


def _cast(rows: DataFrame, name: str, to: T.DataType) -> Column | None:
    """A column as another type, null where a value is no such; None if no value can be."""
    x = F.col(f"`{name}`")
    if rows.schema[name].dataType == to:
        return x
    try:
        rows.select(x.try_cast(to))
    except AnalysisException:
        return None
    return x.try_cast(to)


def read_parquet(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The columns of ``table`` from Parquet files, and unreadable: JSON of the fields that don't fit their type, and of a row without sample_id.

    Columns that the files lack are null, others aren't read.
    """
    rows, schema = spark.read.parquet(path), schema_of(table)
    found = [f for f in schema.fields if f.name in rows.columns]
    made = {f.name: _cast(rows, f.name, f.dataType) for f in found}
    odd = [F.when(F.col(n).isNotNull() & (F.lit(True) if c is None else c.isNull()), F.col(n)).alias(n) for n, c in made.items() if c is None or rows.schema[n].dataType != schema[n].dataType]
    bad = F.col("sample_id").isNull() if "sample_id" in rows.columns else F.lit(True)
    for n, c in made.items():
        bad = bad | (F.col(n).isNotNull() & (F.lit(True) if c is None else c.isNull()))
    told = F.to_json(F.struct(*odd)) if odd else F.lit("{}")
    columns = [(F.lit(None) if made.get(f.name) is None else made[f.name]).cast(f.dataType).alias(f.name) for f in schema.fields]
    return rows.select(*columns, F.when(bad, told).alias(BAD))


def readable(rows: DataFrame) -> DataFrame:
    """The rows of a reader that fit, without the column that tells of the others."""
    return rows.where(F.col(BAD).isNull()).drop(BAD)


def write_scores(scores: DataFrame, path: str, table: str = "scores") -> None:
    """Write a score table, a folder per metric; the metrics that ``scores`` has rows of are replaced, all others stay as they are.

    Rows are rebalanced by metric, so a metric of many rows is written by many tasks and a small one as one file.
    """
    names = [f.name for f in schema_of(table).fields]
    rows = scores.select(*[F.col(n).cast(schema_of(table)[n].dataType) if n in scores.columns else F.lit(None).cast(schema_of(table)[n].dataType).alias(n) for n in names])
    rows.hint("rebalance", "metric").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("metric").parquet(path)


def read_scores(spark: SparkSession, path: str, metrics: list[str] | None = None, table: str = "scores") -> DataFrame:
    """The score table at ``path``; with ``metrics`` only their folders are read."""
    rows = spark.read.schema(SCHEMAS[table]).parquet(path)
    rows = rows.where(F.col("metric").isin(metrics)) if metrics is not None else rows
    return rows.select(*[f.name for f in schema_of(table).fields])

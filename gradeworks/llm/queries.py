"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeworks.llm import byte_bpe, codebooks, decontaminate, fixity, near_dedup, pii, piece_sampling, quality, repeats, secrets, token_files, toxicity, whitening
from pyspark.sql import functions as F


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.digest(piece_sampling.sample(_docs(spark, sf_dir), tokenizer("piece_bpe_32k.model"), 2))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    spans = F.transform("offending", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")))
    return out.withColumn("offending", F.array_join(spans, ","))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(_docs(spark, sf_dir))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.without_repeats(_docs(spark, sf_dir), 35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_docs(spark, sf_dir))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal(_docs(spark, sf_dir))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 80)
    return out.withColumn("item_ids", F.array_join(F.col("item_ids").cast("array<string>"), ","))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_docs(spark, sf_dir), 85)


def op9_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as archive records against a replica with overwritten first characters, lost records and added ones."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    one = pages.select(F.col("page_id").alias("key"), fixity.record(F.col("url"), F.col("html")).alias("record"))
    hurt = F.when(F.col("page_id") % 199 == 7, F.concat(F.lit("#"), F.substring("html", 2, 2**31 - 1))).otherwise(F.col("html"))
    two = pages.where("page_id % 211 <> 5").select(F.col("page_id").alias("key"), fixity.record(F.col("url"), hurt).alias("record"))
    more = pages.where("page_id % 397 = 3").select((F.col("page_id") + 10**9).alias("key"), fixity.record(F.col("url"), F.col("html")).alias("record"))
    return fixity.audit(one, two.union(more)).withColumnRenamed("key", "page_id")


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_output(_docs(spark, sf_dir), tokenizer("word_bpe_49k.json"), 2)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = byte_bpe.encode(_docs(spark, sf_dir), tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    hashed = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("ids", "decoded")]
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), *hashed)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codebooks.codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return codebooks.with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(codebooks.digest(books)).alias("codebooks_sha256"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


#: Lower-cased (A-Z only) words w of the texts of a table.
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w"
_SHINGLE = "array_to_string(w[i : i + {0} - 1], ' ')"

SQL: dict[str, str] = {
    "op7_benchmark_decontamination": f"""
        WITH item AS (
            SELECT item_id, w, len(w) AS n, greatest(len(w) - 4, 1) AS c, least(len(w), 5) AS size FROM (SELECT item_id, {_WORDS} FROM benchmark) WHERE len(w) > 0
        ), kind AS (
            SELECT item_id, n, c, size, s, count(*) AS k FROM (SELECT item_id, n, c, size, {_SHINGLE.format("size")} AS s FROM (SELECT *, unnest(range(1, c + 1)) AS i FROM item)) GROUP BY ALL
        ), doc AS (
            SELECT doc_id, {_WORDS} FROM documents
        ), place AS (
            SELECT doc_id, size, i, len(w) AS m, {_SHINGLE.format("size")} AS s
            FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM item))
        ), hit AS (
            SELECT doc_id, item_id, n, c, k, s, unnest(range(greatest(i - c + 1, 1), least(i, m - n + 1) + 1)) AS start
            FROM place JOIN kind USING (size, s) WHERE n <= m
        ), win AS (
            SELECT doc_id, item_id, c, start, sum(least(x, k)) AS shared FROM (SELECT doc_id, item_id, c, k, s, start, count(*) AS x FROM hit GROUP BY ALL) GROUP BY ALL
        ), found AS (
            SELECT doc_id, item_id, max(shared / (2 * c - shared)) AS similarity FROM win WHERE 100 * shared >= 80 * (2 * c - shared) GROUP BY ALL
        ), per AS (
            SELECT doc_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids, round(max(similarity), 6) AS similarity FROM found GROUP BY doc_id
        )
        SELECT doc_id, item_ids IS NOT NULL AS contaminated, coalesce(item_ids, '') AS item_ids, coalesce(similarity, 0.0) AS similarity FROM documents LEFT JOIN per USING (doc_id)
    """,
    "op8_minhash_near_dedup": f"""
        WITH RECURSIVE doc AS (
            SELECT doc_id, {_WORDS} FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, md5({_SHINGLE.format("5")}) AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc WHERE len(w) > 0)
        ), size AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), link AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (s) JOIN size x ON x.doc_id = a.doc_id JOIN size y ON y.doc_id = b.doc_id
            WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM size
            UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
        ), comp AS (
            SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a
        )
        SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
        FROM documents LEFT JOIN size USING (doc_id) LEFT JOIN comp USING (doc_id)
    """,
    "op4_repeated_passages": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM w WHERE len(w) >= 35
        ), g AS (
            SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS g FROM s
        ), r AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM r
        ), word AS (
            SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w
        ), kept AS (
            SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.i) AS t, count(*) AS n
            FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY word.doc_id
        )
        SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op9_merkle_fixity": """
        WITH w AS (
            SELECT page_id, html,
                'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' AS h,
                chr(13) || chr(10) || chr(13) || chr(10) AS e, coalesce(html, '') AS a,
                CASE WHEN page_id % 199 = 7 THEN '#' || substr(html, 2) ELSE coalesce(html, '') END AS b
            FROM pages
        ), one AS (
            SELECT page_id, strlen(h || strlen(a) || e || a || e) AS n_bytes, sha256(h || strlen(a) || e || a || e) AS digest FROM w
        ), two AS (
            SELECT page_id, strlen(h || strlen(b) || e || b || e) AS n_bytes, sha256(h || strlen(b) || e || b || e) AS digest FROM w WHERE page_id % 211 <> 5
            UNION ALL SELECT page_id + 1000000000, strlen(h || strlen(a) || e || a || e), sha256(h || strlen(a) || e || a || e) FROM w WHERE page_id % 397 = 3
        ), o AS (
            SELECT *, row_number() OVER (ORDER BY page_id) - 1 AS record, CAST(sum(n_bytes) OVER (ORDER BY page_id) - n_bytes AS BIGINT) AS start FROM one
        ), t AS (
            SELECT *, row_number() OVER (ORDER BY page_id) - 1 AS record, CAST(sum(n_bytes) OVER (ORDER BY page_id) - n_bytes AS BIGINT) AS start FROM two
        )
        SELECT coalesce(o.page_id, t.page_id) AS page_id, coalesce(o.record, t.record) AS record, coalesce(o.start, t.start) AS start,
            coalesce(o.n_bytes, t.n_bytes) AS n_bytes, coalesce(o.digest, t.digest) AS digest,
            CASE WHEN t.page_id IS NULL THEN 'missing' WHEN o.page_id IS NULL THEN 'added' WHEN o.digest = t.digest THEN 'intact' ELSE 'altered' END AS state
        FROM o FULL JOIN t ON o.page_id = t.page_id
    """,
}

"""Queries of the operators over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltweave.llm import bpe, jaccard, lines, media, packing, perplexity, pii, quality, sharding, substrings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(spark, _table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(spark, _table(spark, sf_dir, "documents"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of each text, and the digest of what they are decoded to."""
    return bpe.recoded(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids", F.md5("decoded").alias("digest"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(spark, _table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, quality.grades_of(_table(spark, sf_dir, "labels")))
    return quality.score(docs, model).select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("tail_prob", 6).alias("tail_prob"), "keep")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    payloads = media.payload_index(pages.withColumn("type", F.lit("text/html")), "url", "html", "type")
    return media.interleave(pages, payloads, links=True)


def op9_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.rule(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_pii, op3_substrings, op4_lines, op5_bpe, op6_jaccard, op7_quality, op8_media, op9_perplexity, op10_packing)}

ORACLE_SQL = {
    "op1_sharding": """
WITH d AS (SELECT doc_id, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 4096 AS slot, coalesce(strlen(text), 0) AS b FROM documents),
s AS (SELECT r.slot, r.slot % 64 AS shard, coalesce(sum(d.b), 0) AS bytes FROM range(4096) r(slot) LEFT JOIN d ON d.slot = r.slot GROUP BY 1, 2),
m AS (SELECT sum(bytes) / 64.0 AS mean FROM s),
k AS (SELECT s.*, mean, sum(bytes) OVER (PARTITION BY shard ORDER BY bytes DESC, slot ROWS UNBOUNDED PRECEDING) AS upto FROM s, m),
j AS (SELECT *, upto <= ceil(mean * 1.02) OR upto = bytes AS stays FROM k),
room AS (SELECT e.shard, greatest(0, ceil(any_value(mean)) - coalesce(sum(bytes) FILTER (WHERE stays), 0)) AS room FROM range(64) e(shard) JOIN j ON j.shard = e.shard GROUP BY 1),
span AS (SELECT shard, sum(room) OVER (ORDER BY shard ROWS UNBOUNDED PRECEDING) AS hi, sum(room) OVER (ORDER BY shard ROWS UNBOUNDED PRECEDING) - room AS lo FROM room),
loose AS (SELECT slot, least(sum(bytes) OVER (ORDER BY bytes DESC, slot ROWS UNBOUNDED PRECEDING) - bytes // 2, (SELECT max(hi) FROM span) - 1) AS pos FROM j WHERE NOT stays),
moved AS (SELECT slot, shard FROM loose JOIN span ON pos >= lo AND pos < hi)
SELECT d.doc_id, CAST(d.slot AS INTEGER) AS slot, CAST(d.slot % 64 AS INTEGER) AS old_shard, CAST(coalesce(moved.shard, d.slot % 64) AS INTEGER) AS shard FROM d LEFT JOIN moved ON moved.slot = d.slot""",
    "op4_lines": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
r AS (SELECT *, trim(translate(line, chr(9) || chr(13) || chr(11) || chr(12), '    ')) = '' OR row_number() OVER (PARTITION BY line ORDER BY doc_id, i) = 1 AS kept FROM l),
o AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE kept), '') AS t, count(*) FILTER (WHERE NOT kept) AS n FROM r GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE o.t END AS text, CAST(coalesce(o.n, 0) AS INTEGER) AS lines_dropped FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id""",
}

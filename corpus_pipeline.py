"""A corpus pipeline: poor and toxic documents go, repeated lines go, one of near duplicates stays, personal data is masked, the rest is packed.

Defined results, of every stage: an empty table gives an empty one; columns beyond those of documents are
left out, so their names can't clash; rows with null texts or ids pass all filters, as nothing speaks against
them; repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltweave.llm import jaccard, lines, packing, pii, quality
from siltweave.session import ship_package, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _measured(df: DataFrame) -> DataFrame:
    """The columns of documents, with the texts' new lengths."""
    return df.select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else c for c in COLUMNS])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay whose probability of the highest grade is one half at least.

    Null and empty texts have the ratings' own shares of grades; without usable labels, or documents that have
    them, all stay; documents with equal texts stay or go together.
    """
    ship_package(spark)
    model = quality.train(docs, quality.grades_of(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.score(docs.select(*COLUMNS), model).filter("keep").select(*COLUMNS)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document or line holds go; documents that had words and lose all go as well.

    Null texts stay null and blank ones as they are; rows equal in id and text keep the same lines, as one document; of
    equal lines that of the smallest id stays, null ids being the smallest.
    """
    ship_package(spark)
    d = lines.dedup(spark, docs.select(*COLUMNS))
    return _measured(d.filter((F.col("lines_dropped") == 0) | F.col("text").rlike(r"[^ \t\n\x0B\f\r]")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Null and blank texts and null ids are near nothing and stay; rows that share the smallest id all stay.
    """
    ship_package(spark)
    docs = docs.select(*COLUMNS)
    return jaccard.keep_first(docs, written(jaccard.join(spark, docs), "pairs"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their types. No row goes; null texts stay null."""
    ship_package(spark)
    return _measured(pii.redact(docs.select(*COLUMNS)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, in tokens, and the training sequence and place each is in.

    A text without tokens, null included, is a piece without a sequence; repeated rows are pieces of their own.
    """
    ship_package(spark)
    return packing.pack(docs.select(*COLUMNS))


STAGES = [("quality", quality_stage), ("lines", lines_stage), ("near", near_stage), ("pii", pii_stage), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each to what the one before wrote. An empty table passes all stages."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        df = stage(spark, df, sf_dir)
        if i < len(STAGES) - 1:
            df = written(df, f"stage-{name}")
    return df

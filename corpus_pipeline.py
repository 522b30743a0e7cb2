"""Cleaning of a corpus in stages; each works on all that the one before kept.

1. `language_id`: documents whose language can't be told go.
2. `line_dedup`: later repeated runs of lines go, and documents of which nothing is left.
3. `ngram_join`: of each group of near-duplicates (five words, 0.8) one document stays.
4. `secret_scan`: secrets are replaced in the texts.
5. `packing`: the texts become sequences of tokens along a space-filling curve.

Every stage but the last returns the columns it got, whatever further ones there are, and
tells what it does with nulls and repeated rows in the docstring of its operator. Stages
that leave rows out join their decision on the id and the text, so rows that repeat both
share it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blotter.llm import jaccard, language, lines, packing, secrets
from blotter.llm.common import extras_renamed, prepare, written

#: The columns that the stages look at.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: SQL can't say the models, winnowing and tokens of these stages; tests hold them against
#: brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language; nothing else of them changes."""
    prepare(spark)
    names = docs.columns
    docs = extras_renamed(docs, *COLUMNS)
    content = F.xxhash64("text")
    slim = docs.select("doc_id", "text", "lang", "source").withColumn("_content", content)
    found = language.identify_languages(
        slim, declared="lang", host="source", keep=("_content",)
    )
    keep = found.where("kept").select(F.col("doc_id").alias("_id"), "_content").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (content == F.col("_content"))
    return docs.join(keep, same, "left_semi").toDF(*names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove later repeated runs of lines, and documents that consist of such runs only."""
    prepare(spark)
    names = docs.columns
    cut = lines.dedup_lines(extras_renamed(docs, *COLUMNS), removed="_removed_lines")
    emptied = (F.size("_removed_lines") > 0) & ~F.col("text").rlike(r"\S")
    kept = cut.where(~F.coalesce(emptied, F.lit(False)))
    return kept.drop("_removed_lines").toDF(*names)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group of near-duplicates."""
    prepare(spark)
    return jaccard.one_per_component(docs, k=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts."""
    prepare(spark)
    return secrets.redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens, with the crc of their ids."""
    prepare(spark)
    return packing.with_crc(packing.pack(docs))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("secret_scan", secret_scan),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of `sf_dir`, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to packed training sequences: five operators, one after the other.

Every stage takes rows with nulls in any column, empty and very long texts, repeated ids and rows, extra columns of any
name, and an empty table, which it passes on empty. Rows are handled one by one; equal rows fare alike unless said.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexarium.llm import mixing, neardup, packing, quality_classifier, secrets
from lexarium.llm.common import materialize, release


def _small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers by 2000, so that neither side holds tens of MB of text per task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels among them, doesn't reject. A null text is scored as an empty one; a null doc_id has no label; without labels of both classes all stay."""
    _small_batches(spark)
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): the first by doc_id. Null and empty texts, and null doc_ids, belong to no group and stay; rows that repeat a doc_id stay or go together."""
    _small_batches(spark)
    return neardup.drop_near_duplicates(docs, 80)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in text give way to a placeholder; every document stays, a null text as it is."""
    return secrets.redact_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, up to three times, and with those words, as the mix of sources takes them. Texts without a word, null ones too, have nothing to take; a null source is a source of its own; equal rows are mixed one by one."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens. A null or empty text is its end token; null doc_ids are kept."""
    _small_batches(spark)
    return packing.pack(docs, cache=200_000, chunk=4_000_000)  # workers hold the memory of the stages before


STAGES = [
    ("quality classifier", good_documents),
    ("near-duplicates", distinct_documents),
    ("secret scan", scan_secrets),
    ("mixing", mix),
    ("packing", pack),
]

#: Stages train models and run a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
        if last is not None:  # nothing reads the stage before any more
            release(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)

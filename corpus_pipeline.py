"""A training-data pipeline over ``documents``: each stage is one text operator.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, columns as they were (the
last returns the packed pieces); ``run`` writes each stage's result to the shared folder and rereads
it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlab.llm import decontaminate, near_dedup, packing, quality, secrets
from basketlab.llm.common import cut, documents, keeping, table
from basketlab.llm.queries import tokenizer_file


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return keeping(docs, ("score", "predicted"), lambda d: quality.score(d, model).where("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8."""
    return near_dedup.keep_first(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets are replaced and n_chars follows the new text."""
    clean = secrets.redact(docs)
    return clean.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("quality classifier", quality_filter),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("secret scans", secret_redaction),
    ("best-fit packing", best_fit_packing),
]

# The stages fit, hash and pack: SQL cannot say the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs

"""The corpus pipeline: from all documents to a mix of good, distinct, uncontaminated ones.

Every stage takes the rows that its predecessor kept and returns those it keeps, all columns as they were; the last
adds how often a document goes into the mix. Rows are told apart by ``doc_id`` and text: rows that repeat both are
one document from the exact stage on, rows without an id go or stay together. Every stage takes empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.llm.common import kept_rows, once, table, written
from inkmill.llm.decontam import leaked
from inkmill.llm.exact import exact_groups
from inkmill.llm.mixing import mix, word_count
from inkmill.llm.near import near_groups
from inkmill.llm.quality import classified

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably good and not toxic."""
    judged = classified(docs, table(spark, sf_dir, "labels"))
    return kept_rows(docs, judged.filter("kept").select("doc_id"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest id."""
    return once(kept_rows(docs, exact_groups(docs).filter("kept").select("doc_id")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that with the smallest id."""
    return once(kept_rows(docs, near_groups(docs).filter("kept").select("doc_id")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    leaks = leaked(docs, table(spark, sf_dir, "benchmark"))
    return kept_rows(docs, written(leaks.select("doc_id").distinct(), "leaks"), how="left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with ``copies`` and ``taken`` words. Documents of no words are left out."""
    mixed, _ = mix(docs, F.array("source"), word_count("text"))
    taken = mixed.filter("taken > 0").select(F.col("doc_id").alias("_taken_id"), "copies", "taken").distinct()
    return docs.join(taken.hint("merge"), docs["doc_id"].eqNullSafe(F.col("_taken_id"))).drop("_taken_id")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]
# The classifier is fitted in place, which SQL cannot express; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs

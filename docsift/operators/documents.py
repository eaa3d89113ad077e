"""Row-wise document steps and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.clean import clean_text, is_blank, reduction_percent, removed_keywords


def clean_documents(
    docs: DataFrame,
    lowercase: bool = True,
    remove_special_chars: bool = True,
    observation: Observation | None = None,
) -> DataFrame:
    """Add ``clean``, ``n_raw``, ``n_clean`` and ``reduction`` to documents.

    With an ``observation``, its counters report the batch while it runs. They also
    keep filters and column pruning from reaching below this step, so it is for
    callers that want the whole batch.
    """
    cleaned = docs.withColumn("clean", clean_text("text", lowercase, remove_special_chars))
    counters = [
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.length("text")).alias("raw_chars"),
        F.sum(F.length("clean")).alias("clean_chars"),
    ]
    if observation is not None:
        cleaned = cleaned.observe(observation, *counters)
    return cleaned.select(
        "*",
        F.coalesce(F.length("text"), F.lit(0)).alias("n_raw"),
        F.length("clean").alias("n_clean"),
        reduction_percent(F.col("text"), F.col("clean")).alias("reduction"),
    )


def split_blank(docs: DataFrame, column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents with content, and the skipped ones whose ``column`` is missing or blank."""
    return docs.filter(~is_blank(F.col(column))), docs.filter(is_blank(F.col(column)))


def comparison_report(docs: DataFrame, n: int = 5, head: int = 500) -> DataFrame:
    """Raw against cleaned text for the first ``n`` documents by name.

    The report is a top-k; only the rows that make it are cleaned.
    """
    first = clean_documents(docs.orderBy("filename").limit(n))
    gone = removed_keywords(F.col("text"), F.col("clean"))
    return first.select(
        "filename",
        "n_raw",
        "n_clean",
        F.round("reduction", 1).alias("reduction"),
        F.substring("text", 1, head).alias("raw_head"),
        F.substring("clean", 1, head).alias("clean_head"),
        F.array_join(gone, ", ").alias("removed"),
    )


def keyword_report(cleaned: DataFrame) -> DataFrame:
    """Every document that lost at least one reported keyword."""
    return cleaned.select(
        "filename", F.array_join(removed_keywords(F.col("text"), F.col("clean")), ", ").alias("removed")
    ).filter("removed != ''")


def cleaning_stats(cleaned: DataFrame) -> DataFrame:
    """Size of the batch before and after cleaning."""
    total = cleaned.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.sum("n_raw"), F.lit(0)).cast("long").alias("raw_chars"),
        F.coalesce(F.sum("n_clean"), F.lit(0)).cast("long").alias("clean_chars"),
    )
    share = (1 - F.col("clean_chars") / F.col("raw_chars")) * 100
    return total.withColumn("reduction", F.when(F.col("raw_chars") > 0, F.round(share, 6)).otherwise(F.lit(0.0)))

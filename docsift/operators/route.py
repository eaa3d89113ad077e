"""Confidence routing of scored documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONFIDENCE_THRESHOLD, MANUAL_CHECK
from ..functions.scoring import confidence, is_uncertain, label_name


def route(scored: DataFrame, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """Add ``confidence``, ``uncertain`` and ``route`` to rows with ``prediction`` and ``score``."""
    sure = confidence(F.col("prediction"), F.col("score"))
    rows = scored.withColumn("confidence", sure).withColumn("uncertain", is_uncertain(F.col("confidence"), threshold))
    target = F.when(F.col("uncertain"), F.lit(MANUAL_CHECK)).otherwise(label_name(F.col("prediction")))
    return rows.withColumn("route", target)


def write_routes(routed: DataFrame, path: str) -> None:
    """One folder per route."""
    routed.write.mode("overwrite").partitionBy("route").parquet(path)

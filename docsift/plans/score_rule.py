"""Fixed scoring rules, standing in for fitted models where a result has to be known beforehand."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import document_filename
from . import tables as T


def rule_score(value: Column) -> Column:
    """A score in [0, 1): small values give small scores."""
    return value / (value + 60)


def scored_files(spark: SparkSession, folder: str) -> DataFrame:
    """``filename, score, prediction`` of every event's file."""
    rows = T.table(spark, folder, "events").select(
        "event_id", document_filename(F.col("event_id")).alias("filename"), rule_score(F.col("value")).alias("score")
    )
    return rows.withColumn("prediction", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def predicted_quality(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, actual, prediction``: long documents are predicted useful."""
    docs = T.table(spark, folder, "documents").select("doc_id", "n_chars")
    rows = docs.join(T.table(spark, folder, "labels").select("doc_id", F.col("quality").alias("actual")), "doc_id")
    return rows.select("doc_id", "actual", F.when(F.col("n_chars") > 900, 1).otherwise(0).alias("prediction"))


class LinearRule(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A logistic model of ``features`` whose weights are small whole numbers by position."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        parts = F.transform(vector_to_array("features"), lambda x, i: x * (F.pmod(i * 37, F.lit(11)) - 5))
        margin = F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)
        score = 1 / (1 + F.exp(-margin / 4))
        both = dataset.withColumn("probability", array_to_vector(F.array(1 - score, score)))
        return both.withColumn("prediction", F.when(vector_to_array("probability")[1] >= 0.5, 1.0).otherwise(0.0))


def length_encoder(texts: list[str]) -> np.ndarray:
    """An encoder that knows a text's length only."""
    return np.array([[(len(text) + j) % 16 / 16 for j in range(64)] for text in texts], dtype=np.float32)

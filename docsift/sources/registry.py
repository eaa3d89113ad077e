"""Fitted artefacts: saved pipelines and the table that names them."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import in_utc
from ..functions.scoring import accuracy_text

REGISTRY = "name string, file_type string, model_type string, suffix string, accuracy double, path string, created_at timestamp"


def artifact_suffix(created_at: Column, accuracy: Column) -> Column:
    return F.concat_ws("_", F.date_format(in_utc(created_at), "yyyyMMdd_HHmmss"), accuracy_text(accuracy))


def classifier_name(file_type: Column, model_type: Column, suffix: Column) -> Column:
    return F.concat_ws("_", file_type, model_type, suffix, F.lit("classifier"))


def save_model(
    model: PipelineModel, registry: str, folder: str, file_type: str, model_type: str, accuracy: float
) -> str:
    """Save a fitted pipeline below ``folder`` and append its registry row. Returns its name."""
    spark = SparkSession.getActiveSession()
    row = spark.range(1).select(
        F.lit(file_type).alias("file_type"),
        F.lit(model_type).alias("model_type"),
        F.lit(accuracy).alias("accuracy"),
        F.current_timestamp().alias("created_at"),
    )
    row = row.withColumn("suffix", artifact_suffix(F.col("created_at"), F.col("accuracy")))
    row = row.withColumn("name", classifier_name(F.col("file_type"), F.col("model_type"), F.col("suffix")))
    saved = row.first()
    path = f"{folder.rstrip('/')}/{saved.name}"
    model.write().save(path)
    entry = [(saved.name, file_type, model_type, saved.suffix, accuracy, path, saved.created_at)]
    spark.createDataFrame(entry, REGISTRY).write.mode("append").parquet(registry)
    return saved.name


def latest_artifacts(registry: DataFrame, order: str = "created_at") -> DataFrame:
    """Newest set per file and model type, with the names of its parts.

    ``order="name"`` takes the lexicographically last name instead of the newest.
    """
    latest = registry.groupBy("file_type", "model_type").agg(
        F.max_by(F.struct("name", "suffix"), F.struct(order, "name")).alias("last")
    )
    return latest.select(
        "file_type",
        "model_type",
        F.col("last.name").alias("classifier"),
        F.concat_ws("_", "file_type", F.lit("tfidf_vocabulary"), "last.suffix").alias("tfidf"),
        F.concat_ws("_", "file_type", F.lit("scaler"), "last.suffix").alias("scaler"),
    )


def load_latest(spark: SparkSession, registry: str, file_type: str, model_type: str) -> PipelineModel | None:
    """The newest saved pipeline of a kind; None where there is none."""
    rows = spark.read.schema(REGISTRY).parquet(registry)
    rows = rows.filter((F.col("file_type") == file_type) & (F.col("model_type") == model_type))
    newest = rows.orderBy(F.desc("created_at"), F.desc("name")).limit(1).collect()
    return PipelineModel.load(newest[0].path) if newest else None

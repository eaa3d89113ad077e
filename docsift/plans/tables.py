"""The given tables in their roles: documents, labels, embeddings, feedback log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import NOT_USEFUL, USEFUL
from ..functions.paths import document_filename
from ..session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def arriving(folder: str, name: str) -> str:
    """Where a stream finds a table, be it one file or a folder of files.

    A pattern that only this name fits: a stream takes a path without one for a folder, and a file by its name is lost in
    the folder above once the table is a folder itself.
    """
    return f"{folder.rstrip('/')}/{{{name}.parquet}}"


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(arriving(folder, name))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, filename, text``, fanned out for the cleaning."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return spread(docs, "doc_id").withColumn("filename", document_filename(F.col("doc_id")))


def label_rows(spark: SparkSession, folder: str, column: str = "quality") -> DataFrame:
    """``doc_id, filename, y, label, dir`` from one of the 0/1 columns."""
    rows = table(spark, folder, "labels").select("doc_id", F.col(column).alias("y"))
    name = F.when(F.col("y") == 1, F.lit(USEFUL)).otherwise(F.lit(NOT_USEFUL))
    return rows.select(
        "doc_id", document_filename(F.col("doc_id")).alias("filename"), "y", name.alias("label"), name.alias("dir")
    )


def labelled_documents(spark: SparkSession, folder: str, column: str = "quality") -> DataFrame:
    """Documents that have a label, with ``y``."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return docs.join(label_rows(spark, folder, column).select("doc_id", "filename", "y"), "doc_id")


def embedding_cache(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def feedback_events(spark: SparkSession, folder: str) -> DataFrame:
    """The event log as reviewer decisions on files.

    Purchases and signups stand for useful, errors and clicks for not useful;
    views are no decision and stay invalid.
    """
    return decisions(table(spark, folder, "events"))


def decisions(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    decision = (
        F.when(kind.isin("purchase", "signup"), F.lit(USEFUL))
        .when(kind.isin("error", "click"), F.lit(NOT_USEFUL))
        .otherwise(kind)
    )
    return events.select(
        "event_id",
        document_filename(F.col("user_id")).alias("filename"),
        decision.alias("decision"),
        "value",
        F.col("ts").alias("at"),
    )

"""Label, prediction, text, vocabulary, report and feedback files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import label_name
from ..schemas import LABELS


def load_labels(spark: SparkSession, path: str) -> DataFrame | None:
    """The label table, or None where there is none."""
    try:
        return spark.read.schema(LABELS).csv(path, header=True)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_labels(labels: DataFrame, path: str) -> None:
    """Label files whose rows are in name order, also across files."""
    labels.select(*LABELS.names).orderBy("filename").write.mode("overwrite").csv(path, header=True)


def prediction_table(scored: DataFrame) -> DataFrame:
    """``filename, prediction, anomaly_score, label`` of scored documents."""
    return scored.select(
        "filename",
        F.col("prediction").cast("int").alias("prediction"),
        F.col("score").alias("anomaly_score"),
        label_name(F.col("prediction")).alias("label"),
    )


def write_predictions(scored: DataFrame, path: str) -> None:
    prediction_table(scored).write.mode("overwrite").csv(path, header=True)


def write_texts(docs: DataFrame, path: str, *partitions: str) -> None:
    """Texts in one folder per class (and split)."""
    docs.write.mode("overwrite").partitionBy(*(partitions or ("label",))).parquet(path)


def write_bucketed(df: DataFrame, name: str, buckets: int, key: str = "doc_id") -> None:
    """A table bucketed by ``key``: joins of such tables on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    vocabulary.select("feature_index", "feature_name").orderBy("feature_index").write.mode("overwrite").csv(
        path, header=True
    )


def write_report(report: DataFrame, path: str) -> None:
    """A few metric rows as one file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def append_feedback(records: DataFrame, path: str) -> None:
    """Append feedback records as JSON lines; null fields stay visible."""
    records.write.mode("append").option("ignoreNullFields", False).json(path)

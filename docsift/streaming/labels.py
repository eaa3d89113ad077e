"""Current labels from the growing feedback log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.feedback import current_labels


def feedback_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Feedback records appended as JSON lines; ``created_at`` orders them as ``at``."""
    return spark.readStream.schema(schema).json(path).withColumn("at", F.col("created_at"))


def label_stream(decisions: DataFrame, output: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep the last decision per file.

    The state is one row per file. Every micro-batch writes only the files whose
    last decision changed, below its own batch number, so a repeated batch
    overwrites itself.
    """
    latest = F.max(F.struct("at", "record_id", "decision"))
    state = decisions.groupBy("filename").agg(latest.alias("last"))

    def save(changed: DataFrame, batch: int) -> None:
        changed.select("filename", "last.*").write.mode("overwrite").parquet(f"{output}/batch={batch}")

    writer = state.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_labels(spark: SparkSession, output: str) -> DataFrame:
    """The current label of each file from the changes written so far."""
    return current_labels(spark.read.parquet(output))

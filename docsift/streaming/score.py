"""Scoring of arriving documents."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import MANUAL_CHECK, VALID_LABELS
from ..operators.embed import Encoder
from ..plans.predict import predict_job
from ..schemas import DOCUMENTS


ROUTES = len((*VALID_LABELS, MANUAL_CHECK))
#: Bytes that a task's file of a route gathers in memory before they are written.
ROW_GROUP = 1 << 25


def document_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """Documents of the files that arrive in ``folder``, which may be a pattern of folders or files itself."""
    return (
        spark.readStream.schema(DOCUMENTS)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def score_stream(
    pipeline: PipelineModel,
    docs: DataFrame,
    output: str,
    checkpoint: str,
    once: bool = False,
    cache: DataFrame | None = None,
    encoder: Encoder | None = None,
    dim: int | None = None,
) -> StreamingQuery:
    """Write routed documents to one folder per route, each document exactly once.

    Stateless: every micro-batch runs the batch job. For a model that reads embeddings it
    joins the batch with the ``cache``, a table at rest that is read anew for each batch, and encodes what is missing there.
    A task keeps a file open for each route. With fewer writers than routes, Spark would sort a task's documents by route,
    texts and all; so their number is raised for the session.
    """
    conf, writers = docs.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    conf.set(writers, max(ROUTES, int(conf.get(writers, "0"))))
    routed = predict_job(pipeline, docs, cache=cache, encoder=encoder, dim=dim)
    writer = routed.writeStream.format("parquet").partitionBy("route").outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint).option("path", output).option("parquet.block.size", ROW_GROUP)
    return (writer.trigger(availableNow=True) if once else writer).start()

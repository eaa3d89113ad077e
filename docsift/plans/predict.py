"""Scoring jobs: new documents, exchange batches, evaluation against labels."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CONFIDENCE_THRESHOLD
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import models
from ..operators.documents import clean_documents
from ..operators.embed import Encoder, with_semantic
from ..operators.route import route
from ..operators.tfidf import TextCleaner
from ..schemas import EMBEDDINGS
from ..session import materialize
from ..sources import exchange
from ..sources.ids import read_numbered
from ..sources.payloads import read_payloads, write_payloads
from ..sources.registry import load_latest

SEMANTIC = "_semantic"


def needs_semantic(pipeline: PipelineModel) -> int | None:
    """The first stage that reads the embedding; None for a model of words."""
    for i, stage in enumerate(pipeline.stages):
        if stage.hasParam("inputCols") and stage.isDefined("inputCols") and SEMANTIC in stage.getOrDefault("inputCols"):
            return i
    return None


def semantic_width(pipeline: PipelineModel) -> int:
    """Length of the embeddings that a fitted pipeline takes: what its classifier has beyond the words."""
    words = next((len(s.vocabulary) for s in pipeline.stages if isinstance(s, CountVectorizerModel)), 0)
    return next(s.numFeatures for s in pipeline.stages if hasattr(s, "numFeatures")) - words


def score_documents(
    pipeline: PipelineModel,
    docs: DataFrame,
    skip_blank: bool = True,
    cache: DataFrame | None = None,
    encoder: Encoder | None = None,
    dim: int | None = None,
) -> DataFrame:
    """Add ``prediction`` and ``score`` to ``docs`` with ``text``.

    Row by row inside the scan's tasks: no shuffle. Documents whose cleaned text
    is blank are left out unless ``skip_blank`` is off. A pipeline that reads embeddings finds them in ``docs``
    (``_semantic``), else by ``doc_id`` in ``cache(doc_id, embedding)``, else asks the ``encoder`` for the cleaned text; that
    takes one join. Widths other than the model's are an error.
    """
    keep = [c for c in docs.columns if c != SEMANTIC]
    at = needs_semantic(pipeline)
    given = SEMANTIC in docs.columns
    carried = [*keep, SEMANTIC] if given else keep
    cleaned = clean_documents(docs).select(*carried, "clean")
    if skip_blank:
        # As a generator: a filter on a computed column would be pushed below it and clean every text twice.
        cleaned = cleaned.select(*carried, F.explode(F.when(F.col("clean") != "", F.array("clean"))).alias("clean"))
    if at is not None and not given:
        if encoder is None:
            raise ValueError("the model reads embeddings: an encoder is needed for documents that the cache does not hold")
        cleaned = with_semantic(cleaned, cache, encoder, dim or semantic_width(pipeline))
    # The first stage cleans the text; it is done already.
    stages = pipeline.stages[1:] if pipeline.stages and isinstance(pipeline.stages[0], TextCleaner) else pipeline.stages
    return models.score(PipelineModel(stages), cleaned).select(*docs.columns, "prediction", "score")


def predict_job(
    pipeline: PipelineModel,
    docs: DataFrame,
    threshold: float = CONFIDENCE_THRESHOLD,
    skip_blank: bool = True,
    cache: DataFrame | None = None,
    encoder: Encoder | None = None,
    dim: int | None = None,
) -> DataFrame:
    """Scored documents with confidence, uncertainty and route."""
    return route(score_documents(pipeline, docs, skip_blank, cache, encoder, dim), threshold)


def predict_folder(
    spark: SparkSession,
    folder: str,
    registry_path: str,
    ids_path: str,
    file_type: str = "txt",
    model_type: str = "logistic_regression",
    threshold: float = CONFIDENCE_THRESHOLD,
    cache_path: str | None = None,
    encoder: Encoder | None = None,
    dim: int | None = None,
) -> DataFrame:
    """Text files of a folder, scored by the newest saved model of a kind and routed.

    Ids of files come from the id table, so their embeddings are found in the cache again. Embeddings made here are
    appended to the cache below ``cache_path``.
    """
    pipeline = load_latest(spark, registry_path, file_type, model_type)
    if pipeline is None:
        raise FileNotFoundError(f"no saved {model_type} model for {file_type} files")
    docs = read_numbered(spark, folder, ids_path)
    cache = known_embeddings(spark, cache_path) if cache_path else None
    if needs_semantic(pipeline) is None or encoder is None:
        return predict_job(pipeline, docs, threshold, cache=cache, encoder=encoder, dim=dim)
    # Written once: the new embeddings and the scores are both read from there.
    cleaned = clean_documents(docs).select(*docs.columns, F.explode(F.when(F.col("clean") != "", F.array("clean"))).alias("clean"))
    ready = materialize(with_semantic(cleaned, cache, encoder, dim or semantic_width(pipeline)), "semantic")
    if cache_path:
        new = ready.filter("_encoded").select("doc_id", vector_to_array(SEMANTIC, "float32").alias("embedding"))
        new.write.mode("append").parquet(cache_path)
    stages = PipelineModel(pipeline.stages[1:])
    return route(models.score(stages, ready).select(*docs.columns, "prediction", "score"), threshold)


def known_embeddings(spark: SparkSession, path: str) -> DataFrame | None:
    """The embedding cache below ``path``; None where there is none yet."""
    try:
        return spark.read.schema(EMBEDDINGS).parquet(path)
    except AnalysisException:
        return None


def exchange_job(
    pipeline: PipelineModel,
    batches: DataFrame,
    threshold: float = CONFIDENCE_THRESHOLD,
    encoder: Encoder | None = None,
    dim: int | None = None,
) -> DataFrame:
    """Answers to JSON batches, one array per batch in input order.

    An id may come with another content in each batch, so embeddings are made for the content, never looked up.
    """
    documents = exchange.item_documents(exchange.parse_items(batches))
    routed = predict_job(pipeline, documents, threshold, encoder=encoder, dim=dim)
    return exchange.result_arrays(exchange.result_rows(documents, routed))


def exchange_folder(
    pipeline: PipelineModel,
    spark: SparkSession,
    source: str,
    target: str,
    threshold: float = CONFIDENCE_THRESHOLD,
    encoder: Encoder | None = None,
    dim: int | None = None,
) -> DataFrame:
    """Answers to the payload files of ``source``, a file of the same name in ``target`` for each; returns ``name, rejected`` of the bad ones.

    Results stand in the order of a payload's items.
    """
    read = materialize(read_payloads(spark, source), "payloads")
    items = read.filter("rejected IS NULL").select(F.col("name").alias("batch_id"), "pos", "id", "content")
    documents = exchange.item_documents(items)
    routed = predict_job(pipeline, documents, threshold, encoder=encoder, dim=dim)
    arrays = exchange.result_arrays(exchange.result_rows(documents, routed))
    write_payloads(arrays.select(F.col("batch_id").alias("name"), "payload"), target)
    return read.filter("rejected IS NOT NULL").select("name", "rejected")


def evaluate_batch(
    pipeline: PipelineModel,
    docs: DataFrame,
    labels: DataFrame,
    cached: DataFrame | None = None,
    cache: DataFrame | None = None,
    encoder: Encoder | None = None,
    dim: int | None = None,
) -> dict[str, DataFrame]:
    """Forced 0/1 decisions on labelled documents against their labels.

    A text in ``cached(doc_id, text)`` takes the place of the document's own.
    Blank documents are scored as well. Documents without a label are reported
    in ``skipped``. ``cache``, ``encoder`` and ``dim`` are those of ``score_documents``. The scored rows are written once and
    read by all reports.
    """
    matched, skipped = L.evaluation_rows(docs, labels)
    if cached is not None:
        found = cached.select("doc_id", F.col("text").alias("_cached_text"))
        matched = matched.join(found, "doc_id", "left").withColumn("text", F.coalesce("_cached_text", "text")).drop("_cached_text")
    scored = materialize(score_documents(pipeline, matched, False, cache, encoder, dim), "evaluated")
    counts = M.confusion_counts(scored)
    return {
        "scored": scored,
        "skipped": skipped,
        "accuracy": M.accuracy(scored),
        "report": M.classification_report(counts),
        "confusion": M.confusion_pct(counts),
    }

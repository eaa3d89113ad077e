"""Training job: labelled documents to a fitted pipeline with its reports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TrainConfig
from ..functions.clean import is_blank
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import models
from ..operators import selection as S
from ..operators.documents import clean_documents, comparison_report
from ..operators.embed import Encoder, HashingEncoder, assembler, embed_incremental, fit_scaler, sized
from ..operators.smote import smote
from ..operators.tfidf import TextCleaner, Tfidf, TfidfModel, explode_vector
from ..session import materialize
from ..sources import registry, sinks


@dataclass
class TrainResult:
    pipeline: PipelineModel  # from text (and _semantic) to prediction and score
    config: TrainConfig
    tfidf: TfidfModel | None
    balance: DataFrame
    comparison: DataFrame
    cv: DataFrame
    train_counts: DataFrame
    test_counts: DataFrame
    flags: DataFrame
    predictions: DataFrame
    new_embeddings: DataFrame | None = None
    top_features: DataFrame | None = None
    useful_terms: DataFrame | None = None
    not_useful_terms: DataFrame | None = None
    selected: list[int] = field(default_factory=list)
    name: str | None = None


def train_job(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    config: TrainConfig = TrainConfig(),
    cache: DataFrame | None = None,
    encoder: Encoder | None = None,
    output: str | None = None,
) -> TrainResult:
    """Train on ``docs(doc_id, filename, text)`` and ``labels(filename, label, split)``.

    Features are fitted on all training rows before cross-validation. With
    ``output`` the texts, reports, predictions and the fitted pipeline are saved
    below that folder.
    """
    rows = docs.join(L.first_rows(labels, "line" if "line" in labels.columns else None), "filename")
    before = L.class_balance(rows.filter("split = 'train'"))
    if config.ratio_pre_filter:
        ratio = L.require_both_classes(before).ratio
    kept = rows.filter(~is_blank(F.col("text")))
    # Everything below reads the cleaned table instead of cleaning again.
    clean = materialize(
        clean_documents(kept).select("doc_id", "filename", "y", "split", "clean"), "clean"
    )
    train = clean.filter("split = 'train'")
    balance = L.class_balance(train)
    counted = L.require_both_classes(balance)
    if not config.ratio_pre_filter:
        ratio = counted.ratio

    result_terms: dict[str, DataFrame] = {}
    stages = [TextCleaner()]
    tfidf = new = None
    staged = clean
    if config.feature_mode != "semantic":
        tfidf = Tfidf(config.max_features, config.ngram, config.min_df, config.stop_words).fit(train)
        stages += tfidf.stages()
        staged = tfidf.transform(staged)
    if config.feature_mode != "tfidf":
        empty = spark.createDataFrame([], "doc_id bigint, embedding array<float>")
        every, new = embed_incremental(
            clean, empty if cache is None else cache, encoder or HashingEncoder(config.embedding_dim), config.embedding_dim
        )
        staged = staged.join(semantic_column(every), "doc_id")
    if config.feature_mode == "combined":
        stages += [sized("tfidf", len(tfidf.entries)), assembler()]
        staged = PipelineModel(stages[-2:]).transform(staged)
        scaler = fit_scaler(staged.filter("split = 'train'"))
        stages.append(scaler)
        staged = scaler.transform(staged)
    elif config.feature_mode == "semantic":
        stages.append(VectorAssembler(inputCols=["_semantic"], outputCol="features"))
        staged = stages[-1].transform(staged)
    else:
        staged = staged.withColumn("features", F.col("tfidf"))
    staged = staged.select("doc_id", "filename", "y", "split", "features").persist()

    x_train = smote(
        staged.filter("split = 'train'"), threshold=config.smote_threshold, seed=config.seed, ratio=ratio
    ).select("doc_id", "y", "features")
    selected: list[int] = []
    x_test = staged.filter("split = 'test'")
    names = None
    if config.feature_mode == "tfidf":
        long = explode_vector(x_train, "doc_id", "features", "tfidf").join(x_train.select("doc_id", "y"), "doc_id")
        long = long.persist()
        vocabulary = tfidf.vocabulary(spark)
        scores = S.chi2_scores(long, x_train, vocabulary)
        selected = S.selected_indices(S.select_k_best(scores, min(config.chi2_k, len(tfidf.entries))))
        stages.append(VectorSlicer(inputCol="tfidf", outputCol="features", indices=selected))
        cut = VectorSlicer(inputCol="features", outputCol="_features", indices=selected)
        x_train, x_test = (cut.transform(x).drop("features").withColumnRenamed("_features", "features") for x in (x_train, x_test))
        # Selected features are numbered anew, in the old order.
        renumbered = [(new_i, old) for new_i, old in enumerate(selected)]
        names = spark.createDataFrame(renumbered, "position int, feature_index int").join(vocabulary, "feature_index")
        means = S.class_means(long, x_train, names).join(names.select("feature_index", "position"), "feature_index")
        means = means.withColumn("feature_index", F.col("position")).drop("position")
        useful, not_useful = S.discriminative_terms(means, config.top_n)
        result_terms = {"useful_terms": useful, "not_useful_terms": not_useful}
        names = names.select(F.col("position").alias("feature_index"), "feature_name")

    x_train = x_train.persist()
    classifier = models.create_classifier(config.model_type, seed=config.seed)
    cv = models.cross_validate(classifier, x_train, config.cv_folds)
    fitted = classifier.fit(x_train)
    stages += fitted.stages
    scored_train, scored_test = models.score(fitted, x_train), models.score(fitted, x_test)
    train_counts = M.confusion_counts(scored_train, "y")
    test_counts = M.confusion_counts(scored_test, "y")
    train_accuracy = M.rates(train_counts).first().accuracy
    test_accuracy = M.rates(test_counts).first().accuracy
    flags = M.quality_flags(
        M.cv_summary(cv).select(
            F.lit(ratio).alias("ratio"),
            F.col("mean").alias("cv_mean"),
            F.lit(train_accuracy).alias("train_accuracy"),
            F.lit(test_accuracy).alias("test_accuracy"),
        )
    )
    result = TrainResult(
        pipeline=PipelineModel(stages),
        config=config,
        tfidf=tfidf,
        balance=balance,
        comparison=comparison_report(kept.filter("split = 'train'")),
        cv=cv,
        train_counts=train_counts,
        test_counts=test_counts,
        flags=flags,
        predictions=sinks.prediction_table(scored_test),
        new_embeddings=new,
        top_features=models.model_top_features(fitted, names) if names is not None else None,
        selected=selected,
        **result_terms,
    )
    if output is not None:
        save_training(result, kept, clean, output, test_accuracy)
    return result


def semantic_column(embeddings: DataFrame) -> DataFrame:
    return embeddings.select("doc_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("_semantic"))


def save_training(result: TrainResult, raw: DataFrame, clean: DataFrame, output: str, accuracy: float) -> None:
    base = output.rstrip("/")
    name = F.when(F.col("y") == 1, F.lit("useful")).otherwise(F.lit("not_useful"))
    sinks.write_texts(raw.select("doc_id", "filename", "text", name.alias("label")), f"{base}/extracted", "label")
    sinks.write_texts(
        clean.select("doc_id", "filename", "clean", name.alias("label"), "split"), f"{base}/cleaned", "label", "split"
    )
    sinks.write_report(result.comparison, f"{base}/preprocessing_report")
    sinks.write_report(M.classification_report(result.test_counts), f"{base}/classification_report")
    sinks.write_report(M.confusion_pct(result.test_counts), f"{base}/confusion_matrix")
    result.predictions.write.mode("overwrite").csv(f"{base}/test_results", header=True)
    if result.tfidf is not None:
        vocabulary = result.tfidf.vocabulary(raw.sparkSession)
        if result.selected:
            vocabulary = vocabulary.filter(F.col("feature_index").isin(result.selected))
        sinks.write_vocabulary(vocabulary, f"{base}/selected_features")
    for frame, folder in ((result.useful_terms, "top_useful_features"), (result.not_useful_terms, "top_not_useful_features")):
        if frame is not None:
            frame.coalesce(1).write.mode("overwrite").csv(f"{base}/{folder}", header=True)
    if result.new_embeddings is not None:
        result.new_embeddings.write.mode("append").parquet(f"{base}/embeddings")
    result.name = registry.save_model(
        result.pipeline, f"{base}/registry", f"{base}/models", result.config.file_type, result.config.model_type, accuracy
    )

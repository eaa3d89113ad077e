"""Classifiers on Spark ML: factory, fit, scores, cross-validation, feature ranking."""

from __future__ import annotations

import logging
import math
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MODEL_TYPES
from .labels import add_class_weights, stratified_folds

log = logging.getLogger(__name__)

ROWS_PER_PARTITION = 50_000


@contextmanager
def held_for_fitting(rows: DataFrame, n: int):
    """The rows, computed once in as many tasks as they come in, then held in partitions of a fair size.

    Every iteration of a fit is one job over them, so small vectors in many
    partitions cost more to schedule than to add up. Held on disk: a fit packs them into
    blocks of its own, which are what its iterations read from memory.
    """
    computed = rows.persist(StorageLevel.DISK_ONLY)
    packed = computed.coalesce(max(1, math.ceil(n / ROWS_PER_PARTITION))).persist(StorageLevel.DISK_ONLY)
    try:
        computed.count()
        yield packed
    finally:
        packed.unpersist()
        computed.unpersist()


def in_parallel(spark: SparkSession, jobs: list, threads: int) -> list:
    """Results of independent Spark jobs, submitted from several driver threads."""
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max(1, threads)) as pool:
        return [f.result() for f in [pool.submit(inherit(job)) for job in jobs]]


def create_classifier(model_type: str | None = None, mode: str = "supervised", seed: int = 42):
    """Classifier of a kind; only the random forest has an unsupervised mode."""
    kind = model_type or "logistic_regression"
    if kind not in MODEL_TYPES:
        raise ValueError(f"unknown model type {kind!r}; choose one of {', '.join(MODEL_TYPES)}")
    if mode != "supervised":
        if kind == "random_forest":
            from .iforest import IsolationForest

            return IsolationForest(contamination=0.1, seed=seed)
        log.warning("%s has a supervised mode only; the mode is ignored", kind)
    return {
        "logistic_regression": LogisticClassifier,
        "svm": SvmClassifier,
        "random_forest": ForestClassifier,
    }[kind](seed)


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add ``prediction`` (0/1) and ``score``, the probability of the useful class."""
    out = model.transform(rows)
    extra = [c for c in ("rawPrediction", "probability", "_margin", "_platt_raw", "_platt_prediction") if c in out.columns]
    scored = out.withColumn("score", vector_to_array("probability")[1])
    return scored.withColumn("prediction", F.col("prediction").cast("int")).drop(*extra)


@dataclass
class LogisticClassifier:
    """L2 logistic regression with unit inverse strength and balanced classes."""

    seed: int = 42
    max_iter: int = 1000

    def fit(self, rows: DataFrame, features: str = "features", y: str = "y") -> PipelineModel:
        n = rows.count()
        with held_for_fitting(add_class_weights(rows, y), n) as weighted:
            # Spark averages the loss, so a penalty of 1/2 |w|^2 on the sum is 1/n here.
            estimator = LogisticRegression(
                featuresCol=features, labelCol=y, weightCol="weight", family="binomial", regParam=1.0 / n,
                elasticNetParam=0.0, standardization=False, maxIter=self.max_iter, tol=1e-6,
            )
            return PipelineModel([estimator.fit(weighted)])


@dataclass
class ForestClassifier:
    """Random forest of 100 trees, depth 10, at least 5 rows per leaf, balanced classes."""

    seed: int = 42

    def fit(self, rows: DataFrame, features: str = "features", y: str = "y") -> PipelineModel:
        estimator = RandomForestClassifier(
            featuresCol=features, labelCol=y, weightCol="weight", numTrees=100, maxDepth=10,
            minInstancesPerNode=5, seed=self.seed,
        )
        return PipelineModel([estimator.fit(add_class_weights(rows, y))])


@dataclass
class SvmClassifier:
    """Linear SVM with balanced classes; probabilities by a sigmoid on held-out margins."""

    seed: int = 42
    folds: int = 5
    max_iter: int = 1000  # for every fit alike; one that meets it before its tolerance holds says so
    tol: float = 1e-6

    def _margins(self, rows: DataFrame, features: str, y: str):
        n = rows.count()
        estimator = LinearSVC(
            featuresCol=features, labelCol=y, weightCol="weight", regParam=1.0 / n, standardization=False,
            maxIter=self.max_iter, tol=self.tol,
        )
        with held_for_fitting(add_class_weights(rows, y), n) as weighted:
            model = estimator.fit(weighted)
        if model.summary().totalIterations >= self.max_iter:
            log.warning("the SVM stopped at %d iterations before its tolerance was met", self.max_iter)
        return model

    def fit(self, rows: DataFrame, features: str = "features", y: str = "y") -> PipelineModel:
        key = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(self.seed)), F.lit(self.folds))
        held = rows.withColumn("_fold", key).persist()
        slicer = VectorSlicer(inputCol="rawPrediction", outputCol="_margin", indices=[1])
        try:
            # The model of all rows, and one per fold for margins on rows it has not seen.
            jobs = [lambda: self._margins(held, features, y)]
            for fold in range(self.folds):
                seen = held.filter(F.col("_fold") != fold)
                jobs.append(lambda seen=seen: self._margins(seen, features, y))
            final, *fitted = in_parallel(rows.sparkSession, jobs, len(jobs))
            parts = []
            for fold, model in enumerate(fitted):
                scored = slicer.transform(model.transform(held.filter(F.col("_fold") == fold)))
                parts.append(scored.select("_margin", F.col(y).alias("y")))
            margins = parts[0]
            for part in parts[1:]:
                margins = margins.union(part)
            platt = self._sigmoid(margins)
            return PipelineModel([final, slicer, platt])
        finally:
            held.unpersist()

    @staticmethod
    def _sigmoid(margins: DataFrame):
        # Soft targets (n1+1)/(n1+2) and 1/(n0+2): each row counts towards both
        # classes with complementary weights.
        size = margins.agg(F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0")).first()
        target = F.when(F.col("y") == 1, F.lit((size.n1 + 1.0) / (size.n1 + 2.0))).otherwise(
            F.lit(1.0 / (size.n0 + 2.0))
        )
        both = F.array(
            F.struct(F.lit(1.0).alias("label"), target.alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - target).alias("w"))
        )
        soft = margins.select("_margin", F.inline(both))
        estimator = LogisticRegression(
            featuresCol="_margin", labelCol="label", weightCol="w", regParam=0.0, maxIter=100, family="binomial",
            predictionCol="_platt_prediction", probabilityCol="probability", rawPredictionCol="_platt_raw",
        )
        return estimator.fit(soft)


def cross_validate(
    classifier, rows: DataFrame, k: int = 5, features: str = "features", y: str = "y", parallelism: int | None = None
) -> DataFrame:
    """Weighted F1 of each stratified fold as ``fold, f1``; folds are fitted side by side."""
    if type(classifier).__name__ == "IsolationForest":
        raise ValueError("cross-validation needs a supervised classifier")
    folded = stratified_folds(rows, k, label=y).persist()
    measure = MulticlassClassificationEvaluator(labelCol="_label", predictionCol="_predicted", metricName="f1")

    def run(fold: int) -> float:
        model = classifier.fit(folded.filter(F.col("fold") != fold), features, y)
        tested = score(model, folded.filter(F.col("fold") == fold))
        pair = tested.select(
            F.col(y).cast("double").alias("_label"), F.col("prediction").cast("double").alias("_predicted")
        )
        return float(measure.evaluate(pair))

    try:
        folded.count()
        scores = in_parallel(rows.sparkSession, [lambda fold=fold: run(fold) for fold in range(k)], parallelism or k)
    finally:
        folded.unpersist()
    return rows.sparkSession.createDataFrame(list(enumerate(scores)), "fold int, f1 double")


def rank_features(weights: DataFrame, n: int = 10, signed: bool = True) -> DataFrame:
    """Top features of ``feature_index, feature_name, weight``, by size of the weight.

    Coefficients rank by magnitude and keep their sign; importances are never negative.
    """
    size = F.round(F.abs("weight") if signed else F.col("weight"), 12)
    return weights.orderBy(size.desc(), "feature_index").limit(n)


def model_weights(model: PipelineModel, vocabulary: DataFrame) -> DataFrame:
    """Coefficients or importances of the classifier by feature name.

    A model has one number per feature, so the vector is as small as the vocabulary.
    """
    classifier = model.stages[0]
    vector = classifier.featureImportances if hasattr(classifier, "featureImportances") else classifier.coefficients
    rows = [(i, float(v)) for i, v in enumerate(vector.toArray())]
    weights = vocabulary.sparkSession.createDataFrame(rows, "feature_index int, weight double")
    return vocabulary.select("feature_index", "feature_name").join(weights, "feature_index")


def model_top_features(model: PipelineModel, vocabulary: DataFrame, n: int = 10) -> DataFrame:
    signed = not hasattr(model.stages[0], "featureImportances")
    return rank_features(model_weights(model, vocabulary), n, signed)

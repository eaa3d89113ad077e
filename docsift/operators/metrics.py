"""Evaluation: confusion counts, rates, reports, quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import IMBALANCE_LIMIT, NOT_USEFUL, OVERFIT_GAP, POOR_CV_F1, USEFUL

CELLS = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))


def confusion_counts(rows: DataFrame, actual: str = "actual", predicted: str = "prediction") -> DataFrame:
    """One row ``tn, fp, fn, tp`` of 0/1 columns."""
    return rows.agg(
        *[F.count_if((F.col(actual) == a) & (F.col(predicted) == p)).alias(name) for name, (a, p) in CELLS.items()]
    )


def confusion(counts: DataFrame) -> DataFrame:
    """The matrix as rows ``actual, predicted, n``; empty cells included."""
    cells = [
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(name).alias("n"))
        for name, (a, p) in CELLS.items()
    ]
    return counts.select(F.inline(F.array(*cells)))


def confusion_pct(counts: DataFrame) -> DataFrame:
    """The matrix with each cell's percentage of its row; null in an empty row."""
    negatives, positives = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    cells = [
        F.struct(
            F.lit(a).alias("actual"),
            F.lit(p).alias("predicted"),
            F.col(name).alias("n"),
            F.try_divide(F.col(name) * 100.0, positives if a else negatives).alias("row_pct"),
        )
        for name, (a, p) in CELLS.items()
    ]
    return counts.select(F.inline(F.array(*cells)))


def rates(counts: DataFrame) -> DataFrame:
    """Counts with accuracy, precision, recall and F1; 0 for empty denominators."""
    tn, fp, fn, tp = (F.col(c) for c in CELLS)
    named = counts.select(
        *CELLS,
        _ratio(tn + tp, tn + fp + fn + tp).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return named.withColumn("f1", _ratio(2 * p * r, p + r))


def classification_report(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted averages."""
    tn, fp, fn, tp = (F.col(c) for c in CELLS)
    n0, n1 = tn + fp, fn + tp
    per_class = {
        NOT_USEFUL: (_ratio(tn, tn + fn), _ratio(tn, n0), n0),
        USEFUL: (_ratio(tp, tp + fp), _ratio(tp, n1), n1),
    }
    scores = {}
    for name, (p, r, n) in per_class.items():
        scores[name] = (p, r, _ratio(2 * p * r, p + r), n)
    n = n0 + n1
    accuracy = _ratio(tn + tp, n)
    low, high = scores[NOT_USEFUL], scores[USEFUL]
    lines = [(name, *s) for name, s in scores.items()]
    lines.append(("accuracy", accuracy, accuracy, accuracy, n))
    lines.append(("macro avg", *[(a + b) / 2 for a, b in zip(low[:3], high[:3])], n))
    lines.append(("weighted avg", *[_ratio(a * n0 + b * n1, n) for a, b in zip(low[:3], high[:3])], n))
    names = ("class", "precision", "recall", "f1", "support")
    rows = [
        F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in zip(names, line)]) for line in lines
    ]
    return counts.select(F.inline(F.array(*rows)))


def accuracy(rows: DataFrame, actual: str = "actual", predicted: str = "prediction") -> DataFrame:
    return rows.agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"))


def positive_predictions(rows: DataFrame, predicted: str = "prediction") -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(predicted) == 1).alias("positives"))


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean, population deviation and two-sigma band of fold scores."""
    one = folds.agg(F.avg("f1").alias("mean"), F.stddev_pop("f1").alias("std"))
    return one.select("mean", "std", (F.col("std") * 2).alias("band"))


def quality_flags(metrics: DataFrame) -> DataFrame:
    """Flags on one row with ``ratio, cv_mean, train_accuracy, test_accuracy``."""
    gap = F.col("train_accuracy") - F.col("test_accuracy")
    return metrics.select(
        "*",
        (F.col("ratio") > IMBALANCE_LIMIT).alias("imbalanced"),
        (F.col("cv_mean") < POOR_CV_F1).alias("poor_cv"),
        (gap > OVERFIT_GAP).alias("overfit"),
        (F.col("test_accuracy") >= F.col("train_accuracy")).alias("no_overfit"),
    )

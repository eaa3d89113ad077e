"""Scalar rules on predictions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CONFIDENCE_THRESHOLD, NOT_USEFUL, USEFUL


def label_name(prediction: Column) -> Column:
    return F.when(prediction == 1, F.lit(USEFUL)).otherwise(F.lit(NOT_USEFUL))


def label_code(label: Column) -> Column:
    """0 or 1; an unknown label fails the job, a missing one stays null."""
    return (
        F.when(label.isNull(), F.lit(None).cast("int"))
        .when(label == USEFUL, F.lit(1))
        .when(label == NOT_USEFUL, F.lit(0))
        .otherwise(F.raise_error(F.concat(F.lit("unknown label: "), label)).cast("int"))
    )


def confidence(prediction: Column, score: Column) -> Column:
    """Percent confidence in the predicted class, from the score of the useful class."""
    return F.when(prediction == 1, score * 100).otherwise((1 - score) * 100)


def is_uncertain(confidence_percent: Column, threshold: float = CONFIDENCE_THRESHOLD) -> Column:
    return confidence_percent < threshold


def anomaly_to_label(sign: Column) -> Column:
    """Anomaly sign (-1 anomaly, 1 normal) to the label code."""
    return F.when(sign == -1, F.lit(1)).otherwise(F.lit(0))


def accuracy_text(accuracy: Column) -> Column:
    """93.1 percent as 93_1, for artefact names. Ties at half go up."""
    return F.replace(F.format_string("%.1f", accuracy * 100), F.lit("."), F.lit("_"))

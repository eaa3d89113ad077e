"""Human feedback: validation, records, corrections, current labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FILE_TYPES, MANUAL_CHECK, NOT_USEFUL, USEFUL, VALID_LABELS
from ..functions.clean import is_blank
from ..functions.records import iso_utc, pipeline_version, record_id
from ..schemas import CORRECTIONS, FEEDBACK

# Fixed value: the method named in correction records.
CORRECTION_METHOD = "Wrong marked or Uncertain labeled"


def _invalid(label: Column) -> Column:
    return F.coalesce(~label.isin(*VALID_LABELS), F.lit(True))


def _partition(rows: DataFrame, checks: list[tuple[Column, str]], strict: bool) -> tuple[DataFrame, DataFrame]:
    reason = F.lit(None).cast("string")
    for failed, text in reversed(checks):
        reason = F.when(failed, F.lit(text)).otherwise(reason)
    if strict:
        checked = F.when(reason.isNotNull(), F.raise_error(reason)).otherwise(F.lit(None).cast("string"))
        return rows.withColumn("reject_reason", checked).filter("reject_reason IS NULL").drop("reject_reason"), rows.limit(0)
    marked = rows.withColumn("reject_reason", reason)
    return marked.filter("reject_reason IS NULL").drop("reject_reason"), marked.filter("reject_reason IS NOT NULL")


def feedback_records(feedback: DataFrame, at: str = "at", strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pending feedback records, and the rejected rows with their reason.

    ``at`` is the UTC time of submission. ``strict`` fails on the first bad row.
    """
    labels = ", ".join(sorted(VALID_LABELS))
    checks = [
        (is_blank(F.col("filename")), "no file name"),
        (_invalid(F.col("predicted_label")), f"the predicted label is none of {labels}"),
        (_invalid(F.col("human_label")), f"the human label is none of {labels}"),
    ]
    accepted, rejected = _partition(feedback, checks, strict)
    records = (
        accepted.withColumn("record_id", record_id(F.col(at), F.col("filename")))
        .withColumn(
            "pipeline_version",
            pipeline_version(F.col("model_version"), F.col("tfidf_version"), F.col("scaler_version")),
        )
        .withColumn("apply_status", F.lit("pending"))
        .withColumn("applied_at", F.lit(None).cast("string"))
        .withColumn("created_at", iso_utc(F.col(at)))
    )
    return records.select(*FEEDBACK.names), rejected


def valid_corrections(corrections: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Corrections with a proper decision and file type, and the rejected ones."""
    checks = [
        (_invalid(F.col("decision")), f"the decision is none of {', '.join(sorted(VALID_LABELS))}"),
    ]
    if "file_type" in corrections.columns:
        bad_type = F.coalesce(~F.col("file_type").isin(*FILE_TYPES), F.lit(True))
        checks.append((bad_type, f"the file type is none of {', '.join(FILE_TYPES)}"))
    return _partition(corrections, checks, strict)


def locate(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Folder and current label of each wanted file, null where it is in none.

    Folders are searched in the order useful, not useful, manual check; a file
    that waits for a manual check has no label.
    """
    order = (
        F.when(F.col("dir") == USEFUL, 0).when(F.col("dir") == NOT_USEFUL, 1).when(F.col("dir") == MANUAL_CHECK, 2)
    )
    found = files.withColumn("_order", order).filter("_order IS NOT NULL")
    found = found.groupBy("filename").agg(F.min_by("dir", "_order").alias("dir"))
    placed = wanted.select("filename").distinct().join(found, "filename", "left")
    return placed.select("filename", "dir", F.when(F.col("dir") != MANUAL_CHECK, F.col("dir")).alias("label"))


def apply_corrections(
    files: DataFrame, corrections: DataFrame, bucket_seconds: int = 3600
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply reviewer decisions in time order to files with ``filename, dir``.

    ``corrections`` has ``record_id, filename, decision, predicted_score,
    reviewer, at``. Returns the files with their new ``dir`` and ``label``, the
    log of real moves, and the result of every correction. Corrections of files
    that are nowhere are left out of all three (see ``missing_files``).

    The previous decision on a file is looked up inside time buckets and then
    across bucket ends, so a file with very many corrections is not handled by
    one task.
    """
    decided, _ = valid_corrections(corrections)
    placed = locate(files, decided).filter("dir IS NOT NULL")
    rows = decided.join(placed, "filename").withColumn(
        "_bucket", F.expr(f"unix_micros(CAST(at AS TIMESTAMP)) div {int(bucket_seconds) * 1_000_000}")
    )
    in_bucket = Window.partitionBy("filename", "_bucket").orderBy("at", "record_id")
    ends = decided.withColumn("_bucket", F.expr(f"unix_micros(CAST(at AS TIMESTAMP)) div {int(bucket_seconds) * 1_000_000}"))
    ends = ends.groupBy("filename", "_bucket").agg(F.max_by("decision", F.struct("at", "record_id")).alias("_end"))
    across = Window.partitionBy("filename").orderBy("_bucket")
    ends = ends.select("filename", "_bucket", F.lag("_end").over(across).alias("_before"))
    rows = rows.withColumn("_prev", F.lag("decision").over(in_bucket)).join(ends, ["filename", "_bucket"])
    rows = rows.withColumn("_earlier", F.coalesce("_prev", "_before"))

    old_label = F.coalesce("_earlier", "label")
    old_dir = F.coalesce("_earlier", "dir")
    result = rows.select(
        "record_id",
        "filename",
        old_label.alias("old_label"),
        F.col("decision").alias("new_label"),
        F.col("decision").alias("moved_to"),
        (old_dir == F.col("decision")).alias("was_already_there"),
        "predicted_score",
        "reviewer",
        "at",
    )
    log = result.filter(~F.col("was_already_there")).select(
        record_id(F.col("at"), F.col("filename")).alias("record_id"),
        "filename",
        "old_label",
        "new_label",
        "predicted_score",
        "reviewer",
        F.lit(CORRECTION_METHOD).alias("method"),
        F.lit("applied").alias("apply_status"),
        iso_utc(F.col("at")).alias("applied_at"),
        iso_utc(F.col("at")).alias("created_at"),
    ).select(*CORRECTIONS.names)
    latest = current_labels(decided)
    moved = files.join(latest, "filename", "left").withColumn("dir", F.coalesce("new_label", "dir")).drop("new_label")
    moved = moved.withColumn("label", F.when(F.col("dir") != MANUAL_CHECK, F.col("dir")))
    return moved, log, result.drop("predicted_score", "reviewer", "at")


def missing_files(files: DataFrame, corrections: DataFrame) -> DataFrame:
    """Names in the corrections that are in no folder."""
    return locate(files, corrections).filter("dir IS NULL").select("filename")


def current_labels(corrections: DataFrame, decision: str = "decision") -> DataFrame:
    """Last decision per file. The maximum merges before the shuffle."""
    latest = F.max_by(decision, F.struct("at", "record_id")).alias("new_label")
    return corrections.groupBy("filename").agg(latest)

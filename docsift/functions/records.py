"""Fields of feedback records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pipeline_version(model: Column, tfidf: Column, scaler: Column) -> Column:
    """``model=… | tfidf=… | scaler=…`` with ``unknown`` for null or empty parts."""

    def part(name: str, value: Column) -> Column:
        return F.concat(F.lit(name + "="), F.coalesce(F.nullif(value, F.lit("")), F.lit("unknown")))

    return F.concat_ws(" | ", part("model", model), part("tfidf", tfidf), part("scaler", scaler))


def in_utc(at: Column) -> Column:
    """A timestamp that the session's time zone shows as the UTC time of ``at``."""
    return F.to_utc_timestamp(at.cast("timestamp"), F.current_timezone())


def record_id(at: Column, filename: Column) -> Column:
    return F.concat(F.date_format(in_utc(at), "yyyyMMddHHmmssSSSSSS"), F.lit("_"), filename)


def iso_utc(at: Column) -> Column:
    """ISO-8601 in UTC with offset. Microseconds are left out when they are zero."""
    at = in_utc(at)
    seconds = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(at, "SSSSSS")
    return F.concat(
        seconds,
        F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)),
        F.lit("+00:00"),
    )

"""Reuse of texts extracted by earlier runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import is_blank


def split_cache(docs: DataFrame, cache: DataFrame, key: str = "doc_id", value: str = "text") -> tuple[DataFrame, DataFrame]:
    """Cached rows for the wanted documents, and the documents still to compute.

    A blank cached text counts as missing. Only keys are compared, so the wide
    columns of ``docs`` move only where misses are too many to broadcast.
    """
    usable = cache.filter(~is_blank(F.col(value)))
    hits = usable.join(docs.select(key), key, "left_semi")
    missing = docs.select(key).join(usable.select(key), key, "left_anti")
    return hits.select(key, value), docs.join(missing, key, "left_semi")


def extract_incremental(
    docs: DataFrame, cache: DataFrame, extract: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """All texts, and the new ones to append to the cache. Blank results are not cached."""
    hits, misses = split_cache(docs, cache)
    new = extract(misses).select("doc_id", "text")
    tagged = hits.withColumn("cached", F.lit(True)).unionByName(new.withColumn("cached", F.lit(False)))
    return tagged, new.filter(~is_blank(F.col("text")))


def cache_counts(tagged: DataFrame) -> DataFrame:
    return tagged.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("cached").alias("cached"),
        F.count_if(~F.col("cached")).alias("extracted"),
    )


def first_cached(docs: DataFrame, *caches: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, text`` from the first cache that has the document; null where none has."""
    found = docs.select(key)
    for i, cache in enumerate(caches):
        found = found.join(cache.select(key, F.col("text").alias(f"_t{i}")), key, "left")
    return found.select(key, F.coalesce(*[F.col(f"_t{i}") for i in range(len(caches))]).alias("text"))


def cache_stats(cache: DataFrame, size: str = "length") -> DataFrame:
    """Number of cached files and their size in MB."""
    return cache.agg(
        F.count(F.lit(1)).alias("cached_files"),
        F.round(F.coalesce(F.sum(size), F.lit(0)) / 1048576, 2).alias("total_size_mb"),
    )

"""Whole-number ids for documents that are known by a name, such as the stem of a file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .files import read_texts

IDS = "stem string, doc_id bigint"


def stem_code(name: Column, attempt: int = 0) -> Column:
    """A non-negative 64-bit number for a name; another one for each attempt."""
    return F.shiftrightunsigned(F.xxhash64(name, F.lit(attempt)), 1)


def assign_ids(names: DataFrame, known: DataFrame | None = None, code: Callable[[Column, int], Column] = stem_code) -> DataFrame:
    """``stem, doc_id`` of every distinct name that is not in ``known`` yet, with ids that nobody there holds.

    An id depends on the name alone, so a name gets the same one in every batch and on every
    machine. Only where two names would share one, the holder or else the alphabetically
    first keeps it and the others take their next number. One aggregate over the ids finds these; there is
    about one pair among four billion names, so a second round is rare.
    """
    spark = names.sparkSession
    taken = (spark.createDataFrame([], IDS) if known is None else known).select("stem", "doc_id")
    todo = names.select("stem").filter("stem IS NOT NULL").distinct().join(taken.select("stem"), "stem", "left_anti")
    todo = materialize(todo, "names")
    attempt = 0
    settled: DataFrame | None = None
    while True:
        tried = todo.select("stem", code(F.col("stem"), attempt).alias("doc_id"))
        claims = taken.withColumn("held", F.lit(0)).unionByName(tried.withColumn("held", F.lit(1)))
        owners = claims.groupBy("doc_id").agg(F.min_by("stem", F.struct("held", "stem")).alias("owner"), F.count(F.lit(1)).alias("n"))
        shared = owners.filter("n > 1").select("doc_id", "owner")
        losers = materialize(tried.join(shared, "doc_id").filter("stem != owner").select("stem"), "names")
        if losers.isEmpty():
            return tried if settled is None else settled.unionByName(tried)
        won = materialize(tried.join(losers, "stem", "left_anti"), "ids")
        settled = won if settled is None else settled.unionByName(won)
        taken = taken.unionByName(won)
        todo, attempt = losers, attempt + 1


def known_ids(spark: SparkSession, path: str) -> DataFrame | None:
    """The id table below ``path``; None where there is none yet."""
    try:
        return spark.read.schema(IDS).parquet(path)
    except AnalysisException:
        return None


def with_ids(docs: DataFrame, path: str, stem: str = "doc_id") -> DataFrame:
    """``docs`` with the whole-number ``doc_id`` of their stems; ``stem`` keeps the name.

    New names are appended to the id table below ``path`` first, so an id is never given twice, also in later batches. A
    repeated run finds its names there.
    """
    spark = docs.sparkSession
    named = docs.withColumnRenamed(stem, "stem")
    assign_ids(named, known_ids(spark, path)).write.mode("append").parquet(path)
    return named.join(known_ids(spark, path), "stem")


def read_numbered(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """``doc_id, stem, filename, text`` of the text files of a folder, with ids from the table below ``path``."""
    return with_ids(read_texts(spark, folder), path).select("doc_id", "stem", "filename", "text")

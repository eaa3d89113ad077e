"""Document files: listing, decoding, merging of extracted texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FILE_TYPES
from ..functions.paths import file_name, stem, suffix


def list_files(spark: SparkSession, folder: str, file_type: str = "txt") -> DataFrame:
    """``path, filename, doc_id, size_kb`` of one file type, in path order. No content is read.

    Spark's file scan leaves out files of zero bytes, which hold no text anyway.
    """
    if file_type not in FILE_TYPES:
        raise ValueError(f"unknown file type {file_type!r}; choose one of {', '.join(FILE_TYPES)}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{file_type}").load(folder)
    return file_info(files.select("path", "length")).orderBy("path")


def file_info(files: DataFrame) -> DataFrame:
    """Name, stem and size in KB of files with ``path`` and ``length``."""
    path = F.col("path")
    return files.select(
        "path",
        file_name(path).alias("filename"),
        stem(path).alias("doc_id"),
        (F.col("length") / 1024).alias("size_kb"),
    )


def decode_text(content: Column) -> Column:
    """Text of file bytes: UTF-8, else Latin-1, with line ends as newlines."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(
        F.decode(content, "ISO-8859-1")
    )
    return F.coalesce(F.regexp_replace(text, "\r\n?", "\n"), F.lit(""))


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, filename, text`` of the text files of a folder; empty ones are dropped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    path = F.col("path")
    texts = files.select(
        stem(path).alias("doc_id"), file_name(path).alias("filename"), decode_text(F.col("content")).alias("text")
    )
    return texts.filter("text != ''")


def by_file_type(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with a supported extension in any case, with ``file_type``; and the others."""
    typed = files.withColumn("file_type", F.substring(F.lower(suffix(F.col("path"))), 2, 16))
    return typed.filter(F.col("file_type").isin(*FILE_TYPES)), typed.filter(~F.col("file_type").isin(*FILE_TYPES))


def merge_by_stem(texts: DataFrame, priority: str = "priority") -> DataFrame:
    """One text per ``doc_id``: the one with the highest ``priority``.

    Priorities of one id must differ. The maximum merges before the shuffle.
    """
    return texts.groupBy("doc_id").agg(
        F.max_by("text", priority).alias("text"), F.max(priority).alias(priority)
    )

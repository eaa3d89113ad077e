"""Documents from page tables and from several extractors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MIN_EXTRACTED_CHARS
from ..functions.clean import stripped_length

PAGES_PER_BLOCK = 4096


def _joined(groups) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return groups.agg(F.min("page_no").alias("page_no"), F.array_join(F.transform(ordered, lambda p: p.text), "\n").alias("text"))


def assemble_pages(pages: DataFrame, block: int = PAGES_PER_BLOCK) -> DataFrame:
    """``doc_id, text`` from ``doc_id, page_no, text``: pages with text, in order, one per line break.

    A usual document is gathered at once. One with more than ``block`` pages is
    gathered in blocks of neighbouring pages by many tasks first; only its
    finished blocks meet in one row, which is the result asked for.
    """
    filled = pages.filter("text IS NOT NULL AND text != ''").select("doc_id", "page_no", "text")
    large = filled.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block).select("doc_id")
    usual = _joined(filled.join(large, "doc_id", "left_anti").groupBy("doc_id"))
    blocks = filled.join(large, "doc_id", "left_semi").withColumn("_block", F.expr(f"page_no div {int(block)}"))
    whole = _joined(_joined(blocks.groupBy("doc_id", "_block")).groupBy("doc_id"))
    return usual.unionByName(whole).select("doc_id", "text")


def extraction_cascade(candidates: DataFrame, min_chars: int = MIN_EXTRACTED_CHARS) -> DataFrame:
    """Text of the first extractor that found enough, else of the last one.

    ``candidates`` has ``doc_id, extractor, rank, text``; a failed extractor
    leaves null, which gives the empty text. One minimum per document decides,
    and it merges before the shuffle.
    """
    enough = stripped_length(F.col("text")) >= min_chars
    choice = F.when(enough, F.struct(F.lit(0).alias("late"), F.col("rank").alias("r"))).otherwise(
        F.struct(F.lit(1).alias("late"), (-F.col("rank")).alias("r"))
    )
    best = candidates.withColumn("_choice", choice).groupBy("doc_id").agg(
        F.min_by(F.struct("extractor", "text"), "_choice").alias("best")
    )
    return best.select("doc_id", F.col("best.extractor").alias("extractor"), F.coalesce("best.text", F.lit("")).alias("text"))

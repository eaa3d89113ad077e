"""JSON exchange: batches of items in, results in the same order out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import ITEMS

# Fixed value: an id is one or more letters or numbers.
ID_PATTERN = r"\A[\p{L}\p{N}]+\z"


def check_batches(batches: DataFrame) -> DataFrame:
    """Add ``items`` and ``valid`` to rows of ``batch_id, payload``.

    A batch counts only as a whole: a list of objects whose ``id`` and
    ``content`` are both strings, the id alphanumeric. The first parse keeps each
    value as JSON text, where a string is what starts with a quote.
    """
    typed = F.try_variant_get(F.try_parse_json("payload"), "$", "array<variant>")
    good = F.forall(
        typed,
        lambda v: F.coalesce(
            (F.schema_of_variant(F.try_variant_get(v, "$.id", "variant")) == "STRING")
            & (F.schema_of_variant(F.try_variant_get(v, "$.content", "variant")) == "STRING")
            & F.rlike(F.try_variant_get(v, "$.id", "string"), F.lit(ID_PATTERN)),
            F.lit(False),
        ),
    )
    return batches.withColumn("valid", F.coalesce(good, F.lit(False))).withColumn(
        "items", F.when(F.col("valid"), F.from_json("payload", ITEMS))
    )


def parse_items(batches: DataFrame, strict: bool = True) -> DataFrame:
    """``batch_id, pos, id, content`` of all items; a bad batch fails the job, or is left out."""
    checked = check_batches(batches)
    if strict:
        items = F.when(F.col("valid"), F.col("items")).otherwise(F.raise_error(F.lit("invalid input batch")))
    else:
        items = F.col("items")
    rows = checked.select("batch_id", F.posexplode_outer(items).alias("pos", "item"))
    return rows.filter("item IS NOT NULL").select("batch_id", "pos", "item.id", "item.content")


def item_documents(items: DataFrame) -> DataFrame:
    """One document per batch and id: the place of the first, the content of the last item."""
    return items.groupBy("batch_id", "id").agg(
        F.min("pos").alias("pos"), F.max_by("content", "pos").alias("text")
    ).select("batch_id", "pos", F.concat("id", F.lit(".txt")).alias("filename"), "text")


def result_rows(documents: DataFrame, routed: DataFrame) -> DataFrame:
    """Result of each document as JSON, ``null`` for those without a prediction."""
    result = F.to_json(
        F.struct(
            (F.col("prediction") == 1).alias("relevant"),
            F.col("confidence").alias("score"),
            F.col("uncertain").alias("uncertain"),
        )
    )
    scored = routed.select("batch_id", "filename", result.alias("_json"))
    joined = documents.select("batch_id", "pos", "filename").join(scored, ["batch_id", "filename"], "left")
    return joined.select("batch_id", "pos", "filename", F.coalesce("_json", F.lit("null")).alias("result"))


def result_arrays(results: DataFrame) -> DataFrame:
    """One JSON array per batch, in input order.

    A batch came in as one row, so its answers, which are shorter, fit one too.
    """
    ordered = F.array_sort(F.collect_list(F.struct("pos", "result")))
    return results.groupBy("batch_id").agg(
        F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda r: r.result), ", "), F.lit("]")).alias("payload")
    )

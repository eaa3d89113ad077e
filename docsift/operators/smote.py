"""Synthetic minority rows between near neighbours (SMOTE)."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..config import IMBALANCE_LIMIT
from ..session import materialize
from ..sources.ids import assign_ids
from .neighbours import nearest
from .ranking import segment_by_rank

#: Synthetic rows that one row of a table stands for before they are made.
CHUNK = 4096


def smote(
    rows: DataFrame,
    features: str = "features",
    y: str = "y",
    key: str = "doc_id",
    threshold: float = IMBALANCE_LIMIT,
    k: int = 5,
    seed: int = 42,
    max_bytes: int = 256 << 20,
    ratio: float | None = None,
    origins: bool = False,
    chunk: int = CHUNK,
) -> DataFrame:
    """``key, features, y, synthetic`` with as many useful as not-useful rows.

    Rebalances only where the ratio of not-useful to useful rows exceeds
    ``threshold`` and at least two useful rows exist. Each new row lies between
    a useful row and one of its k nearest useful neighbours; ``origins`` adds the two (``base``, ``near``) and the
    ``share`` of the way. ``key`` is unique and of any type: a new key is a negative number,
    or for names the base's name with a number after ``#``. New vectors are sparse where that is smaller.

    Copies of a row are merged first: they are each other's neighbours at
    distance 0, so neither the search nor the interpolation needs them apart. How many rows a row has to give is
    only a number until the end: it is cut in chunks, these are dealt out, and each is expanded where it lands.
    """
    added = [F.lit(None).cast(rows.schema[key].dataType).alias(c) for c in ("base", "near")] + [F.lit(None).cast("double").alias("share")]
    plain = rows.select(key, features, y, F.lit(False).alias("synthetic"), *(added if origins else []))
    size = rows.agg(F.count_if(F.col(y) == 1).alias("n1"), F.count_if(F.col(y) == 0).alias("n0")).first()
    k = min(k, size.n1 - 1)
    if k < 1 or (size.n0 / size.n1 if ratio is None else ratio) <= threshold or size.n0 <= size.n1:
        return plain
    whole, rest = divmod(size.n0 - size.n1, size.n1)

    spark = rows.sparkSession
    useful = rows.filter(F.col(y) == 1).select(F.col(key).alias("name"), vector_to_array(features).alias("x"))
    numbers = isinstance(rows.schema[key].dataType, IntegralType)
    if numbers:
        useful = useful.select(F.col("name").cast("bigint").alias("key"), "name", "x")
    else:
        ids = materialize(assign_ids(useful.select(F.col("name").cast("string").alias("stem"))), "ids")
        useful = useful.join(ids, F.col("name").cast("string") == F.col("stem")).select(F.col("doc_id").alias("key"), "name", "x")
    order = useful.withColumn("_h", F.xxhash64("key", F.lit(seed))).withColumn("_g", F.lit(0))
    cuts = spark.createDataFrame([(0, [rest])], "_g int, cuts array<bigint>")
    shared = segment_by_rank(order, "_g", F.shiftright("_h", 54), ["_h", "key"], cuts, "_segment")
    quota = F.when(F.col("_segment") == 0, F.lit(whole + 1)).otherwise(F.lit(whole))
    distinct = shared.select("key", "name", "x", quota.alias("quota")).groupBy("x").agg(
        F.min("key").alias("key"), F.min_by("name", "key").alias("name"),
        F.count(F.lit(1)).alias("copies"), F.sum("quota").alias("quota"),
    )
    distinct = materialize(distinct, "minority")

    found = nearest(distinct.select("key", "x"), k, max_bytes)
    copies = distinct.select(F.col("key").alias("near"), F.col("copies").alias("_m"))
    found = found.join(copies, "near").groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("gap", "near", "_m"))).alias("_near")
    )
    # The point's own copies come first, then each neighbour as often as it occurs.
    listed = F.slice(
        F.concat(
            F.array_repeat("key", F.least(F.col("copies") - 1, F.lit(k)).cast("int")),
            F.flatten(
                F.transform(
                    F.coalesce("_near", F.array().cast("array<struct<gap:double,near:bigint,_m:bigint>>")),
                    lambda e: F.array_repeat(e.near, F.least(e["_m"], F.lit(k)).cast("int")),
                )
            ),
        ),
        1,
        k,
    )
    bases = distinct.join(found, "key", "left").filter("quota > 0").select("key", "name", "x", "quota", listed.alias("_pick"))
    partner = distinct.select(F.col("key").alias("near"), F.col("name").alias("_near"), F.col("x").alias("_to"))
    picked = bases.select("key", F.posexplode("_pick").alias("_p", "near")).join(partner, "near")
    picked = picked.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("_p", "_near", "_to"))).alias("_pick"))
    dealt = bases.drop("_pick").join(picked, "key").withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (quota - 1) div {int(chunk)})")))
    dealt = dealt.repartition("key", "_chunk")
    inside = f"sequence(_chunk * {int(chunk)}, least(quota, (_chunk + 1) * {int(chunk)}) - 1)"
    drawn = dealt.select("key", "name", "x", "_pick", F.explode(F.expr(inside)).alias("j"))
    which = F.pmod(F.xxhash64("key", "j", F.lit(seed + 1)), F.size("_pick")) + 1
    share = F.pmod(F.xxhash64("key", "j", F.lit(seed + 2)), F.lit(1 << 53)) / float(1 << 53)
    drawn = drawn.select("key", "name", "x", "j", F.element_at("_pick", which.cast("int")).alias("_other"), share.alias("share"))
    if numbers:
        new = -F.shiftrightunsigned(F.xxhash64("key", "j", F.lit(seed + 3)), 1) - 1
    else:
        new = F.concat(F.col("name").cast("string"), F.lit("#"), F.col("j").cast("string"))
    between = F.zip_with("x", F.col("_other._to"), lambda a, b: a + F.lit(1.0) * F.col("share") * (b - a))
    made = drawn.select(
        new.alias(key), array_to_vector(between).alias("_dense"), F.lit(1).cast(rows.schema[y].dataType).alias(y),
        F.lit(True).alias("synthetic"), F.col("name").alias("base"), F.col("_other._near").alias("near"), "share",
    )
    made = VectorAssembler(inputCols=["_dense"], outputCol=features).transform(made)  # takes the smaller form
    return plain.unionByName(made.select(*plain.columns))

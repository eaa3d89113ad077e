"""Exact ranks and order statistics without sorting a whole group in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segment_by_rank(
    df: DataFrame, group: str, bucket: Column, order: list[str], cuts: DataFrame, out: str = "segment"
) -> DataFrame:
    """Number of rank cuts at or below each row's 0-based rank inside its group.

    ``bucket`` must grow with ``order``. ``cuts`` holds one row per group with an
    ascending ``array<bigint>`` column ``cuts``. Buckets without a cut get their
    segment from the bucket counts; only rows of buckets that a cut falls into
    are ranked. So a group with a third of all rows still ends up in many tasks.
    The count table has at most groups x buckets rows, which the caller bounds.
    """
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(group).orderBy("_bucket")

    def below(rank: Column) -> Column:
        return F.size(F.filter("cuts", lambda c: c <= rank))

    spans = (
        sizes.withColumn("_start", F.sum("_n").over(running) - F.col("_n"))
        .join(F.broadcast(cuts), group)
        .withColumn("_low", below(F.col("_start")))
        .withColumn("_high", below(F.col("_start") + F.col("_n") - 1))
        .select(group, "_bucket", "_start", "_low", "_high", "cuts")
    )
    marked = rows.join(F.broadcast(spans), [group, "_bucket"])
    whole = marked.filter("_low = _high").withColumn(out, F.col("_low"))
    within = Window.partitionBy(group, "_bucket").orderBy(*order)
    ranked = marked.filter("_low < _high").withColumn("_rank", F.col("_start") + F.row_number().over(within) - 1)
    ranked = ranked.withColumn(out, below(F.col("_rank"))).drop("_rank")
    return whole.unionByName(ranked).drop("_bucket", "_start", "_low", "_high", "cuts")


def split_points(df: DataFrame, key: str, rows_per_bucket: int = 1_000_000, max_buckets: int = 1024) -> list:
    """Values of ``key`` that cut it into buckets of roughly equal size.

    They come from a key sample of bounded size, picked by hash so that reruns
    agree. Small tables need a single bucket and get no split points.
    """
    n = df.count()
    buckets = min(max_buckets, math.ceil(n / rows_per_bucket))
    if buckets <= 1:
        return []
    keep_one_in = max(1, n // (buckets * 64))
    sample = df.filter(F.pmod(F.xxhash64(key), F.lit(keep_one_in)) == 0).select(key).limit(buckets * 256)
    keys = sorted(r[0] for r in sample.collect())
    return sorted({keys[i * len(keys) // buckets] for i in range(1, buckets)}) if keys else []


def hash_sample(df: DataFrame, key: str, size: int, n: int, seed: int = 42) -> DataFrame:
    """Uniform sample of ``size`` of the ``n`` keys (all, if fewer), the same in every run.

    A hash threshold lets through half as much again as needed, so the final
    top-k sees few rows however large the table is. It carries keys only.
    """
    keys = df.select(key)
    if n > 2 * size:
        keep = F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.lit(n)) < int(1.5 * size) + 100
        keys = keys.filter(keep)
    return keys.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(size)


def range_bucket(key: str, points: list) -> Column:
    """Index of the bucket a key falls into."""
    if not points:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(p) for p in points]), lambda p: p <= F.col(key)))


def order_statistic(df: DataFrame, column: str, rank: int, in_memory: int = 10_000, bins: int = 4096) -> float:
    """The value at a 0-based rank of a numeric column.

    Histogram counts narrow the range until few rows remain; each round is one
    aggregate with a bounded number of groups, and no task sees the whole column.
    """
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not 0 <= rank < n:
        raise ValueError(f"rank {rank} outside 0..{n - 1}")
    value = F.col(column)
    while low < high and n > in_memory:
        inside = df.filter((value >= low) & (value <= high))
        width = (high - low) / bins
        index = F.least(F.floor((value - low) / width), F.lit(bins - 1)).cast("int")
        spans = (
            inside.groupBy(index.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
            .orderBy("bin")
            .collect()
        )
        for span in spans:
            if rank < span.n:
                break
            rank -= span.n
        if (span.low, span.high) == (low, high):
            break  # the bin width is below the spacing of doubles
        low, high, n = span.low, span.high, span.n
    if low == high:
        return low
    rest = df.filter((value >= low) & (value <= high)).select(column).orderBy(column).limit(rank + 1)
    return rest.agg(F.max(column)).first()[0]


def quantile(df: DataFrame, column: str, q: float) -> float:
    """Exact quantile with linear interpolation between neighbouring ranks."""
    n = df.agg(F.count(column)).first()[0]
    position = q * (n - 1)
    lower = math.floor(position)
    a = order_statistic(df, column, lower)
    if lower == position:
        return a
    b = order_statistic(df, column, lower + 1)
    return a + (b - a) * (position - lower)

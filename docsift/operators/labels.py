"""Label tables: assignment, lookup, stratified split and folds, balance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import IMBALANCE_LIMIT, NOT_USEFUL, USEFUL, VALID_LABELS
from ..functions.scoring import label_code
from .ranking import range_bucket, segment_by_rank, split_points

SPLITS = ("train", "test")


def build_labels(files: DataFrame, test_size: float = 0.25, seed: int = 42) -> DataFrame | None:
    """Label table from a file list with ``filename`` and ``dir``.

    Files below the useful folder are useful, files below the main folder are
    not. Without a useful file there is nothing to learn and no table.
    """
    useful = files.filter(F.col("dir") == USEFUL).select("filename", F.lit(USEFUL).alias("label"))
    other = files.filter(F.col("dir") == NOT_USEFUL).select("filename", F.lit(NOT_USEFUL).alias("label"))
    if not useful.take(1):
        return None
    return stratified_split(other.unionByName(useful), test_size, seed)


def split_quotas(labels: DataFrame, test_size: float) -> DataFrame:
    """Training rows per label: proportional, left-over rows to the largest remainders."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_c"))
    # A handful of rows, one per label: a window over all of them is cheap.
    everything = Window.partitionBy(F.lit(1))
    by_remainder = everything.orderBy(F.desc("rest"), "label")
    total = F.sum("n_c").over(everything)
    n_train = total - F.ceil(total * F.lit(test_size))
    product = n_train.cast("decimal(19,0)") * F.col("n_c").cast("decimal(19,0)")
    shares = sizes.select("label", total.alias("n"), n_train.alias("n_train"), product.alias("p"))
    shares = shares.withColumn("whole", F.expr("p div n")).withColumn("rest", F.expr("p % n"))
    left_over = F.col("n_train") - F.sum("whole").over(everything)
    extra = (F.row_number().over(by_remainder) <= left_over).cast("long")
    return shares.select("label", (F.col("whole") + extra).alias("quota"))


def stratified_split(labels: DataFrame, test_size: float = 0.25, seed: int = 42) -> DataFrame:
    """Add ``split``: per label, the training quota goes to the smallest name hashes.

    The order depends on the name and the seed alone, so adding or relabelling
    a few files moves few others across the split.
    """
    keyed = labels.withColumn("_key", F.md5(F.concat("filename", F.lit(f"|{seed}"))))
    cuts = split_quotas(labels, test_size).select("label", F.array("quota").alias("cuts"))
    placed = segment_by_rank(keyed, "label", F.substring("_key", 1, 3), ["_key", "filename"], cuts, "_segment")
    name = F.when(F.col("_segment") == 0, F.lit("train")).otherwise(F.lit("test"))
    return placed.withColumn("split", name).drop("_key", "_segment")


def stratified_folds(df: DataFrame, k: int = 5, key: str = "doc_id", label: str = "label") -> DataFrame:
    """Add ``fold``: unshuffled stratified folds over the rows in ``key`` order.

    Fold f gets as many rows of a class as the label-sorted list has at the
    positions f, f+k, f+2k, ...; each class fills the folds in order.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    before = F.sum("n_c").over(Window.partitionBy(F.lit(1)).orderBy(label)) - F.col("n_c")
    spans = sizes.withColumn("lo", before).withColumn("hi", F.col("lo") + F.col("n_c"))

    # Positions p in [0, x) with p % k == f number (x - f + k - 1) div k.
    def share(f: int) -> str:
        return f"((hi + {k - 1 - f}) div {k} - (lo + {k - 1 - f}) div {k})"

    ends = [" + ".join(share(f) for f in range(last + 1)) for last in range(k - 1)]
    cuts = spans.select(label, F.array(*[F.expr(e).cast("long") for e in ends]).alias("cuts"))
    return segment_by_rank(df, label, range_bucket(key, split_points(df, key)), [key], cuts, "fold")


def first_labels(labels: DataFrame, order: str | None = None) -> DataFrame:
    """One label per file name, the first one in ``order``.

    The minimum merges before the shuffle, so a name repeated very often costs
    one row per task.
    """
    if order is None:
        return labels.groupBy("filename").agg(F.min("label").alias("label"))
    return labels.groupBy("filename").agg(F.min_by("label", order).alias("label"))


def first_rows(labels: DataFrame, order: str | None = None) -> DataFrame:
    """``filename, y, split`` of one row for each file: the first in ``order``, else the smallest pair."""
    pair = F.struct("label", "split")
    one = labels.groupBy("filename").agg((F.min(pair) if order is None else F.min_by(pair, order)).alias("r"))
    return one.select("filename", label_code(F.col("r.label")).alias("y"), F.col("r.split").alias("split"))


def attach_labels(docs: DataFrame, labels: DataFrame, default: int = 0, order: str | None = None) -> DataFrame:
    """Add ``y`` in {0, 1} by file name; files without a label get ``default``."""
    named = first_labels(labels, order).select("filename", label_code(F.col("label")).alias("_y"))
    joined = docs.join(named, "filename", "left")
    return joined.withColumn("y", F.coalesce("_y", F.lit(default))).drop("_y")


def evaluation_rows(docs: DataFrame, labels: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents with a label, and the names of those that have none."""
    named = first_labels(labels, order).select(
        "filename", label_code(F.col("label")).alias("actual")
    )
    return docs.join(named, "filename"), docs.select("filename").join(named, "filename", "left_anti")


def resolve_split(
    labels: DataFrame, main_docs: DataFrame, useful_docs: DataFrame, split: str
) -> tuple[DataFrame, DataFrame]:
    """Files of one split, looked up in the main folder, then in the useful one.

    Returns the found files with their ``dir`` and the names of the missing ones.
    """
    wanted = labels.filter(F.col("split") == split)
    in_main = main_docs.select("filename").distinct().withColumn("_main", F.lit(NOT_USEFUL))
    in_useful = useful_docs.select("filename").distinct().withColumn("_useful", F.lit(USEFUL))
    placed = (
        wanted.join(in_main, "filename", "left")
        .join(in_useful, "filename", "left")
        .withColumn("dir", F.coalesce("_main", "_useful"))
        .drop("_main", "_useful")
    )
    return placed.filter("dir IS NOT NULL"), placed.filter("dir IS NULL").select("filename")


def split_rows(labels: DataFrame, split: str, label: str | None = None) -> DataFrame:
    """Rows of one split, optionally of one class."""
    rows = labels.filter(F.col("split") == split)
    return rows if label is None else rows.filter(F.col("label") == label)


def split_summary(labels: DataFrame) -> DataFrame:
    """Rows and share of each split, and of the whole table."""
    one = labels.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS],
    )
    rows = [F.struct(F.lit(s).alias("split"), F.col(s).alias("n")) for s in ("total", *SPLITS)]
    lines = one.select("total", F.inline(F.array(*rows)))
    return lines.select("split", "n", F.round(F.try_divide(F.col("n") * 100.0, "total"), 1).alias("percent"))


def split_label_counts(labels: DataFrame) -> DataFrame:
    """Rows per split and label, zeros included."""
    grid = [(s, name) for s in SPLITS for name in VALID_LABELS]
    one = labels.agg(
        *[
            F.count_if((F.col("split") == s) & (F.col("label") == name)).alias(f"{s}_{name}")
            for s, name in grid
        ]
    )
    rows = [
        F.struct(F.lit(s).alias("split"), F.lit(name).alias("label"), F.col(f"{s}_{name}").alias("n"))
        for s, name in grid
    ]
    return one.select(F.inline(F.array(*rows)))


def class_balance(rows: DataFrame, y: str = "y", limit: float = IMBALANCE_LIMIT) -> DataFrame:
    """One row: class counts, percentages, not-useful to useful ratio and its flag."""
    one = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(y) == 1).alias("useful"),
        F.count_if(F.col(y) == 0).alias("not_useful"),
    )
    ratio = F.try_divide(F.col("not_useful").cast("double"), "useful")
    return one.select(
        "n",
        "useful",
        "not_useful",
        F.round(F.try_divide(F.col("useful") * 100.0, "n"), 1).alias("useful_percent"),
        F.round(F.try_divide(F.col("not_useful") * 100.0, "n"), 1).alias("not_useful_percent"),
        F.round(ratio, 6).alias("ratio"),
        F.coalesce(ratio > limit, F.lit(False)).alias("imbalanced"),
    )


def require_both_classes(balance: DataFrame):
    """The balance row; an error where training cannot start."""
    row = balance.first()
    if row.n == 0:
        raise ValueError("no training data found")
    if row.useful == 0:
        raise ValueError("no useful document in the training set")
    if row.not_useful == 0:
        raise ValueError("no not-useful document in the training set")
    return row


def class_weights(rows: DataFrame, y: str = "y") -> DataFrame:
    """Balanced weight n / (classes * n_c) per class."""
    sizes = rows.groupBy(F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(1))  # one row per class
    weight = F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))
    return sizes.select("y", "n", weight.alias("weight"))


def add_class_weights(rows: DataFrame, y: str = "y", out: str = "weight") -> DataFrame:
    """Add the balanced class weight to each row.

    The weights are two numbers; as a literal case they need no join per row.
    """
    weights = class_weights(rows, y).collect()
    value = F.lit(None).cast("double")
    for row in weights:
        value = F.when(F.col(y) == row.y, F.lit(row.weight)).otherwise(value)
    return rows.withColumn(out, value)

"""Feature selection and class-discriminating terms on long-form TF-IDF."""

from __future__ import annotations

from pyspark.ml.feature import VectorSlicer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_sums(tfidf_long: DataFrame, labels: DataFrame, key: str = "doc_id", y: str = "y") -> DataFrame:
    """Summed weight per feature and class; one small row per feature after the shuffle.

    Entries that carry the class already need no join.
    """
    rows = tfidf_long if y in tfidf_long.columns else tfidf_long.join(labels.select(key, y), key)
    return rows.groupBy("feature_index").agg(
        F.sum(F.when(F.col(y) == 1, F.col("tfidf")).otherwise(0.0)).alias("useful_sum"),
        F.sum(F.when(F.col(y) == 0, F.col("tfidf")).otherwise(0.0)).alias("not_useful_sum"),
    )


def class_sizes(labels: DataFrame, y: str = "y") -> DataFrame:
    return labels.agg(
        F.count_if(F.col(y) == 1).alias("n_useful"), F.count_if(F.col(y) == 0).alias("n_not_useful")
    )


def class_means(tfidf_long: DataFrame, labels: DataFrame, vocabulary: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mean TF-IDF per class and their difference; documents without the term count as zero.

    Vocabulary and sums have at most as many rows as the fit has features.
    """
    size = class_sizes(labels).first()
    sums = class_sums(tfidf_long, labels, key)
    named = vocabulary.select("feature_index", "feature_name").join(sums, "feature_index", "left")
    means = named.select(
        "feature_index",
        "feature_name",
        F.coalesce(F.try_divide("useful_sum", F.lit(size.n_useful)), F.lit(0.0)).alias("useful_mean_tfidf"),
        F.coalesce(F.try_divide("not_useful_sum", F.lit(size.n_not_useful)), F.lit(0.0)).alias(
            "not_useful_mean_tfidf"
        ),
    )
    return means.withColumn("difference", F.col("useful_mean_tfidf") - F.col("not_useful_mean_tfidf"))


def discriminative_terms(means: DataFrame, top_n: int = 50) -> tuple[DataFrame, DataFrame]:
    """The terms that speak most for and most against the useful class."""
    key = F.round("difference", 12)  # equal differences tie whatever order they were summed in
    return (
        means.orderBy(key.desc(), "feature_index").limit(top_n),
        means.orderBy(key.asc(), "feature_index").limit(top_n),
    )


def noise_terms(useful: DataFrame, not_useful: DataFrame, n: int = 50) -> DataFrame:
    """Terms that appear in both top lists."""
    first = useful.orderBy(F.desc("difference"), "feature_index").limit(n)
    second = not_useful.orderBy(F.asc("difference"), "feature_index").limit(n)
    return first.select("feature_name").intersect(second.select("feature_name")).orderBy("feature_name")


def chi2_scores(tfidf_long: DataFrame, labels: DataFrame, vocabulary: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chi-squared statistic of non-negative features against the class."""
    size = class_sizes(labels).first()
    sums = class_sums(tfidf_long, labels, key)
    named = vocabulary.select("feature_index", "feature_name").join(sums, "feature_index", "left")
    named = named.na.fill(0.0, ["useful_sum", "not_useful_sum"])
    total = F.col("useful_sum") + F.col("not_useful_sum")

    def part(observed: str, n_class: int):
        expected = F.lit(n_class / (size.n_useful + size.n_not_useful)) * total
        gap = F.col(observed) - expected
        return F.try_divide(gap * gap, expected)

    return named.select(
        "feature_index",
        "feature_name",
        (part("useful_sum", size.n_useful) + part("not_useful_sum", size.n_not_useful)).alias("chi2"),
    )


def select_k_best(scores: DataFrame, k: int = 1000) -> DataFrame:
    """The ``k`` best scores; of equal scores the later feature wins, undefined ones lose."""
    return scores.orderBy(F.round("chi2", 12).desc_nulls_last(), F.desc("feature_index")).limit(k)


def selected_indices(selected: DataFrame) -> list[int]:
    """Kept feature numbers in ascending order; their number is the ``k`` of the selection."""
    return sorted(r.feature_index for r in selected.select("feature_index").collect())


def slice_features(df: DataFrame, indices: list[int], input_col: str, output_col: str) -> DataFrame:
    """Keep the selected features of a vector column."""
    return VectorSlicer(inputCol=input_col, outputCol=output_col, indices=indices).transform(df)

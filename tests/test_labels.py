import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.operators import labels as L
from docsift.operators.ranking import hash_sample, order_statistic, quantile, range_bucket, segment_by_rank, split_points


def files(spark, n_useful, n_other):
    rows = [(f"u{i:04d}.txt", "useful") for i in range(n_useful)] + [(f"n{i:04d}.txt", "not_useful") for i in range(n_other)]
    return spark.createDataFrame(rows, "filename string, dir string")


@pytest.mark.parametrize("n1,n0", [(40, 60), (3, 11), (7, 7), (1, 9)])
def test_split_proportions(spark, n1, n0):
    table = L.build_labels(files(spark, n1, n0))
    counts = {(r.split, r.label): r.n for r in L.split_label_counts(table).collect()}
    n_test = math.ceil((n1 + n0) * 0.25)
    assert counts["test", "useful"] + counts["test", "not_useful"] == n_test
    assert abs(counts["test", "useful"] - n_test * n1 / (n1 + n0)) <= 1
    assert sum(counts.values()) == n1 + n0
    again = L.build_labels(files(spark, n1, n0))
    assert table.exceptAll(again).count() == 0


def test_split_is_stable_when_files_come(spark):
    before = {r.filename: r.split for r in L.build_labels(files(spark, 400, 400)).collect()}
    after = {r.filename: r.split for r in L.build_labels(files(spark, 404, 400)).collect()}
    assert sum(before[f] != after[f] for f in before) <= 8


def test_no_useful_files(spark):
    assert L.build_labels(files(spark, 0, 5)) is None


def test_one_hot_label_spans_many_buckets(spark):
    """The split ranks rows of one boundary bucket only."""
    rows = spark.range(20000).select(
        F.concat("id", F.lit(".txt")).alias("filename"), F.when(F.col("id") % 3 == 0, "useful").otherwise("not_useful").alias("label")
    )
    keyed = rows.withColumn("k", F.md5("filename"))
    cuts = spark.createDataFrame([("useful", [100, 3000]), ("not_useful", [5000])], "label string, cuts array<bigint>")
    out = segment_by_rank(keyed, "label", F.substring("k", 1, 3), ["k"], cuts).groupBy("label", "segment").count()
    assert {(r.label, r.segment): r["count"] for r in out.collect()} == {
        ("useful", 0): 100, ("useful", 1): 2900, ("useful", 2): 3667, ("not_useful", 0): 5000, ("not_useful", 1): 8333,
    }


def test_folds(spark):
    labels = [0, 1, 0, 0, 1, 1, 0, 0, 0, 1, 0, 0, 1]
    rows = spark.createDataFrame(list(enumerate(labels)), "doc_id bigint, label int")
    folds = [r.fold for r in L.stratified_folds(rows, 3).orderBy("doc_id").collect()]
    ordered = sorted(labels)
    for c in (0, 1):
        want = [sum(1 for x in ordered[f::3] if x == c) for f in range(3)]
        got = [f for f, y in zip(folds, labels) if y == c]
        assert got == sorted(got) and [got.count(f) for f in range(3)] == want


def test_range_buckets(spark):
    rows = spark.range(5000)
    points = split_points(rows, "id", rows_per_bucket=500)
    assert 5 <= len(points) <= 10
    sizes = rows.groupBy(range_bucket("id", points).alias("b")).count().collect()
    assert max(r["count"] for r in sizes) < 1500


def test_order_statistics(spark):
    values = np.concatenate([np.random.default_rng(1).normal(size=3000), np.zeros(1500), [1e6]])
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    ordered = np.sort(values)
    for rank in (0, 17, 1500, 2600, 4499, 4500):
        assert order_statistic(frame, "v", rank, in_memory=50, bins=16) == ordered[rank]
    for q in (0.0, 0.1, 0.5, 0.987, 1.0):
        assert quantile(frame, "v", q) == pytest.approx(np.percentile(values, 100 * q))


def test_hash_sample(spark):
    for n, size in ((5000, 100), (150, 100), (20, 100)):
        rows = spark.range(n)
        first = {r.id for r in hash_sample(rows, "id", size, n).collect()}
        assert len(first) == min(n, size) and first == {r.id for r in hash_sample(rows.repartition(3), "id", size, n).collect()}


def test_attach_labels(spark):
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "filename string")
    labels = spark.createDataFrame([("a", "useful", 1), ("a", "not_useful", 2), ("b", "not_useful", 3)], "filename string, label string, line int")
    assert {r.filename: r.y for r in L.attach_labels(docs, labels, order="line").collect()} == {"a": 1, "b": 0, "c": 0}
    with pytest.raises(Exception, match="unknown label"):
        L.attach_labels(docs, spark.createDataFrame([("a", "maybe")], "filename string, label string")).collect()


def test_resolve_split(spark):
    labels = spark.createDataFrame([("a", "useful", "train"), ("b", "useful", "train"), ("c", "useful", "train"), ("d", "useful", "test")],
                                   "filename string, label string, split string")
    main, useful = (spark.createDataFrame([(f,) for f in names], "filename string") for names in (("a", "d"), ("a", "b")))
    found, missing = L.resolve_split(labels, main, useful, "train")
    assert {r.filename: r.dir for r in found.collect()} == {"a": "not_useful", "b": "useful"}
    assert [r.filename for r in missing.collect()] == ["c"]


def test_balance_and_guards(spark):
    def rows(*ys):
        return spark.createDataFrame([(y,) for y in ys], "y int")

    row = L.class_balance(rows(1, 0, 0, 0, 0, 0, 0)).first()
    assert (row.useful, row.not_useful, row.ratio, row.imbalanced, row.useful_percent) == (1, 6, 6.0, True, 14.3)
    assert not L.class_balance(rows(1, 0, 0, 0, 0, 0)).first().imbalanced
    for ys, text in (((), "no training"), ((0, 0), "no useful"), ((1,), "no not-useful")):
        with pytest.raises(ValueError, match=text):
            L.require_both_classes(L.class_balance(rows(*ys)))
    weights = {r.y: r.weight for r in L.class_weights(rows(1, 0, 0, 0)).collect()}
    assert weights == {1: 2.0, 0: pytest.approx(4 / 6)}
    weighted = L.add_class_weights(rows(1, 0, 0, 0)).agg(F.sum("weight")).first()[0]
    assert weighted == pytest.approx(4.0)

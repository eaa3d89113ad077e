import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from docsift.operators import metrics as M
from docsift.operators import models
from docsift.operators.embed import HashingEncoder, combine, embed_incremental, encode, fit_scaler, split_embeddings
from docsift.operators.neighbours import distances, nearest
from docsift.operators.smote import smote
from pyspark.ml.linalg import SparseVector, Vectors


def points(seed=0, n=240, width=4, share=0.3):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < share).astype(int)
    x = rng.normal(size=(n, width)) + y[:, None] * np.array([1.5, -1.0, 0.0, 0.5])[:width]
    return x, y


def frame(spark, x, y):
    rows = [(i, [float(v) for v in row], int(c)) for i, (row, c) in enumerate(zip(x, y))]
    table = spark.createDataFrame(rows, "doc_id bigint, x array<double>, y int")
    return table.select("doc_id", array_to_vector("x").alias("features"), "y")


def test_logistic_regression_reaches_the_penalised_optimum(spark):
    x, y = points()
    fitted = models.create_classifier("logistic_regression").fit(frame(spark, x, y)).stages[0]
    w, b = fitted.coefficients.toArray(), fitted.intercept
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    residual = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
    assert np.abs(w + x.T @ residual).max() < 5e-2 and abs(residual.sum()) < 5e-2


def test_svm_objective_and_probability(spark):
    x, y = points(1, 160)
    model = models.create_classifier("svm").fit(frame(spark, x, y))
    w, b = model.stages[0].coefficients.toArray(), model.stages[0].intercept
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))

    def loss(w, b):
        return 0.5 * w @ w + (weight * np.maximum(0, 1 - (2 * y - 1) * (x @ w + b))).sum()

    best, rng = loss(w, b), np.random.default_rng(0)
    for _ in range(300):
        assert loss(w + rng.normal(size=4) * 0.05, b + rng.normal() * 0.05) > best * 0.998
    rows = models.score(model, frame(spark, x, y)).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.prediction == r.y for r in rows]) > 0.7
    order = np.argsort([float(x[r.doc_id] @ w) for r in rows])
    assert np.all(np.diff(np.array([r.score for r in rows])[order]) >= -1e-9)


def test_random_forest(spark):
    x, y = points(2)
    model = models.create_classifier("random_forest").fit(frame(spark, x, y))
    assert model.stages[0].getNumTrees == 100
    rows = models.score(model, frame(spark, x, y)).collect()
    assert np.mean([r.prediction == r.y for r in rows]) > 0.8 and all(0 <= r.score <= 1 for r in rows)


def test_isolation_forest(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(380, 3)), rng.normal(size=(20, 3)) * 0.2 + 9])
    rows = frame(spark, x, np.zeros(400))
    model = models.create_classifier("random_forest", mode="unsupervised").fit(rows)
    out = model.score(rows).toPandas().set_index("doc_id").sort_index()
    assert 35 <= out["prediction"].sum() <= 40  # a tenth of the rows
    assert out["prediction"].iloc[380:].mean() > 0.9 and out["score"].between(-1, 0).all()
    assert out.equals(model.score(rows).toPandas().set_index("doc_id").sort_index())


def test_factory_and_guards(spark):
    with pytest.raises(ValueError, match="unknown model type"):
        models.create_classifier("tree")
    assert isinstance(models.create_classifier("svm", mode="unsupervised"), models.SvmClassifier)
    with pytest.raises(ValueError, match="supervised"):
        models.cross_validate(models.create_classifier("random_forest", mode="unsupervised"), frame(spark, *points()))


def test_cross_validation(spark):
    folds = models.cross_validate(models.create_classifier(), frame(spark, *points(4)))
    rows = folds.orderBy("fold").collect()
    assert [r.fold for r in rows] == list(range(5)) and all(0.5 < r.f1 <= 1 for r in rows)
    summary = M.cv_summary(folds).first()
    assert summary.std == pytest.approx(np.std([r.f1 for r in rows]))


def test_top_features(spark):
    x, y = points()
    model = models.create_classifier().fit(frame(spark, x, y))
    vocabulary = spark.createDataFrame([(i, f"t{i}") for i in range(4)], "feature_index int, feature_name string")
    coefficients = model.stages[0].coefficients.toArray()
    got = [(r.feature_index, r.weight) for r in models.model_top_features(model, vocabulary, 3).collect()]
    assert got == [(int(i), coefficients[i]) for i in np.argsort(-np.abs(coefficients))[:3]]


def test_confusion_example(spark):
    counts = spark.createDataFrame([(54, 19, 6, 5)], "tn bigint, fp bigint, fn bigint, tp bigint")
    rates = M.rates(counts).first()
    assert (rates.accuracy, rates.precision, rates.recall) == pytest.approx((59 / 84, 5 / 24, 5 / 11))
    pct = [round(r.row_pct, 1) for r in M.confusion_pct(counts).collect()]
    assert pct == [74.0, 26.0, 54.5, 45.5]
    empty = spark.createDataFrame([(3, 0, 0, 0)], "tn bigint, fp bigint, fn bigint, tp bigint")
    assert tuple(M.rates(empty).first())[4:] == (1.0, 0.0, 0.0, 0.0)
    assert M.confusion(empty).count() == 4


def test_neighbours_exact_in_both_ways(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 5)) * 4
    x = np.vstack([centres[i % 9] + rng.normal(size=5) * 0.3 for i in range(500)])
    table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "key bigint, x array<double>")
    gaps = distances(x, x)
    np.fill_diagonal(gaps, np.inf)
    want = np.sort(gaps, axis=1)[:, :4]
    for options in ({}, {"max_bytes": 0, "block_rows": 30}):
        found = nearest(table, 4, **options).toPandas().sort_values(["key", "gap"])
        assert np.allclose(np.vstack(found.groupby("key")["gap"].apply(list)), want)
        assert np.allclose(found["gap"], [gaps[a, b] for a, b in zip(found["key"], found["near"])], atol=1e-6)


@pytest.mark.parametrize("options", [{}, {"max_bytes": 0}])
def test_smote_properties(spark, options):
    rng = np.random.default_rng(6)
    useful = np.vstack([rng.normal(size=(20, 3)), np.repeat(rng.normal(size=(1, 3)), 12, axis=0)])
    x = np.vstack([useful, rng.normal(size=(300, 3)) + 5])
    rows = frame(spark, x, [1] * 32 + [0] * 300)
    out = smote(rows, **options).select("doc_id", "y", "synthetic", vector_to_array("features").alias("x")).toPandas()
    made = out[out["synthetic"]]
    assert len(made) == 300 - 32 and (made["y"] == 1).all() and out["doc_id"].is_unique
    gaps = distances(useful, useful)
    for point in np.vstack(made["x"]):
        # On the line between a useful row and one of its five nearest.
        on_line = False
        for i in range(32):
            others = [j for j in np.argsort(gaps[i], kind="stable") if j != i]
            edge = gaps[i][others[4]] + 1e-6
            for j in (j for j in others if gaps[i][j] <= edge):
                step, offset = useful[j] - useful[i], point - useful[i]
                u = 0.0 if step @ step == 0 else float(np.clip(offset @ step / (step @ step), 0, 1))
                on_line = on_line or np.linalg.norm(offset - u * step) < 1e-7
        assert on_line
    again = smote(rows, **options).select("doc_id", vector_to_array("features")[0].alias("v")).toPandas()
    assert dict(zip(out["doc_id"], out["x"].str[0])) == dict(zip(again["doc_id"], again["v"]))


def test_smote_of_names_and_sparse_vectors(spark):
    rng = np.random.default_rng(8)
    dense = np.where(rng.random((90, 40)) < 0.1, rng.random((90, 40)), 0.0)
    dense[:12, 0] += 1
    rows = [(f"paper_{i}", Vectors.sparse(40, {int(j): float(v[j]) for j in np.flatnonzero(v)}), int(i < 12)) for i, v in enumerate(dense)]
    table = spark.createDataFrame(rows, ["doc_id", "features", "y"])
    out = smote(table, origins=True).filter("synthetic").collect()
    assert len(out) == 78 - 12 and len({r.doc_id for r in out}) == len(out) and all(r.doc_id.startswith(r.base + "#") for r in out)
    number = {f"paper_{i}": dense[i] for i in range(12)}
    for r in out:
        assert isinstance(r.features, SparseVector)
        assert np.abs(number[r.base] + r.share * (number[r.near] - number[r.base]) - r.features.toArray()).max() < 1e-12


def test_synthetic_rows_of_one_much_copied_row_are_dealt_out(spark):
    x = np.vstack([np.zeros((30, 3)), [[1.0, 1.0, 1.0]], np.ones((4000, 3)) * 5])
    rows = frame(spark, x, [1] * 31 + [0] * 4000).withColumn("doc_id", F.xxhash64("doc_id") % (1 << 62) + (1 << 62))
    made = smote(rows, chunk=100, origins=True).filter("synthetic")
    assert made.count() == 4000 - 31 and made.select("doc_id").distinct().count() == 4000 - 31
    assert made.agg(F.max("doc_id")).first()[0] < 0
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(sequence" in plan
    sizes = [r["count"] for r in made.groupBy("base").count().collect()]
    assert max(sizes) > 3000  # the copies are one base, whose rows come from many chunks


def test_smote_not_needed_or_impossible(spark):
    x, _ = points(7, 60)
    assert smote(frame(spark, x, [1] * 10 + [0] * 50)).filter("synthetic").count() == 0
    assert smote(frame(spark, x, [1] + [0] * 59)).filter("synthetic").count() == 0
    assert smote(frame(spark, x, [1] * 2 + [0] * 58)).filter("synthetic").count() == 56


def test_embeddings(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, " "), (3, "gamma"), (4, "delta")], "doc_id bigint, clean string")
    cache = spark.createDataFrame([(3, [1.0, 0.0]), (4, [1.0]), (9, [0.0, 1.0]), (2, None)], "doc_id bigint, embedding array<float>")
    hits, misses = split_embeddings(docs, cache, 2)
    assert [r.doc_id for r in hits.collect()] == [3] and {r.doc_id for r in misses.collect()} == {1, 2, 4}
    every, new = embed_incremental(docs, cache, HashingEncoder(2), 2)
    got = {r.doc_id: r.embedding for r in every.collect()}
    assert got[3] == [1.0, 0.0] and got[2] == [0.0, 0.0] and len(got) == 4 and new.count() == 3
    assert np.linalg.norm(got[4]) == pytest.approx(1.0)
    upper = embed_incremental(docs, cache, HashingEncoder(2), 2, prepare=lambda d: d.withColumn("clean", F.upper("clean")))[1]
    assert {r.doc_id for r in upper.collect()} == {1, 2, 4}
    with pytest.raises(Exception, match="encoder returned"):
        encode(docs, lambda texts: np.zeros((len(texts), 3)), 2).collect()


def test_combined_features_and_scaler(spark):
    tfidf = spark.createDataFrame([(1, [0.6, 0.0, 0.8]), (2, [1.0, 0.0, 0.0])], "doc_id bigint, t array<double>")
    tfidf = tfidf.select("doc_id", array_to_vector("t").alias("tfidf"))
    emb = spark.createDataFrame([(1, [0.5, -2.0]), (2, [0.25, 1.0])], "doc_id bigint, embedding array<float>")
    raw = combine(tfidf, emb, "combined").orderBy("doc_id")
    assert [list(r.features_raw.toArray()) for r in raw.collect()] == [[0.6, 0, 0.8, 0.5, -2.0], [1.0, 0, 0, 0.25, 1.0]]
    scaled = fit_scaler(raw).transform(raw).orderBy("doc_id").collect()
    assert np.allclose(scaled[0].features.toArray(), [0.6, 0, 1.0, 1.0, -1.0])
    assert combine(tfidf, None, "tfidf").first().features_raw.size == 3
    assert combine(tfidf, emb, "semantic").first().features_raw.size == 2
    with pytest.raises(ValueError):
        combine(tfidf, emb, "both")

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.operators import selection as S
from docsift.operators.tfidf import Tfidf, TfidfModel, term_stats

TEXTS = [
    "apple banana apple cherry", "banana cherry date", "apple banana elder", "cherry banana apple", "date apple fig",
    "banana banana apple", "grape apple banana cherry", "",
]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "doc_id bigint, clean string, y int")


def grams(text):
    words = text.split()
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def expected(texts, min_df, top):
    bags = [Counter(grams(t)) for t in texts]
    df = Counter(t for b in bags for t in b)
    ctf = sum(bags, Counter())
    vocab = sorted(sorted((t for t in df if df[t] >= min_df), key=lambda t: (-ctf[t], t))[:top])
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in vocab}
    matrix = np.array([[b[t] * idf[t] for t in vocab] for b in bags], dtype=float).reshape(len(texts), len(vocab))
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return vocab, np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


@pytest.mark.parametrize("min_df,top", [(1, 100), (2, 100), (2, 4), (1, 7), (1, 5), (3, 2)])
def test_fit_matches_definition(spark, min_df, top):
    docs = frame(spark)
    model = Tfidf(top, (1, 2), min_df).fit(docs)
    vocab, matrix = expected(TEXTS, min_df, top)
    assert model.feature_names == vocab
    got = np.array([r.tfidf.toArray() for r in model.transform(docs).orderBy("doc_id").collect()])
    assert np.abs(got - matrix).max() < 1e-12
    long = np.zeros_like(matrix)
    for r in model.transform_long(docs).collect():
        long[r.doc_id, r.feature_index] = r.tfidf
    assert np.abs(long - matrix).max() < 1e-12


def test_pruned_bigrams_equal_full_count(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join("q" + "abcdefghij"[i] for i in rng.zipf(1.5, 30) % 10) for _ in range(60)]
    for top in (5, 12, 30, 200):
        assert Tfidf(top, (1, 2), 3).fit(frame(spark, texts)).feature_names == expected(texts, 3, top)[0]


def test_other_ngrams(spark):
    assert Tfidf(100, (1, 1), 2).fit(frame(spark)).feature_names == ["apple", "banana", "cherry", "date"]
    assert "banana apple" in Tfidf(100, (2, 2), 2).fit(frame(spark)).feature_names


def test_unseen_terms_and_empty_vocabulary(spark):
    model = Tfidf(100, (1, 2), 2).fit(frame(spark))
    unseen = spark.createDataFrame([(1, "zebra apple"), (2, "zebra")], "doc_id bigint, clean string")
    assert [(r.doc_id, round(r.tfidf, 9)) for r in model.transform_long(unseen).collect()] == [(1, 1.0)]
    with pytest.raises(ValueError, match="empty"):
        TfidfModel((), 0, (1, 2), ()).transform(unseen)


def test_transform_does_not_shuffle(spark):
    docs = frame(spark)
    long = Tfidf(100, (1, 2), 2).fit(docs).transform_long(docs)
    assert "Exchange" not in long._jdf.queryExecution().executedPlan().toString()


def test_term_stats(spark):
    docs = spark.createDataFrame([(["a", "a", "b"],), (["a"],), ([],)], "terms array<string>")
    assert {(r.term, r.df, r.ctf) for r in term_stats(docs).collect()} == {("a", 2, 3), ("b", 1, 1)}


def test_chi2_and_means(spark):
    docs = frame(spark)
    model = Tfidf(100, (1, 2), 2).fit(docs)
    _, matrix = expected(TEXTS, 2, 100)
    y = np.array([i % 2 for i in range(len(TEXTS))])
    observed = np.vstack([matrix[y == c].sum(axis=0) for c in (0, 1)])
    wanted = np.array([[np.mean(y == c)] for c in (0, 1)]) * matrix.sum(axis=0)
    chi2 = ((observed - wanted) ** 2 / wanted).sum(axis=0)
    long = model.transform_long(docs)
    scores = S.chi2_scores(long, docs, model.vocabulary(spark))
    got = {r.feature_index: r.chi2 for r in scores.collect()}
    assert np.allclose([got[i] for i in range(len(chi2))], chi2)
    best = S.selected_indices(S.select_k_best(scores, 3))
    assert best == sorted(np.lexsort((-np.arange(len(chi2)), -np.round(chi2, 12)))[:3])
    sliced = S.slice_features(model.transform(docs), best, "tfidf", "few").orderBy("doc_id").collect()
    assert np.allclose([r.few.toArray() for r in sliced], matrix[:, best])
    means = S.class_means(long, docs, model.vocabulary(spark))
    diff = matrix[y == 1].mean(axis=0) - matrix[y == 0].mean(axis=0)
    assert np.allclose([r.difference for r in means.orderBy("feature_index").collect()], diff)
    useful, not_useful = S.discriminative_terms(means, 2)
    assert [r.feature_index for r in useful.collect()] == list(np.lexsort((np.arange(len(diff)), -np.round(diff, 12)))[:2])
    overlap = S.noise_terms(*S.discriminative_terms(means, len(diff)), len(diff))
    assert overlap.count() == len(diff)


def test_undefined_chi2_loses(spark):
    scores = spark.createDataFrame([(0, 1.0), (1, None), (2, 1.0)], "feature_index int, chi2 double")
    assert S.selected_indices(S.select_k_best(scores, 1)) == [2]

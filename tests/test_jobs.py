"""Training, scoring and streams on small corpora."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.config import TrainConfig
from docsift.operators import labels as L
from docsift.operators.embed import HashingEncoder, encode
from docsift.plans.predict import evaluate_batch, exchange_job, predict_job, score_documents
from docsift.plans.train import semantic_column, train_job
from docsift.sources.registry import load_latest
from docsift.streaming.labels import feedback_stream, label_stream, read_labels
from docsift.streaming.score import document_stream, score_stream

USEFUL_WORDS = "magnetic field exposure electric current tissue coil induction".split()
OTHER_WORDS = "software database compiler network server query index cache".split()
SHARED_WORDS = "paper section number example system model table line".split()


def corpus(spark, n_useful, n_other, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n_useful + n_other):
        words = (USEFUL_WORDS if i < n_useful else OTHER_WORDS) + SHARED_WORDS
        rows.append((i, f"{i:05d}.txt", " ".join(rng.choice(words, 25)) + f" [{i}] see http://x.y/{i}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, filename string, text string")
    folder = F.when(F.col("doc_id") < n_useful, "useful").otherwise("not_useful")
    return docs, L.build_labels(docs.select("filename", folder.alias("dir")))


@pytest.fixture(scope="module")
def words_model(spark, tmp_path_factory):
    """Pure TF-IDF mode on an imbalanced corpus, with a blank document, saved."""
    docs, labels = corpus(spark, 14, 90)
    docs = docs.withColumn("text", F.when(F.col("doc_id") == 50, F.lit(" \n")).otherwise(F.col("text")))
    out = str(tmp_path_factory.mktemp("train"))
    config = TrainConfig(feature_mode="tfidf", chi2_k=20, top_n=5)
    return docs, labels, out, train_job(spark, docs, labels, config, output=out)


def test_words_training(spark, words_model):
    docs, labels, out, result = words_model
    assert result.balance.first().imbalanced
    assert len(result.selected) == 20 and result.selected == sorted(result.selected)
    assert {r.feature_name for r in result.useful_terms.collect()} & set(USEFUL_WORDS)
    assert {r.feature_name for r in result.not_useful_terms.collect()} & set(OTHER_WORDS)
    assert result.top_features.count() == 10 and result.cv.count() == 5
    flags = result.flags.first()
    assert flags.test_accuracy > 0.9 and not flags.poor_cv and flags.imbalanced
    test_names = {r.filename for r in labels.filter("split = 'test'").collect()} - {"00050.txt"}
    assert {r.filename for r in result.predictions.collect()} == test_names
    assert result.comparison.count() == 5


def test_saved_outputs(spark, words_model):
    docs, labels, out, result = words_model
    kept = spark.read.parquet(out + "/cleaned")
    assert kept.count() == 103 and set(kept.columns) >= {"clean", "label", "split"}
    assert spark.read.csv(out + "/selected_features", header=True).count() == 20
    assert spark.read.json(out + "/classification_report").count() == 5
    loaded = load_latest(spark, out + "/registry", "txt", "logistic_regression")
    again = score_documents(loaded, docs).orderBy("doc_id").select("doc_id", "prediction", "score")
    assert again.collect() == score_documents(result.pipeline, docs).orderBy("doc_id").select("doc_id", "prediction", "score").collect()


def test_prediction_skips_blank_and_does_not_shuffle(spark, words_model):
    docs, _, _, result = words_model
    routed = predict_job(result.pipeline, docs)
    assert routed.filter("doc_id = 50").count() == 0 and routed.count() == 103
    assert "Exchange" not in routed._jdf.queryExecution().executedPlan().toString()
    blank = score_documents(result.pipeline, docs.filter("doc_id = 50"), skip_blank=False).first()
    assert blank.prediction in (0, 1) and 0 <= blank.score <= 1
    rows = routed.collect()
    assert {r.route for r in rows} <= {"useful", "not_useful", "manual_check"}
    assert all(r.uncertain == (r.confidence < 75) and (r.route == "manual_check") == r.uncertain for r in rows)


def test_exchange(spark, words_model):
    result = words_model[3]
    items = [{"id": "u", "content": " ".join(USEFUL_WORDS * 3)}, {"id": "b", "content": " 12 "}, {"id": "o", "content": " ".join(OTHER_WORDS * 3)}]
    batches = spark.createDataFrame([(1, json.dumps(items))], "batch_id int, payload string")
    answer = json.loads(exchange_job(result.pipeline, batches).first().payload)
    assert answer[1] is None and answer[0]["relevant"] is True and answer[2]["relevant"] is False
    assert all(50 <= a["score"] <= 100 for a in (answer[0], answer[2]))


def test_evaluation(spark, words_model):
    docs, labels, _, result = words_model
    known = labels.filter(F.col("filename") != "00003.txt")
    report = evaluate_batch(result.pipeline, docs, known)
    assert [r.filename for r in report["skipped"].collect()] == ["00003.txt"]
    assert report["scored"].count() == 103 and report["accuracy"].first().accuracy > 0.9
    assert {r["class"] for r in report["report"].collect()} == {"useful", "not_useful", "accuracy", "macro avg", "weighted avg"}
    cached = docs.filter("doc_id = 0").select("doc_id", F.lit(" ".join(OTHER_WORDS * 4)).alias("text"))
    swapped = evaluate_batch(result.pipeline, docs, labels, cached)["scored"]
    assert swapped.filter("doc_id = 0").first().prediction == 0


@pytest.mark.parametrize("mode", ["combined", "semantic"])
def test_modes_with_embeddings(spark, mode):
    docs, labels = corpus(spark, 40, 50, 1)
    cache = encode(docs.filter("doc_id < 30").withColumn("clean", F.col("text")), HashingEncoder(16), 16)
    config = TrainConfig(feature_mode=mode, embedding_dim=16, cv_folds=2)
    result = train_job(spark, docs, labels, config, cache=cache)
    assert result.new_embeddings.count() == 60 and result.selected == []
    classifier = result.pipeline.stages[-1]
    assert classifier.numFeatures == 16 + (len(result.tfidf.entries) if mode == "combined" else 0)
    assert result.flags.first().test_accuracy > 0.7
    every = encode(docs.withColumn("clean", F.col("text")), HashingEncoder(16), 16)
    scored = score_documents(result.pipeline, docs.join(semantic_column(every), "doc_id"))
    assert scored.count() == 90


def test_guards(spark):
    docs, labels = corpus(spark, 3, 5)
    with pytest.raises(ValueError, match="no useful"):
        train_job(spark, docs, labels.withColumn("label", F.lit("not_useful")), TrainConfig(feature_mode="tfidf"))
    for bad in ({"model_type": "tree"}, {"feature_mode": "both"}):
        with pytest.raises(ValueError, match="unknown"):
            TrainConfig(**bad)


def test_document_stream_equals_batch(spark, words_model, tmp_path):
    docs, _, _, result = words_model
    source = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    source.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = document_stream(spark, str(tmp_path / "in"), files_per_batch=2)
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        score_stream(result.pipeline, stream, out, str(tmp_path / "state"), once=True).awaitTermination()
    got = spark.read.parquet(out).orderBy("doc_id").select("doc_id", "prediction", "score", "route").collect()
    assert got == predict_job(result.pipeline, source).orderBy("doc_id").select("doc_id", "prediction", "score", "route").collect()


def test_label_stream(spark, tmp_path):
    schema = "record_id string, filename string, decision string, created_at string"
    log, out, state = (str(tmp_path / name) for name in ("log", "out", "state"))

    def append(*rows):
        spark.createDataFrame(rows, schema).write.mode("append").json(log)
        stream = feedback_stream(spark, log, spark.createDataFrame([], schema).schema)
        label_stream(stream, out, state, once=True).awaitTermination()
        return {r.filename: r.new_label for r in read_labels(spark, out).collect()}

    assert append(("1", "a", "useful", "2026-01-02"), ("2", "b", "useful", "2026-01-01")) == {"a": "useful", "b": "useful"}
    later = append(("3", "b", "not_useful", "2026-01-03"), ("0", "a", "not_useful", "2026-01-01"), ("4", "c", "useful", "2026-01-01"))
    assert later == {"a": "useful", "b": "not_useful", "c": "useful"}


def test_shared_dir(spark):
    from docsift.session import shared_dir

    assert spark.conf.get("spark.checkpoint.dir") == shared_dir(spark)

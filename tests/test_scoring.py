"""Files in, model out: ids by stem, embeddings from cache or encoder, scoring of new files in all modes."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.config import TrainConfig
from docsift.operators import labels as L
from docsift.operators.embed import HashingEncoder, encode_texts, with_semantic
from docsift.plans.predict import evaluate_batch, exchange_job, predict_folder, score_documents, semantic_width
from docsift.plans.train import train_job
from docsift.sources.ids import assign_ids, known_ids, read_numbered, stem_code, with_ids
from docsift.sources.registry import load_latest
from docsift.streaming.score import document_stream, score_stream

from test_jobs import OTHER_WORDS, SHARED_WORDS, USEFUL_WORDS


def names(spark, *stems):
    return spark.createDataFrame([(s,) for s in stems], "stem string")


def as_dict(ids):
    rows = ids.collect()
    assert len({r.stem for r in rows}) == len(rows)
    return {r.stem: r.doc_id for r in rows}


def test_ids_do_not_depend_on_the_batch(spark, tmp_path):
    every = [f"paper_{i}" for i in range(200)]
    ids = as_dict(assign_ids(names(spark, *every, *every[:5], None)))
    assert set(ids) == set(every) and len(set(ids.values())) == 200 and min(ids.values()) >= 0
    assert as_dict(assign_ids(names(spark, *every[50:60]))) == {s: ids[s] for s in every[50:60]}
    path = str(tmp_path / "ids")
    for part in (every[:70], every[:70], every[40:]):
        docs = spark.createDataFrame([(s, "t") for s in part], "doc_id string, text string")
        got = {r.stem: r.doc_id for r in with_ids(docs, path).collect()}
        assert got == {s: ids[s] for s in part}
    assert known_ids(spark, path).count() == 200 and known_ids(spark, str(tmp_path / "none")) is None


def test_shared_codes_are_resolved(spark):
    few = lambda name, attempt: F.pmod(stem_code(name, attempt), F.lit(64))
    first = assign_ids(names(spark, *[f"a{i}" for i in range(12)]), code=few).persist()
    held = as_dict(first)
    assert len(set(held.values())) == 12
    more = as_dict(assign_ids(names(spark, *[f"a{i}" for i in range(12)], *[f"b{i}" for i in range(20)]), first, few))
    assert len(more) == 20 and len({*held.values(), *more.values()}) == 32


def test_batches_are_bounded_after_padding():
    rng = np.random.default_rng(1)
    texts = ["x" * int(n) for n in rng.geometric(0.01, 2000)] + ["", " ", "y" * 5000]
    seen = []

    def encoder(batch):
        seen.append([len(t) for t in batch])
        return np.array([[len(t), 1] for t in batch])

    vectors = encode_texts(encoder, texts, 2, cells=4000)
    assert [int(v) for v in vectors[:, 0]] == [len(t) if t.strip() else 0 for t in texts]
    assert all(max(b) * len(b) <= 4000 or len(b) == 1 for b in seen)
    assert sum(max(b) * len(b) for b in seen) < 1.3 * sum(map(sum, seen))
    with pytest.raises(ValueError, match="expected"):
        encode_texts(lambda batch: np.zeros((len(batch), 3)), ["a"], 2)


def test_only_misses_are_encoded(spark):
    def refusing(texts):
        assert not any("cachedtext" in t for t in texts)
        return HashingEncoder(4)(texts)

    docs = spark.createDataFrame([(1, "cachedtext a"), (2, "b c"), (3, "wrong length"), (4, None), (None, "d"), (1, "cachedtext a")], "doc_id bigint, clean string")
    cache = [(1, [0.5] * 4), (1, [0.5] * 4), (3, [1.0] * 3), (2, [1.0, None, 1.0, 1.0]), (9, [2.0] * 4)]
    cache = spark.createDataFrame(cache, "doc_id bigint, embedding array<float>")
    got = with_semantic(docs, cache, refusing, 4).collect()
    assert len(got) == 6 and all(len(r["_semantic"]) == 4 for r in got)
    assert {r.doc_id: r["_encoded"] for r in got} == {1: False, 2: True, 3: True, 4: True, None: True}
    assert [list(r["_semantic"]) for r in got if r.doc_id == 1] == [[0.5] * 4] * 2
    assert [list(r["_semantic"]) for r in got if r.doc_id == 4] == [[0.0] * 4]
    assert with_semantic(docs.limit(0), cache, refusing, 4).count() == 0


def write_papers(folder, numbers, seed):
    rng = np.random.default_rng(seed)
    folder.mkdir(exist_ok=True)
    for n in numbers:
        words = (USEFUL_WORDS if n % 8 == 0 else OTHER_WORDS) + SHARED_WORDS
        (folder / f"paper_{n}.txt").write_text(" ".join(rng.choice(words, 40)))


@pytest.mark.parametrize("mode", ["tfidf", "semantic", "combined"])
def test_files_in_model_out(spark, tmp_path, mode):
    write_papers(tmp_path / "train", range(120), 1)
    ids, out = str(tmp_path / "ids"), str(tmp_path / "out")
    docs = read_numbered(spark, str(tmp_path / "train"), ids)
    folder = F.when(F.col("stem").substr(7, 9).cast("int") % 8 == 0, "useful").otherwise("not_useful")
    labels = L.build_labels(docs.select("filename", folder.alias("dir")))
    config = TrainConfig(feature_mode=mode, embedding_dim=32, cv_folds=2, chi2_k=20, top_n=5)
    result = train_job(spark, docs, labels, config, encoder=HashingEncoder(32), output=out)
    assert result.balance.first().imbalanced and result.flags.first().test_accuracy > 0.8
    write_papers(tmp_path / "new", range(112, 130), 2)
    (tmp_path / "new" / "blank.txt").write_text(" \n")
    cache = f"{out}/embeddings"
    kinds = {} if mode == "tfidf" else {"encoder": HashingEncoder(32), "cache_path": cache}
    before = 0 if mode == "tfidf" else spark.read.parquet(cache).count()
    args = (spark, str(tmp_path / "new"), f"{out}/registry", ids)
    got = {r.stem: r for r in predict_folder(*args, **kinds).collect()}
    assert set(got) == {f"paper_{n}" for n in range(112, 130)}
    right = [got[f"paper_{n}"].prediction == (n % 8 == 0) for n in range(112, 130)]
    assert sum(right) >= 16 and all(0 <= r.score <= 1 and r.route for r in got.values())
    if mode != "tfidf":
        loaded = load_latest(spark, f"{out}/registry", "txt", "logistic_regression")
        assert semantic_width(loaded) == 32
        # 112 to 119 were cached in training, the ten others are new; a second run encodes nothing
        assert spark.read.parquet(cache).count() == before + 10
        again = {r.stem: r.score for r in predict_folder(*args, **kinds).collect()}
        assert again == {s: r.score for s, r in got.items()} and spark.read.parquet(cache).count() == before + 10
        with pytest.raises(ValueError, match="encoder"):
            score_documents(loaded, docs)
    with pytest.raises(FileNotFoundError):
        predict_folder(*args, model_type="svm")


def test_jobs_with_embeddings(spark, tmp_path):
    write_papers(tmp_path / "train", range(96), 3)
    docs = read_numbered(spark, str(tmp_path / "train"), str(tmp_path / "ids"))
    folder = F.when(F.col("stem").substr(7, 9).cast("int") % 8 == 0, "useful").otherwise("not_useful")
    labels = L.build_labels(docs.select("filename", folder.alias("dir")))
    encoder = HashingEncoder(16)
    result = train_job(spark, docs, labels, TrainConfig(embedding_dim=16, cv_folds=2), encoder=encoder)
    cache = result.new_embeddings.filter("doc_id % 2 = 0")
    report = evaluate_batch(result.pipeline, docs, labels, cache=cache, encoder=encoder)
    assert report["scored"].count() == 96 and report["accuracy"].first().accuracy > 0.9
    items = [{"id": "u", "content": " ".join(USEFUL_WORDS * 4)}, {"id": "b", "content": " 12 "}, {"id": "o", "content": " ".join(OTHER_WORDS * 4)}]
    batches = spark.createDataFrame([(1, json.dumps(items))], "batch_id int, payload string")
    answer = json.loads(exchange_job(result.pipeline, batches, encoder=encoder).first().payload)
    assert answer[1] is None and answer[0]["relevant"] is True and answer[2]["relevant"] is False
    source = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = document_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    for _ in range(2):  # the second run finds nothing new
        score_stream(result.pipeline, stream, str(tmp_path / "scored"), str(tmp_path / "state"), True, cache, encoder).awaitTermination()
    got = {r.doc_id: r.score for r in spark.read.parquet(str(tmp_path / "scored")).collect()}
    want = {r.doc_id: r.score for r in score_documents(result.pipeline, source, cache=cache, encoder=encoder).collect()}
    assert got == pytest.approx(want) and len(got) == 96

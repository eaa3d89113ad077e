"""What jobs hold for a second reading lies on disk, and what they write is not gathered before."""

import pytest

from docsift.operators.models import held_for_fitting
from docsift.operators.tfidf import Tfidf
from docsift.plans.catalogue import QUERIES
from docsift.streaming import score

from test_stream_tables import layouts  # noqa: F401


@pytest.fixture
def held(spark, monkeypatch):
    """Columns and storage level of every table that is persisted."""
    frame, found = type(spark.range(0)), []
    persist = frame.persist

    def recorded(self, *level, **named):
        out = persist(self, *level, **named)
        found.append((self.columns, out.storageLevel))
        return out

    monkeypatch.setattr(frame, "persist", recorded)
    return found


def test_words_are_held_on_disk(spark, held):
    docs = spark.createDataFrame([(i, "alpha beta gamma") for i in range(6)], "doc_id int, clean string")
    model = Tfidf().fit(docs)
    assert model.n_docs == 6 and model.feature_names == ["alpha", "alpha beta", "beta", "beta gamma", "gamma"]
    levels = [level for columns, level in held if columns == ["words"]]
    assert levels and all(level.useDisk and not level.useMemory for level in levels)


def test_rows_of_a_fit_are_held_on_disk(spark):
    rows = spark.range(0, 100, 1, 4)
    with held_for_fitting(rows, 100) as packed:
        assert rows.storageLevel.useDisk and not rows.storageLevel.useMemory
        assert packed.storageLevel.useDisk and not packed.storageLevel.useMemory
        assert packed.rdd.getNumPartitions() == 1 and sorted(r.id for r in packed.collect()) == list(range(100))
    assert not rows.storageLevel.useDisk and not packed.storageLevel.useDisk


def test_stream_keeps_a_file_open_for_each_route(spark, tmp_path, monkeypatch):
    kinds = "CASE doc_id % 3 WHEN 0 THEN 'useful' WHEN 1 THEN 'not_useful' ELSE 'manual_check' END AS route"
    monkeypatch.setattr(score, "predict_job", lambda pipeline, docs, **_: docs.selectExpr("*", kinds))
    docs = spark.range(0, 90, 1, 3).selectExpr("id AS doc_id", "repeat('a', 20) AS text")
    docs.write.parquet(str(tmp_path / "in"))
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    for given, then in (("0", "3"), ("7", "7")):
        spark.conf.set(writers, given)
        stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
        out = str(tmp_path / f"out{given}")
        score.score_stream(None, stream, out, str(tmp_path / f"state{given}"), once=True).awaitTermination()
        assert spark.conf.get(writers) == then
        routes = {r.doc_id: r.route for r in spark.read.parquet(out).collect()}
        assert routes == {i: ("useful", "not_useful", "manual_check")[i % 3] for i in range(90)}
    spark.conf.unset(writers)


@pytest.mark.parametrize("name", ["predict_combined", "stream_combined"])
def test_words_and_embeddings_leave_no_texts_in_memory(spark, layouts, held, name):  # noqa: F811
    got = QUERIES[name](spark, layouts[0]).collect()
    assert sorted(r.doc_id for r in got) == list(range(80))
    texts = [level for columns, level in held if {"words", "clean", "text"} & set(columns)]
    assert texts and not any(level.useMemory for level in texts)

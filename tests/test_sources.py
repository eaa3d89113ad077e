import json

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from docsift.functions import paths, scoring
from docsift.operators.tfidf import TextCleaner
from docsift.sources import cache, exchange, files, pages, registry, sinks


def test_listing_and_reading(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes("naïve\r\ntext\rend".encode())
    (tmp_path / "a.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "c.pdf").write_bytes(b"x" * 2048)
    listed = files.list_files(spark, str(tmp_path)).collect()
    assert [r.filename for r in listed] == ["a.txt", "b.txt"]
    assert files.list_files(spark, str(tmp_path), "pdf").first().size_kb == 2.0
    plan = files.list_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    with pytest.raises(ValueError):
        files.list_files(spark, str(tmp_path), "doc")
    texts = {r.doc_id: r.text for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert texts == {"a": "café", "b": "naïve\ntext\nend"}


def test_paths(spark):
    rows = spark.createDataFrame([("d/x.tar.GZ",), (".hidden",), ("plain",), ("file:/a/b.txt",)], "p string")
    out = rows.select(paths.file_name(F.col("p")), paths.stem(F.col("p")), paths.suffix(F.col("p"))).collect()
    assert [tuple(r) for r in out] == [
        ("x.tar.GZ", "x.tar", ".GZ"), (".hidden", ".hidden", ""), ("plain", "plain", ""), ("b.txt", "b", ".txt"),
    ]
    names = spark.createDataFrame([(7,), (1234567,)], "i bigint").select(paths.document_filename(F.col("i")).alias("n"))
    assert [r.n for r in names.collect()] == ["00007.txt", "1234567.txt"]


def test_dispatch_and_merge(spark):
    rows = spark.createDataFrame([("a.PDF",), ("b.txt",), ("c.doc",)], "path string")
    known, other = files.by_file_type(rows)
    assert {(r.path, r.file_type) for r in known.collect()} == {("a.PDF", "pdf"), ("b.txt", "txt")}
    assert [r.path for r in other.collect()] == ["c.doc"]
    texts = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "x", 1)], "doc_id string, text string, priority int")
    assert {(r.doc_id, r.text) for r in files.merge_by_stem(texts).collect()} == {("a", "new"), ("b", "x")}


def test_pages_in_blocks_equal_pages_at_once(spark):
    rows = [(1, i, f"p{i}") for i in range(50)] + [(1, 50, ""), (1, 51, None), (2, 1, "b"), (2, 0, "a"), (3, 0, "")]
    table = spark.createDataFrame(rows, "doc_id bigint, page_no bigint, text string").repartition(5)
    want = {1: "\n".join(f"p{i}" for i in range(50)), 2: "a\nb"}
    for block in (4, 7, 4096):
        assert {r.doc_id: r.text for r in pages.assemble_pages(table, block).collect()} == want


def test_cascade(spark):
    long = "x" * 50
    rows = [("a", "one", 0, " short "), ("a", "two", 1, long), ("b", "one", 0, long), ("b", "two", 1, "ignored" * 9),
            ("c", "one", 0, "s"), ("c", "two", 1, "t"), ("d", "one", 0, None)]
    table = spark.createDataFrame(rows, "doc_id string, extractor string, rank int, text string")
    got = {r.doc_id: (r.extractor, r.text) for r in pages.extraction_cascade(table).collect()}
    assert got == {"a": ("two", long), "b": ("one", long), "c": ("two", "t"), "d": ("one", "")}


def test_incremental_extraction(spark):
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    old = spark.createDataFrame([("a", "kept"), ("b", "  "), ("z", "other")], "doc_id string, text string")
    tagged, new = cache.extract_incremental(docs, old, lambda misses: misses.withColumn("text", F.when(F.col("doc_id") == "b", "made").otherwise("")))
    assert {(r.doc_id, r.text, r.cached) for r in tagged.collect()} == {("a", "kept", True), ("b", "made", False), ("c", "", False)}
    assert [tuple(r) for r in new.collect()] == [("b", "made")]
    assert tuple(cache.cache_counts(tagged).first()) == (3, 1, 2)
    sizes = spark.createDataFrame([(1048576,), (524288,)], "length bigint")
    assert tuple(cache.cache_stats(sizes).first()) == (2, 1.5)
    assert tuple(cache.cache_stats(sizes.limit(0)).first()) == (0, 0.0)


def test_sinks(spark, tmp_path):
    base = str(tmp_path)
    assert sinks.load_labels(spark, base + "/none.csv") is None
    rows = [("b", "useful", "test"), ("a", "not_useful", "train")]
    sinks.write_labels(spark.createDataFrame(rows, "filename string, label string, split string"), base + "/labels")
    assert [r.filename for r in sinks.load_labels(spark, base + "/labels").collect()] == ["a", "b"]
    scored = spark.createDataFrame([("a", 1, 0.75), ("b", 0, 0.5)], "filename string, prediction int, score double")
    sinks.write_predictions(scored, base + "/predictions")
    got = spark.read.csv(base + "/predictions", header=True).orderBy("filename").collect()
    assert [tuple(r) for r in got] == [("a", "1", "0.75", "useful"), ("b", "0", "0.5", "not_useful")]
    texts = spark.createDataFrame([("a", "t", "useful", "train"), ("b", "u", "not_useful", "test")], "doc_id string, text string, label string, split string")
    sinks.write_texts(texts, base + "/texts", "label", "split")
    assert (tmp_path / "texts/label=useful/split=train").is_dir()
    vocabulary = spark.createDataFrame([(1, "b", 5), (0, "a", 6)], "feature_index int, feature_name string, df int")
    sinks.write_vocabulary(vocabulary, base + "/vocabulary")
    assert spark.read.csv(base + "/vocabulary", header=True).columns == ["feature_index", "feature_name"]
    for _ in range(2):
        sinks.append_feedback(spark.createDataFrame([("r", None)], "record_id string, notes string").coalesce(1), base + "/log")
    lines = [json.loads(line) for f in (tmp_path / "log").glob("*.json") for line in f.read_text().splitlines()]
    assert lines == [{"record_id": "r", "notes": None}] * 2


def batch(spark, *payloads):
    return spark.createDataFrame(list(enumerate(payloads)), "batch_id int, payload string")


@pytest.mark.parametrize(
    "payload,valid",
    [
        ('[{"id": "a1", "content": "x"}, {"id": "é", "content": ""}]', True),
        ("[]", True),
        ('{"id": "a", "content": "x"}', False),
        ('[{"id": "a-1", "content": "x"}]', False),
        ('[{"id": "", "content": "x"}]', False),
        ('[{"id": "a\\n", "content": "x"}]', False),
        ('[{"id": 5, "content": "x"}]', False),
        ('[{"id": "a", "content": 5}]', False),
        ('[{"id": "a"}]', False),
        ('[{"id": "a", "content": null}]', False),
        ('["a"]', False),
        ("[null]", False),
        ("not json", False),
        ('[{"id": "a", "content": "x", "more": [1]}]', True),
    ],
)
def test_batch_validation(spark, payload, valid):
    assert exchange.check_batches(batch(spark, payload)).first().valid is valid


def test_exchange_round_trip(spark):
    payload = '[{"id": "a", "content": "1"}, {"id": "b", "content": "2"}, {"id": "a", "content": "3"}]'
    items = exchange.parse_items(batch(spark, payload))
    docs = exchange.item_documents(items)
    assert {(r.pos, r.filename, r.text) for r in docs.collect()} == {(0, "a.txt", "3"), (1, "b.txt", "2")}
    routed = spark.createDataFrame([(0, "b.txt", 1, 62.5, True)], "batch_id int, filename string, prediction int, confidence double, uncertain boolean")
    answer = exchange.result_arrays(exchange.result_rows(docs, routed)).first().payload
    assert json.loads(answer) == [None, {"relevant": True, "score": 62.5, "uncertain": True}]
    with pytest.raises(Exception, match="invalid input batch"):
        exchange.parse_items(batch(spark, payload, "{}")).collect()
    assert exchange.parse_items(batch(spark, payload, "{}"), strict=False).count() == 3


def test_registry(spark, tmp_path):
    base = str(tmp_path)
    model = PipelineModel([TextCleaner()])
    first = registry.save_model(model, base + "/registry", base + "/models", "txt", "svm", 0.931)
    assert first.startswith("txt_svm_") and first.endswith("_93_1_classifier")
    loaded = registry.load_latest(spark, base + "/registry", "txt", "svm")
    assert loaded.transform(spark.createDataFrame([("A  b",)], "text string")).first().clean == "a b"
    assert registry.load_latest(spark, base + "/registry", "txt", "random_forest") is None
    rows = [("txt", "lr", "txt_lr_93_1_classifier", "93_1", "2024-01-01"), ("txt", "lr", "txt_lr_2026_92_0_classifier", "2026_92_0", "2026-01-01")]
    table = spark.createDataFrame(rows, "file_type string, model_type string, name string, suffix string, created_at string")
    assert registry.latest_artifacts(table).first().scaler == "txt_scaler_2026_92_0"
    assert registry.latest_artifacts(table, order="name").first().tfidf == "txt_tfidf_vocabulary_93_1"


def test_scoring_rules(spark):
    rows = spark.createDataFrame([(0, 0.1), (1, 0.6), (1, 0.75), (0, 0.25)], "prediction int, score double")
    sure = scoring.confidence(F.col("prediction"), F.col("score"))
    got = [(round(r[0], 9), r[1]) for r in rows.select(sure, scoring.is_uncertain(sure)).collect()]
    assert got == [(90.0, False), (60.0, True), (75.0, False), (75.0, False)]
    signs = spark.createDataFrame([(-1,), (1,)], "s int").select(scoring.anomaly_to_label(F.col("s")).alias("y"))
    assert [r.y for r in signs.collect()] == [1, 0]

import pytest
from pyspark.sql import functions as F

from docsift.operators import feedback as FB
from docsift.operators.route import route, write_routes
from docsift.schemas import FEEDBACK

COLUMNS = ("filename string, predicted_label string, predicted_score double, human_label string, annotator string, notes string, "
           "model_version string, tfidf_version string, scaler_version string, source_dir string, at timestamp")


def feedback(spark, *rows):
    full = [(f, p, 0.9, h, None, None, "m1", "t1", "s1", None) for f, p, h in rows]
    return spark.createDataFrame([(*r, None) for r in full], COLUMNS).withColumn("at", F.to_timestamp(F.lit("2026-04-28 10:00:31.5")))


def test_record(spark):
    accepted, rejected = FB.feedback_records(feedback(spark, ("a.txt", "useful", "not_useful")))
    row = accepted.first()
    assert accepted.columns == FEEDBACK.names and rejected.count() == 0
    assert row.pipeline_version == "model=m1 | tfidf=t1 | scaler=s1"
    assert row.record_id == "20260428100031500000_a.txt" and row.created_at == "2026-04-28T10:00:31.500000+00:00"
    assert (row.apply_status, row.applied_at) == ("pending", None)


def test_rejects(spark):
    rows = feedback(spark, ("", "useful", "useful"), (None, "useful", "useful"), ("a", "maybe", "useful"), ("a", "useful", None))
    accepted, rejected = FB.feedback_records(rows)
    assert accepted.count() == 0
    reasons = [r.reject_reason for r in rejected.collect()]
    assert reasons == ["no file name"] * 2 + ["the predicted label is none of not_useful, useful", "the human label is none of not_useful, useful"]
    with pytest.raises(Exception, match="no file name"):
        FB.feedback_records(rows.filter("filename = ''"), strict=True)[0].collect()


def corrections(spark, *rows):
    table = spark.createDataFrame([(str(i), f, d, 0.5, "r", at) for i, (f, d, at) in enumerate(rows)],
                                  "record_id string, filename string, decision string, predicted_score double, reviewer string, at string")
    return table.withColumn("at", F.to_timestamp("at"))


@pytest.mark.parametrize("bucket", [1, 3600, 10**6])
def test_corrections(spark, bucket):
    files = spark.createDataFrame([("a", "useful"), ("b", "manual_check"), ("c", "not_useful"), ("d", "useful")], "filename string, dir string")
    log_in = corrections(
        spark, ("a", "not_useful", "2026-01-01 10:00:00"), ("a", "not_useful", "2026-01-01 10:00:05"), ("a", "useful", "2026-01-01 14:00:00"),
        ("b", "useful", "2026-01-01 10:00:00"), ("c", "not_useful", "2026-01-01 10:00:00"), ("x", "useful", "2026-01-01 10:00:00"),
        ("d", "maybe", "2026-01-01 10:00:00"),
    )
    moved, log, result = FB.apply_corrections(files, log_in, bucket)
    assert {r.filename: r.label for r in moved.collect()} == {"a": "useful", "b": "useful", "c": "not_useful", "d": "useful"}
    steps = {r.record_id: (r.old_label, r.new_label, r.was_already_there) for r in result.collect()}
    assert steps == {
        "0": ("useful", "not_useful", False), "1": ("not_useful", "not_useful", True), "2": ("not_useful", "useful", False),
        "3": (None, "useful", False), "4": ("not_useful", "not_useful", True),
    }
    assert sorted(r.filename for r in log.collect()) == ["a", "a", "b"]
    assert [r.filename for r in FB.missing_files(files, log_in).collect()] == ["x"]


def test_locate_prefers_training_folders(spark):
    files = spark.createDataFrame([("a", "manual_check"), ("a", "not_useful"), ("a", "useful"), ("b", "manual_check")], "filename string, dir string")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "filename string")
    got = {r.filename: (r.dir, r.label) for r in FB.locate(files, wanted).collect()}
    assert got == {"a": ("useful", "useful"), "b": ("manual_check", None), "c": (None, None)}


def test_file_types(spark):
    rows = corrections(spark, ("a", "useful", "2026-01-01 10:00:00")).withColumn("file_type", F.lit("doc"))
    valid, rejected = FB.valid_corrections(rows)
    assert valid.count() == 0 and rejected.first().reject_reason == "the file type is none of txt, pdf"


def test_routes(spark, tmp_path):
    scored = spark.createDataFrame([("a", 0, 0.1), ("b", 1, 0.6), ("c", 1, 0.8), ("d", 0, 0.3)], "filename string, prediction int, score double")
    routed = route(scored)
    assert {r.filename: r.route for r in routed.collect()} == {"a": "not_useful", "b": "manual_check", "c": "useful", "d": "manual_check"}
    write_routes(routed, str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").glob("route=*")} == {"route=not_useful", "route=manual_check", "route=useful"}

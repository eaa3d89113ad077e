"""Explicit schemas of the tables that are read from files."""

from pyspark.sql import types as T


def _strings(*names):
    return [T.StructField(n, T.StringType()) for n in names]


LABELS = T.StructType(_strings("filename", "label", "split"))

PREDICTIONS = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("prediction", T.IntegerType()),
        T.StructField("anomaly_score", T.DoubleType()),
        T.StructField("label", T.StringType()),
    ]
)

CORRECTIONS = T.StructType(
    _strings("record_id", "filename", "old_label", "new_label")
    + [T.StructField("predicted_score", T.DoubleType())]
    + _strings("reviewer", "method", "apply_status", "applied_at", "created_at")
)

FEEDBACK = T.StructType(
    _strings("record_id", "filename", "predicted_label")
    + [T.StructField("predicted_score", T.DoubleType())]
    + _strings(
        "human_label", "annotator", "notes", "model_version", "tfidf_version", "scaler_version",
        "pipeline_version", "source_dir", "apply_status", "applied_at", "created_at",
    )
)

ITEMS = T.ArrayType(T.StructType(_strings("id", "content")))

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

EMBEDDINGS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]
)

"""Registered queries: each operator of the library over the given tables."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TrainConfig
from ..functions.paths import document_filename, stem
from ..operators import documents as D
from ..operators import embed as E
from ..operators import feedback as FB
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import models
from ..operators import route as R
from ..operators import selection as S
from ..operators.neighbours import nearest
from ..operators.smote import smote
from ..operators.tfidf import TextCleaner, Tfidf, TfidfModel
from ..session import materialize, scratch_path
from ..sources import cache, exchange, files, pages, payloads, registry, sinks
from ..sources.extract import extract
from ..sources.ids import assign_ids
from ..sources.versions import VersionedTable
from ..streaming import labels as label_stream
from ..streaming.corrections import correction_stream
from ..streaming import score as score_stream
from . import predict, score_rule
from . import tables as T
from .phrases import phrased
from .train import train_job

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for name in columns:
        df = df.withColumn(name, F.round(name, 6))
    return df


# Cleaning


def clean_documents(spark, folder):
    return D.clean_documents(T.documents(spark, folder)).select("doc_id", "clean")


def clean_keep_case(spark, folder):
    return D.clean_documents(T.documents(spark, folder), lowercase=False).select("doc_id", "clean")


def clean_keep_specials(spark, folder):
    return D.clean_documents(T.documents(spark, folder), remove_special_chars=False).select("doc_id", "clean")


def clean_pages(spark, folder):
    pages = T.table(spark, folder, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("text"))
    return D.clean_documents(pages).select("page_id", "clean")


def preprocess_report(spark, folder):
    return D.comparison_report(T.documents(spark, folder))


def removed_keywords(spark, folder):
    return D.keyword_report(D.clean_documents(T.documents(spark, folder)))


def clean_phrases(spark, folder):
    """Documents that hold what the rules for authors, noise words, figures, tables and references are about."""
    return D.clean_documents(phrased(T.documents(spark, folder))).select("doc_id", "clean")


def removed_phrases(spark, folder):
    return D.keyword_report(D.clean_documents(phrased(T.documents(spark, folder))))


def preprocess_stats(spark, folder):
    return D.cleaning_stats(D.clean_documents(T.documents(spark, folder)))


def document_lengths(spark, folder):
    rows = D.clean_documents(T.documents(spark, folder))
    return rounded(rows.select("doc_id", "n_raw", "n_clean", "reduction"), "reduction")


# TF-IDF


def training_texts(spark, folder) -> DataFrame:
    return D.clean_documents(T.labelled_documents(spark, folder)).select("doc_id", "filename", "clean", "y")


def fitted(spark, folder) -> tuple[DataFrame, TfidfModel]:
    """The cleaned training texts, written once and read by the fit and the transform."""
    train = materialize(training_texts(spark, folder), "train")
    return train, Tfidf().fit(train)


def vocabulary(spark, folder):
    return rounded(fitted(spark, folder)[1].vocabulary(spark), "idf")


def tfidf_long(spark, folder):
    train, model = fitted(spark, folder)
    return rounded(model.transform_long(train), "tfidf")


def tfidf_transform_unseen(spark, folder):
    """Benchmark passages and their counts under the vocabulary of the documents."""
    model = fitted(spark, folder)[1]
    unseen = T.table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return rounded(model.transform_long(D.clean_documents(unseen)), "tfidf")


def _class_means(spark, folder):
    train, model = fitted(spark, folder)
    return S.class_means(model.transform_long(train), T.label_rows(spark, folder), model.vocabulary(spark))


MEAN_COLUMNS = ("useful_mean_tfidf", "not_useful_mean_tfidf", "difference")


def class_mean_tfidf(spark, folder):
    return rounded(_class_means(spark, folder), *MEAN_COLUMNS)


def top_useful_terms(spark, folder):
    return rounded(S.discriminative_terms(_class_means(spark, folder))[0], *MEAN_COLUMNS)


def top_not_useful_terms(spark, folder):
    return rounded(S.discriminative_terms(_class_means(spark, folder))[1], *MEAN_COLUMNS)


def noise_terms(spark, folder):
    """Overlap of the two lists when they cover most of the vocabulary."""
    useful, not_useful = S.discriminative_terms(_class_means(spark, folder), 1200)
    return S.noise_terms(useful, not_useful, 1200)


def _chi2(spark, folder):
    train, model = fitted(spark, folder)
    return S.chi2_scores(model.transform_long(train), T.label_rows(spark, folder), model.vocabulary(spark))


def chi2_scores(spark, folder):
    return rounded(_chi2(spark, folder), "chi2")


def chi2_selected(spark, folder):
    """Training weights restricted to the selected features."""
    train, model = fitted(spark, folder)
    long = model.transform_long(train)
    scores = S.chi2_scores(long, T.label_rows(spark, folder), model.vocabulary(spark))
    # k rows at most, a fixed parameter of the selection.
    kept = F.broadcast(S.select_k_best(scores, 1000).select("feature_index"))
    return rounded(long.join(kept, "feature_index", "left_semi"), "tfidf")


# Sources


def file_info(spark, folder):
    """Name, stem and size of each document, from its length alone."""
    docs = T.table(spark, folder, "documents").select(
        F.concat(F.lit("corpus/"), "source", F.lit("/"), document_filename(F.col("doc_id"))).alias("path"),
        F.octet_length("text").alias("length"),
    )
    return rounded(files.file_info(docs).orderBy("path"), "size_kb")


def decoded_texts(spark, folder):
    """Documents written as Latin-1 bytes where they can be, decoded again."""
    docs = T.table(spark, folder, "documents").select("doc_id", "text", "lang")
    body = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    content = F.when(F.col("lang") == "fr", F.encode(body, "ISO-8859-1")).otherwise(F.encode(body, "UTF-8"))
    return docs.select("doc_id", files.decode_text(content).alias("text")).filter("text != ''")


def _page_rows(spark, folder):
    turns = T.table(spark, folder, "conversations")
    return turns.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"),
        F.when(F.col("turn") % 3 == 1, F.lit("")).otherwise(F.col("text")).alias("text"),
    )


def assemble_pages(spark, folder):
    """Conversations as documents whose every third turn is an empty page."""
    return pages.assemble_pages(_page_rows(spark, folder), block=4)


def extraction_cascade(spark, folder):
    """Turns as extractors of a conversation, tried in order."""
    turns = T.table(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("role").alias("extractor"), F.col("turn").alias("rank"),
        F.when(F.col("turn") % 4 == 0, F.regexp_replace("text", "[a-z]", "")).when(F.col("turn") % 4 != 3, F.col("text")).alias("text"),
    )
    return pages.extraction_cascade(turns)


def _text_cache(spark, folder):
    """Page sources as an old text cache of the documents; some are blank."""
    old = T.table(spark, folder, "pages")
    return old.select(
        F.col("page_id").alias("doc_id"), F.when(F.col("page_id") % 7 == 0, F.lit("  ")).otherwise(F.col("html")).alias("text")
    )


def _contents(spark, folder):
    """Documents as file contents of four kinds: plain, coded, broken, and too short."""
    kind, text = F.col("doc_id") % 4, F.coalesce("text", F.lit(""))
    content = F.when(kind == 0, F.concat(F.lit("T:"), text)).when(kind == 1, F.concat(F.lit("S:"), F.base64(text.cast("binary"))))
    content = content.when(kind == 2, F.concat(F.lit("X:"), text)).otherwise(F.concat(F.lit("T:"), F.substring(text, 1, 20)))
    return T.documents(spark, folder).select("doc_id", content.cast("binary").alias("content"))


def _printed():
    def read(content):
        text = content.decode("utf-8")
        if text.startswith("X:"):
            raise ValueError("broken file")
        return text[2:] if text.startswith("T:") else ""

    return read


def _scanned():
    return lambda content: base64.b64decode(content[2:]).decode("utf-8") if content.startswith(b"S:") else ""


def lazy_extraction(spark, folder):
    """Texts of the contents by two extractors, the second of which is only called where the first found too little."""
    found = extract(_contents(spark, folder), [("printed", _printed), ("scanned", _scanned)])
    return found.select("doc_id", "extractor", "text", F.col("error").isNotNull().alias("failed"))


def cache_split(spark, folder):
    docs = T.table(spark, folder, "documents").select("doc_id", "text")
    tagged, _ = cache.extract_incremental(docs, _text_cache(spark, folder), lambda misses: misses)
    return tagged


def cache_versions(spark, folder):
    """Texts of pages, then of documents, then of benchmark items as batches of one cache, with a replay, compacted half way."""
    cached = VersionedTable(spark, scratch_path(spark, "cache"), "doc_id bigint, text string")
    pages = T.table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("text"))
    cached.upsert(pages, "pages")
    cached.upsert(T.table(spark, folder, "documents").filter("doc_id % 3 > 0").select("doc_id", "text"), "documents")
    cached.compact()
    cached.upsert(pages, "pages")
    cached.upsert(T.table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), "benchmark")
    return cached.read()


def cache_counts(spark, folder):
    return cache.cache_counts(cache_split(spark, folder))


def first_cached(spark, folder):
    """Three caches in priority order: pages, conversations, benchmark passages."""
    turns = pages.assemble_pages(_page_rows(spark, folder), block=4).select("doc_id", "text")
    passages = T.table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    docs = T.table(spark, folder, "documents")
    return cache.first_cached(docs, passages, turns, _text_cache(spark, folder))


def cache_stats(spark, folder):
    docs = T.table(spark, folder, "documents").select(F.octet_length("text").alias("length"))
    return cache.cache_stats(docs)


def merge_by_stem(spark, folder):
    """Documents, pages and passages with the same number: passages win over pages, pages over documents."""
    parts = [("documents", "doc_id", "text", 1), ("pages", "page_id", "url", 2), ("benchmark", "item_id", "text", 3)]
    rows = [
        T.table(spark, folder, name).select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.lit(rank).alias("priority"))
        for name, key, text, rank in parts
    ]
    return files.merge_by_stem(reduce(DataFrame.unionByName, rows))


def file_dispatch(spark, folder):
    """Rows per supported file type among page addresses given mixed extensions."""
    ends = F.element_at(F.array(*[F.lit(e) for e in (".TXT", ".pdf", ".html", "")]), (F.col("page_id") % 4 + 1).cast("int"))
    paths = T.table(spark, folder, "pages").select("page_id", F.concat(F.lit("web/page"), "page_id", ends).alias("path"))
    known, other = files.by_file_type(paths)
    typed = known.select("page_id", stem(F.col("path")).alias("stem"), "file_type")
    return typed.unionByName(other.select("page_id", stem(F.col("path")).alias("stem"), F.lit("unsupported").alias("file_type")))


# Labels


def label_table(spark, folder):
    return L.build_labels(T.label_rows(spark, folder).select("filename", "dir")).select("filename", "label", "split")


def stratified_split(spark, folder):
    """Split by the rarer label."""
    rows = T.label_rows(spark, folder, "toxic").select("doc_id", "filename", "label")
    return L.stratified_split(rows).select("doc_id", "label", "split")


def split_rows(spark, folder):
    return L.split_rows(label_table(spark, folder), "test", "useful")


def split_summary(spark, folder):
    return L.split_summary(label_table(spark, folder))


def split_label_counts(spark, folder):
    return L.split_label_counts(label_table(spark, folder))


def class_balance(spark, folder):
    return L.class_balance(T.label_rows(spark, folder, "toxic"))


def class_weights(spark, folder):
    return rounded(L.class_weights(T.label_rows(spark, folder, "toxic")), "weight")


def fold_assignment(spark, folder):
    return L.stratified_folds(T.label_rows(spark, folder).select("doc_id", F.col("y").alias("label")))


def label_lookup(spark, folder):
    """Every document with its label; files listed twice count by their first row."""
    docs = T.table(spark, folder, "documents").select("doc_id", document_filename(F.col("doc_id")).alias("filename"))
    rows = T.label_rows(spark, folder).withColumn("line", F.col("doc_id") * 2)
    twice = rows.filter("doc_id % 5 = 0").withColumn("line", F.col("line") + 1)
    flipped = F.when(F.col("label") == "useful", F.lit("not_useful")).otherwise(F.lit("useful"))
    listed = rows.unionByName(twice.withColumn("label", flipped))
    return L.attach_labels(docs, listed.select("filename", "label", "line"), order="line").select("doc_id", "y")


def unlabelled_docs(spark, folder):
    docs = T.table(spark, folder, "documents").select(document_filename(F.col("doc_id")).alias("filename"))
    return L.evaluation_rows(docs, T.label_rows(spark, folder))[1]


def evaluation_rows(spark, folder):
    docs = T.table(spark, folder, "documents").select("doc_id", document_filename(F.col("doc_id")).alias("filename"))
    return L.evaluation_rows(docs, T.label_rows(spark, folder))[0]


def _folders(spark, folder):
    """Pages play the main folder, conversations the useful one."""
    main = T.table(spark, folder, "pages").select(document_filename(F.col("page_id")).alias("filename"))
    useful = T.table(spark, folder, "conversations").select(document_filename(F.col("conv_id") * 5).alias("filename"))
    return main, useful


def resolve_split(spark, folder):
    found, _ = L.resolve_split(label_table(spark, folder), *_folders(spark, folder), "train")
    return found.select("filename", "label", "dir")


def missing_split_files(spark, folder):
    return L.resolve_split(label_table(spark, folder), *_folders(spark, folder), "train")[1]


def drop_blank(spark, folder):
    """Turns with text left once their letters are gone, and the blank ones."""
    turns = T.table(spark, folder, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 2 == 1, F.regexp_replace("text", r"[^ \n]", "")).otherwise(F.col("text")).alias("text")
    )
    kept, skipped = D.split_blank(turns)
    kept = kept.select("conv_id", "turn", F.lit(False).alias("skipped"))
    return kept.unionByName(skipped.select("conv_id", "turn", F.lit(True).alias("skipped")))


# Features


def combined_vector(spark, folder):
    """Training documents with an embedding: words and embedding side by side."""
    train, model = fitted(spark, folder)
    vectors = E.combine(model.transform(train), T.embedding_cache(spark, folder), "combined")
    entries = vectors.select("doc_id", F.posexplode(vector_to_array("features_raw")).alias("feature_index", "value"))
    return rounded(entries.filter("value != 0"), "value")


def maxabs_scaled(spark, folder):
    rows = T.embedding_cache(spark, folder).select(
        "doc_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features_raw")
    )
    scaled = E.fit_scaler(rows).transform(rows)
    entries = scaled.select("doc_id", F.posexplode(vector_to_array("features")).alias("feature_index", "value"))
    return rounded(entries, "value")


def embedding_hits(spark, folder):
    docs = T.table(spark, folder, "documents").select("doc_id")
    return E.split_embeddings(docs, T.embedding_cache(spark, folder), 64)[0].select("doc_id")


def embedding_misses(spark, folder):
    docs = T.table(spark, folder, "documents").select("doc_id")
    return E.split_embeddings(docs, T.embedding_cache(spark, folder), 64)[1].select("doc_id")


def embed_missing(spark, folder):
    docs = T.documents(spark, folder).select("doc_id", "text")
    cached = T.embedding_cache(spark, folder)
    return E.embed_incremental(docs, cached, E.HashingEncoder(64), 64, prepare=D.clean_documents)[1]


# Evaluation


def confusion_matrix(spark, folder):
    return M.confusion(M.confusion_counts(score_rule.predicted_quality(spark, folder)))


def confusion_pct(spark, folder):
    return rounded(M.confusion_pct(M.confusion_counts(score_rule.predicted_quality(spark, folder))), "row_pct")


def confusion_rates(spark, folder):
    counts = M.confusion_counts(score_rule.predicted_quality(spark, folder))
    return rounded(M.rates(counts), "accuracy", "precision", "recall", "f1")


def classification_report(spark, folder):
    counts = M.confusion_counts(score_rule.predicted_quality(spark, folder))
    return rounded(M.classification_report(counts), "precision", "recall", "f1")


def accuracy(spark, folder):
    return rounded(M.accuracy(score_rule.predicted_quality(spark, folder)), "accuracy")


def positive_predictions(spark, folder):
    return M.positive_predictions(score_rule.predicted_quality(spark, folder))


def fold_accuracy_band(spark, folder):
    """Spread of the rule's accuracy over the stratified folds."""
    rows = score_rule.predicted_quality(spark, folder).withColumnRenamed("actual", "label")
    folded = L.stratified_folds(rows)
    per_fold = folded.groupBy("fold").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("f1"))
    return rounded(M.cv_summary(per_fold), "mean", "std", "band")


def quality_flags(spark, folder):
    """Flags from the rule's accuracy per split and the balance of the rare label."""
    rows = score_rule.predicted_quality(spark, folder).withColumn("filename", document_filename(F.col("doc_id")))
    rows = rows.join(label_table(spark, folder).select("filename", "split"), "filename")
    hit = (F.col("actual") == F.col("prediction")).cast("double")
    one = rows.agg(
        F.avg(hit).alias("cv_mean"),
        F.avg(F.when(F.col("split") == "train", hit)).alias("train_accuracy"),
        F.avg(F.when(F.col("split") == "test", hit)).alias("test_accuracy"),
    )
    ratio = L.class_balance(T.label_rows(spark, folder, "toxic")).first().ratio
    return rounded(M.quality_flags(one.withColumn("ratio", F.lit(ratio))), "cv_mean", "train_accuracy", "test_accuracy")


def model_top_features(spark, folder):
    """Class-mean differences ranked like coefficients."""
    weights = _class_means(spark, folder).select("feature_index", "feature_name", F.col("difference").alias("weight"))
    return rounded(models.rank_features(weights, 10), "weight")


def model_top_importances(spark, folder):
    """Chi-squared scores ranked like importances."""
    weights = _chi2(spark, folder).select("feature_index", "feature_name", F.col("chi2").alias("weight"))
    return rounded(models.rank_features(weights, 10, signed=False), "weight")


# Routing, exchange, feedback


def route_predictions(spark, folder):
    routed = R.route(score_rule.scored_files(spark, folder))
    return rounded(routed.select("filename", "prediction", "confidence", "uncertain", "route"), "confidence")


def predictions_rule_table(spark, folder):
    return rounded(sinks.prediction_table(score_rule.scored_files(spark, folder)), "anomaly_score")


def _batches(spark, folder):
    """Up to 64 turns of a conversation as one batch; some batches are malformed."""
    turns = T.table(spark, folder, "conversations").withColumn(
        "id", F.concat(F.when(F.col("conv_id") % 10 == 3, F.lit("id-")).otherwise(F.lit("id")), (F.col("turn") % 3).cast("string"))
    )
    item = F.struct("turn", "id", F.col("text").alias("content"))
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda i: F.struct(i["id"].alias("id"), i["content"].alias("content")))
    batch = F.expr("conv_id * 1000003 + turn div 64")
    return turns.groupBy(batch.alias("batch_id")).agg(F.to_json(ordered).alias("payload"))


def exchange_batches(spark, folder):
    return exchange.check_batches(_batches(spark, folder)).select("batch_id", "valid", F.size("items").alias("n_items"))


def exchange_parse(spark, folder):
    return exchange.item_documents(exchange.parse_items(_batches(spark, folder), strict=False))


def exchange_files(spark, folder):
    """The batches as payload files, read back: items of the valid ones, and which ones were rejected."""
    out = scratch_path(spark, "exchange")
    payloads.write_payloads(_batches(spark, folder).select(F.col("batch_id").alias("name"), "payload"), out)
    rows = payloads.read_payloads(spark, out, task_bytes=1 << 20)
    return rows.select(F.col("name").cast("bigint").alias("batch_id"), "pos", "id", "content", F.col("rejected").isNotNull().alias("is_rejected"))


def exchange_answers(spark, folder):
    """Answers by the length rule through result files: written, then read as they stand there."""
    out = scratch_path(spark, "answers")
    payloads.write_payloads(exchange_output(spark, folder).select(F.col("batch_id").alias("name"), "payload"), out)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(out)
    return files.select(stem(F.col("path")).cast("bigint").alias("batch_id"), F.col("content").cast("string").alias("payload"))


def exchange_output(spark, folder):
    """Answers to the valid batches by a length rule; every fifth batch's last item is skipped."""
    docs = exchange_parse(spark, folder)
    scored = docs.filter("NOT (batch_id % 5 = 0 AND pos = 2)").withColumn("score", F.floor(F.length("text") % 128) / 128)
    scored = scored.withColumn("prediction", F.when(F.col("score") >= 0.5, 1).otherwise(0))
    return exchange.result_arrays(exchange.result_rows(docs, R.route(scored)))


def latest_artifacts(spark, folder):
    """Artefact names of daily training runs taken from the event log."""
    runs = T.table(spark, folder, "events").select(
        F.lit("txt").alias("file_type"), F.col("event_type").alias("model_type"), F.col("ts").alias("created_at"),
        (F.col("value") % 100 / 100).alias("accuracy"),
    )
    # Half a tenth is kept out of the way: printing rounds it differently elsewhere.
    runs = runs.withColumn("suffix", registry.artifact_suffix(F.col("created_at"), F.floor(F.col("accuracy") * 100) / 100))
    runs = runs.withColumn("name", registry.classifier_name(F.col("file_type"), F.col("model_type"), F.col("suffix")))
    return registry.latest_artifacts(runs)


def _feedback(spark, folder):
    rows = T.feedback_events(spark, folder)
    return rows.select(
        F.when(F.col("event_id") % 50 == 0, F.lit(" ")).otherwise(F.col("filename")).alias("filename"),
        F.when(F.col("value") > 50, F.lit("useful")).otherwise(F.lit("not_useful")).alias("predicted_label"),
        F.col("value").alias("predicted_score"),
        F.col("decision").alias("human_label"),
        F.lit(None).cast("string").alias("annotator"),
        F.lit(None).cast("string").alias("notes"),
        F.when(F.col("event_id") % 3 == 0, F.lit("m1")).alias("model_version"),
        F.when(F.col("event_id") % 3 == 1, F.lit("")).otherwise(F.lit("t1")).alias("tfidf_version"),
        F.lit("s1").alias("scaler_version"),
        F.lit("raw_txts").alias("source_dir"),
        "at",
    )


def feedback_records(spark, folder):
    return FB.feedback_records(_feedback(spark, folder))[0]


def feedback_rejects(spark, folder):
    rejected = FB.feedback_records(_feedback(spark, folder))[1]
    return rejected.select("filename", "predicted_label", "human_label", "at", "reject_reason")


def _file_dirs(spark, folder):
    """Documents by folder: labelled ones by class, some of the others wait for a manual check."""
    docs = T.table(spark, folder, "documents").select("doc_id", document_filename(F.col("doc_id")).alias("filename"))
    placed = docs.join(T.label_rows(spark, folder).select("doc_id", "dir"), "doc_id", "left")
    waiting = F.when(F.col("doc_id") % 2 == 0, F.lit("manual_check"))
    return placed.select("filename", F.coalesce("dir", waiting).alias("dir")).filter("dir IS NOT NULL")


def _corrections(spark, folder):
    return _as_corrections(T.table(spark, folder, "events"))


def _as_corrections(events):
    return T.decisions(events).select(
        F.col("event_id").cast("string").alias("record_id"), "filename", "decision",
        F.col("value").alias("predicted_score"), F.lit("r1").alias("reviewer"), "at",
    )


def locate_file(spark, folder):
    twice = _file_dirs(spark, folder)
    twice = twice.unionByName(twice.filter("dir = 'not_useful'").withColumn("dir", F.lit("manual_check")))
    return FB.locate(twice, _corrections(spark, folder))


def missing_files(spark, folder):
    return FB.missing_files(_file_dirs(spark, folder), _corrections(spark, folder))


def corrections_applied(spark, folder):
    return FB.apply_corrections(_file_dirs(spark, folder), _corrections(spark, folder))[2]


def correction_log(spark, folder):
    return FB.apply_corrections(_file_dirs(spark, folder), _corrections(spark, folder))[1]


def corrected_labels(spark, folder):
    return FB.apply_corrections(_file_dirs(spark, folder), _corrections(spark, folder))[0]


def relabelled_split(spark, folder):
    """The label table rebuilt after the corrections."""
    return L.build_labels(corrected_labels(spark, folder).select("filename", "dir")).select("filename", "label", "split")


def current_labels(spark, folder):
    return FB.current_labels(FB.valid_corrections(_corrections(spark, folder))[0])


# Models and jobs


def _training_rows(spark, folder, column="quality"):
    """Labelled embeddings as training rows, which are narrow and fit quickly."""
    rows = T.embedding_cache(spark, folder).select(
        "doc_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )
    return rows.join(T.label_rows(spark, folder, column).select("doc_id", "y"), "doc_id")


def _fit_and_score(spark, folder, kind):
    rows = _training_rows(spark, folder)
    scored = models.score(models.create_classifier(kind).fit(rows), rows)
    return rounded(scored.select("doc_id", "y", "prediction", "score"), "score")


def lr_fit(spark, folder):
    return _fit_and_score(spark, folder, "logistic_regression")


def svm_fit(spark, folder):
    return _fit_and_score(spark, folder, "svm")


def rf_fit(spark, folder):
    return _fit_and_score(spark, folder, "random_forest")


def iforest(spark, folder):
    rows = _training_rows(spark, folder)
    return models.create_classifier("random_forest", mode="unsupervised").fit(rows).score(rows)


def _checks(scored, **more):
    """Rows, and how many of them have a score that is a probability and a prediction that follows from it."""
    sound = F.col("score").between(0, 1) & (F.col("prediction") == (F.col("score") > 0.5).cast("int"))
    return scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(sound).alias("n_sound"), *(c.alias(k) for k, c in more.items()))


def lr_checks(spark, folder):
    """Whether the fitted logistic regression is the optimum: its penalised gradient vanishes, the intercept's too."""
    rows = materialize(L.add_class_weights(_training_rows(spark, folder), "y"), "weighted")
    model = models.create_classifier("logistic_regression").fit(rows.drop("weight"))
    weights = [float(w) for w in model.stages[0].coefficients]
    scored = models.score(model, rows).withColumn("x", vector_to_array("features"))
    residual = F.col("weight") * (F.col("score") - F.col("y"))
    parts = scored.select("doc_id", "score", "prediction", residual.alias("r"), F.posexplode("x").alias("i", "v"))
    gradient = parts.groupBy("i").agg(F.sum(F.col("r") * F.col("v")).alias("g"))
    gradient = gradient.select(F.abs(F.col("g") + F.element_at(F.array(*map(F.lit, weights)), F.col("i") + 1)).alias("g"))
    size = gradient.agg((F.max("g") < 1e-2).alias("is_optimal"), F.count(F.lit(1)).alias("n_weights"))
    found = size.first()  # one row
    return _checks(scored, is_balanced=F.abs(F.sum(residual)) < 1e-2, is_optimal=F.lit(found.is_optimal), n_weights=F.lit(found.n_weights))


def rf_checks(spark, folder):
    """Whether the forest's answers are sound and better than always the larger class, by balanced accuracy on its own rows."""
    rows = _training_rows(spark, folder)
    scored = models.score(models.create_classifier("random_forest").fit(rows), rows)
    right = lambda y: F.avg(F.when(F.col("y") == y, (F.col("prediction") == y).cast("double")))
    return _checks(scored, is_better=(right(0) + right(1)) / 2 > 0.55)


def cv_checks(spark, folder):
    scores = cv_scores(spark, folder)
    return scores.agg(F.count_distinct("fold").alias("n_folds"), F.count_if(F.col("f1").between(0, 1)).alias("n_sound"))


def cv_scores(spark, folder):
    rows = _training_rows(spark, folder)
    return rounded(models.cross_validate(models.create_classifier("logistic_regression"), rows), "f1")


def _rare_rows(spark, folder):
    return _training_rows(spark, folder, "toxic")


def _written(vector):
    """Millionths of the components, with a space between."""
    return F.array_join(F.transform(vector, lambda x: F.round(x * 1e6).cast("bigint").cast("string")), " ")


def smote_rows(spark, folder):
    """Training rows of the rare label with the synthetic ones: whole vectors of the former, and what holds for the latter.

    A synthetic row is the given share of the way from a rare row to one of its five nearest.
    """
    rows = _rare_rows(spark, folder)
    out = materialize(smote(rows, origins=True), "smote")
    found = materialize(minority_neighbours(spark, folder).select(F.col("key").alias("base"), "near"), "near")
    rare = rows.filter("y = 1").select(F.col("doc_id").alias("base"), vector_to_array("features").alias("a"))
    made = out.filter("synthetic").join(rare, "base").join(rare.toDF("near", "b"), "near")
    made = made.join(found.withColumn("is_near", F.lit(True)), ["base", "near"], "left")
    off = F.aggregate(
        F.zip_with(vector_to_array("features"), F.zip_with("a", "b", lambda a, b: a + F.col("share") * (b - a)), lambda v, w: F.abs(v - w)),
        F.lit(0.0), lambda most, x: F.greatest(most, x),
    )
    sound = (off < 1e-9) & F.coalesce("is_near", F.col("base") == F.col("near")) & F.col("share").between(0, 1) & (F.col("doc_id") < 0)
    kept = out.filter("NOT synthetic").select(
        "doc_id", "y", _written(vector_to_array("features")).alias("vector"), F.lit(None).cast("bigint").alias("n_sound")
    )
    checks = made.agg(F.count_if(sound).alias("n_sound"), F.count_distinct("doc_id").alias("n"))
    checks = checks.filter("n > 0").select(
        F.lit(None).cast("bigint").alias("doc_id"), F.lit(1).alias("y"), F.lit(None).cast("string").alias("vector"),
        F.when(F.col("n") == F.col("n_sound"), F.col("n_sound")).otherwise(F.lit(-1)).alias("n_sound"),
    )
    return kept.unionByName(checks)


def smote_counts(spark, folder):
    counts = smote(_rare_rows(spark, folder)).groupBy("y", "synthetic").agg(F.count(F.lit(1)).alias("n"))
    return counts


def minority_neighbours(spark, folder):
    """Five nearest embeddings of each embedding of the rare label."""
    points = _rare_rows(spark, folder).filter("y = 1").select(F.col("doc_id").alias("key"), vector_to_array("features").alias("x"))
    return rounded(nearest(points, 5).select("key", "near", "gap"), "gap")


def train_predictions(spark, folder):
    """The whole training job on words; its predictions for the test split."""
    docs = T.documents(spark, folder)
    labels = L.build_labels(T.label_rows(spark, folder).select("filename", "dir"))
    result = train_job(spark, docs, labels, TrainConfig(feature_mode="tfidf"))
    return rounded(result.predictions, "anomaly_score")


def _text_pipeline(spark, folder):
    """Words and logistic regression on all labelled documents."""
    train, model = fitted(spark, folder)
    rows = model.transform(train, output_col="features").select("doc_id", "y", "features")
    classifier = models.create_classifier("logistic_regression").fit(rows)
    return PipelineModel([TextCleaner(), *model.stages(output_col="features"), *classifier.stages])


def predictions_table(spark, folder):
    """Unlabelled documents, scored by a model of the labelled ones and routed."""
    docs = T.documents(spark, folder).join(T.label_rows(spark, folder).select("doc_id"), "doc_id", "left_anti")
    routed = predict.predict_job(_text_pipeline(spark, folder), docs.select("doc_id", "filename", "text"))
    return rounded(routed.drop("text"), "score", "confidence")


def _combined_pipeline(spark, folder, cache):
    """Words, embeddings and scaling fitted on the labelled documents; the weights are a fixed rule."""
    train, model = fitted(spark, folder)
    both = E.assembler().transform(E.with_semantic(model.transform(train), cache, score_rule.length_encoder, 64))
    return PipelineModel(
        [TextCleaner(), *model.stages(), E.sized("tfidf", len(model.entries)), E.assembler(), E.fit_scaler(both), score_rule.LinearRule()]
    )


def predict_combined(spark, folder):
    """All documents under a model of words and embeddings: those without an embedding are encoded."""
    cache = T.embedding_cache(spark, folder)
    pipeline = _combined_pipeline(spark, folder, cache)
    docs = T.documents(spark, folder)
    routed = predict.predict_job(pipeline, docs, cache=cache, encoder=score_rule.length_encoder, dim=64)
    return rounded(routed.select("doc_id", "prediction", "score", "confidence", "route"), "score", "confidence")


def stream_combined(spark, folder):
    """The same through the stream: every batch meets the cache and encodes what is missing there."""
    cache = T.embedding_cache(spark, folder)
    pipeline = _combined_pipeline(spark, folder, cache)
    stream, out = score_stream.document_stream(spark, T.arriving(folder, "documents")), scratch_path(spark, "scored")
    query = score_stream.score_stream(
        pipeline, stream, out, scratch_path(spark, "state"), once=True, cache=cache, encoder=score_rule.length_encoder, dim=64
    )
    query.awaitTermination()
    return rounded(spark.read.parquet(out).select("doc_id", "prediction", "score", "confidence", "route"), "score", "confidence")


def document_ids(spark, folder):
    """Ids of files: different for different names, the same for a name in two batches, never negative."""
    names = T.documents(spark, folder).select(stem(F.col("filename")).alias("stem"))
    first = materialize(assign_ids(names.filter("stem < '00500'")), "ids")
    every = materialize(first.unionByName(assign_ids(names, first)), "ids")
    again = every.join(assign_ids(names).withColumnRenamed("doc_id", "again"), "stem")
    same = F.col("doc_id") == F.col("again")
    distinct = F.count_distinct("doc_id") == F.count(F.lit(1))
    checks = again.agg(F.count(F.lit(1)).alias("n"), distinct.alias("is_unique"), F.bool_and(same).alias("is_stable"), (F.min("doc_id") >= 0).alias("is_positive"))
    return checks


def evaluate_batch(spark, folder):
    report = predict.evaluate_batch(_text_pipeline(spark, folder), T.documents(spark, folder), T.label_rows(spark, folder))
    return rounded(report["report"], "precision", "recall", "f1")


# Streams


def stream_score(spark, folder):
    """All documents through the stream; the SQL side sees which ones come out."""
    stream = score_stream.document_stream(spark, T.arriving(folder, "documents"))
    out = scratch_path(spark, "scored")
    query = score_stream.score_stream(_text_pipeline(spark, folder), stream, out, scratch_path(spark, "state"), once=True)
    query.awaitTermination()
    return spark.read.parquet(out).select("doc_id", F.length("text").alias("n_chars"))


def stream_corrections(spark, folder):
    """The log of real moves from a stream of corrections."""
    events = T.table_stream(spark, folder, "events")
    out = scratch_path(spark, "moves")
    correction_stream(_as_corrections(events), _file_dirs(spark, folder), out, scratch_path(spark, "state"), once=True).awaitTermination()
    return spark.read.parquet(out)


def stream_labels(spark, folder):
    events = T.table_stream(spark, folder, "events")
    decided = FB.valid_corrections(T.decisions(events).withColumn("record_id", F.col("event_id").cast("string")))[0]
    out = scratch_path(spark, "labels")
    label_stream.label_stream(decided, out, scratch_path(spark, "state"), once=True).awaitTermination()
    return label_stream.read_labels(spark, out)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        clean_documents, clean_keep_case, clean_keep_specials, clean_pages, preprocess_report,
        removed_keywords, clean_phrases, removed_phrases, preprocess_stats, document_lengths,
        vocabulary, tfidf_long, tfidf_transform_unseen, class_mean_tfidf, top_useful_terms,
        top_not_useful_terms, noise_terms, chi2_scores, chi2_selected,
        file_info, decoded_texts, assemble_pages, extraction_cascade, lazy_extraction, cache_split, cache_versions,
        cache_counts,
        first_cached, cache_stats, merge_by_stem, file_dispatch,
        label_table, stratified_split, split_rows, split_summary, split_label_counts, class_balance,
        class_weights, fold_assignment, label_lookup, unlabelled_docs, evaluation_rows, resolve_split,
        missing_split_files, drop_blank,
        combined_vector, maxabs_scaled, embedding_hits, embedding_misses, embed_missing,
        confusion_matrix, confusion_pct, confusion_rates, classification_report, accuracy,
        positive_predictions, fold_accuracy_band, quality_flags, model_top_features,
        model_top_importances,
        route_predictions, predictions_rule_table, exchange_batches, exchange_parse, exchange_output,
        exchange_files, exchange_answers,
        latest_artifacts, feedback_records, feedback_rejects, locate_file, missing_files,
        corrections_applied, correction_log, corrected_labels, relabelled_split, current_labels,
        lr_fit, svm_fit, rf_fit, iforest, cv_scores, lr_checks, rf_checks, cv_checks,
        smote_rows, smote_counts, minority_neighbours,
        train_predictions, predictions_table, predict_combined, stream_combined, document_ids, evaluate_batch, stream_score,
        stream_labels, stream_corrections,
    )
}

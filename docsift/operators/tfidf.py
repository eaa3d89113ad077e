"""TF-IDF: vocabulary fit by aggregation, row-local transform."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel, keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import clean_text
from ..functions.stopwords import ENGLISH
from ..functions.tokens import ngrams, terms, tokens

# Most words that the bigram pass carries in its plan; beyond, it counts all bigrams.
FREQUENT_LIMIT = 50_000
TERM_SCHEMA = "feature_index int, feature_name string, df bigint, ctf bigint, idf double"


class TextCleaner(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage for the cleaning rules."""

    @keyword_only
    def __init__(self, *, inputCol: str = "text", outputCol: str = "clean"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(inputCol="text", outputCol="clean")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), clean_text(self.getInputCol()))


class TermExtractor(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage from cleaned text to n-gram terms."""

    stopWords = Param(Params._dummy(), "stopWords", "words to drop before n-grams", TypeConverters.toListString)
    minN = Param(Params._dummy(), "minN", "shortest n-gram", TypeConverters.toInt)
    maxN = Param(Params._dummy(), "maxN", "longest n-gram", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self, *, inputCol: str = "clean", outputCol: str = "terms", stopWords=None, minN: int = 1, maxN: int = 2
    ):
        super().__init__()
        given = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self._setDefault(inputCol="clean", outputCol="terms", stopWords=list(ENGLISH), minN=1, maxN=2)
        self._set(**given)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        words = tokens(self.getInputCol(), self.getOrDefault(self.stopWords))
        span = (self.getOrDefault(self.minN), self.getOrDefault(self.maxN))
        # Two projections, so that the tokens are computed once per row.
        staged = dataset.withColumn("_words", words)
        return staged.withColumn(self.getOutputCol(), terms(F.col("_words"), span)).drop("_words")


@dataclass(frozen=True)
class TfidfModel:
    """A fitted vocabulary. It has at most ``max_features`` rows, hence lives on the driver."""

    entries: tuple[tuple[str, int, int, float], ...]  # term, df, ctf, idf in alphabetical order
    n_docs: int
    ngram: tuple[int, int]
    stop_words: tuple[str, ...]

    @property
    def feature_names(self) -> list[str]:
        return [e[0] for e in self.entries]

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        rows = [(i, *entry) for i, entry in enumerate(self.entries)]
        return spark.createDataFrame(rows, TERM_SCHEMA)

    def stages(self, input_col: str = "clean", output_col: str = "tfidf") -> list[Transformer]:
        """Row-local stages; none of them shuffles."""
        if not self.entries:
            raise ValueError("the vocabulary is empty: no term reaches the document frequency limit")
        counter = CountVectorizerModel.from_vocabulary(
            self.feature_names, inputCol="_terms", outputCol="_counts", minTF=1.0
        )
        weigh = ElementwiseProduct(
            scalingVec=Vectors.dense([e[3] for e in self.entries]), inputCol="_counts", outputCol="_weighted"
        )
        low, high = self.ngram
        return [
            TermExtractor(
                inputCol=input_col, outputCol="_terms", stopWords=list(self.stop_words), minN=low, maxN=high
            ),
            counter,
            weigh,
            Normalizer(p=2.0, inputCol="_weighted", outputCol=output_col),
        ]

    def transform(self, docs: DataFrame, input_col: str = "clean", output_col: str = "tfidf") -> DataFrame:
        """Add the sparse TF-IDF vector; terms outside the vocabulary are dropped."""
        out = PipelineModel(self.stages(input_col, output_col)).transform(docs)
        return out.drop("_terms", "_counts", "_weighted")

    def transform_long(self, docs: DataFrame, key: str = "doc_id", input_col: str = "clean") -> DataFrame:
        """One row ``(key, feature_index, tfidf)`` per non-zero entry, without a shuffle."""
        return explode_vector(self.transform(docs.select(key, input_col), input_col), key, "tfidf")


def explode_vector(df: DataFrame, key: str, column: str, value: str | None = None) -> DataFrame:
    """Non-zero entries of a sparse vector column as rows.

    ``explode_outer`` is on purpose: ``explode`` would add a size filter that
    moves below the vector and computes it a second time.
    """
    raw = df.select(key, F.unwrap_udt(column).alias("_v"))
    rows = raw.select(key, F.explode_outer(F.arrays_zip("_v.indices", "_v.values")).alias("_e"))
    return rows.select(
        key, F.col("_e.indices").alias("feature_index"), F.col("_e.values").alias(value or column)
    ).filter("feature_index IS NOT NULL")


class Tfidf:
    """Estimator with smoothed idf ``ln((1+n)/(1+df)) + 1``, raw counts and unit rows."""

    def __init__(
        self,
        max_features: int = 2000,
        ngram: tuple[int, int] = (1, 2),
        min_df: int = 5,
        stop_words: Sequence[str] | None = None,
    ):
        self.max_features, self.ngram, self.min_df = max_features, tuple(ngram), min_df
        self.stop_words = tuple(ENGLISH if stop_words is None else stop_words)

    def fit(self, docs: DataFrame, input_col: str = "clean") -> TfidfModel:
        words = docs.select(tokens(input_col, self.stop_words).alias("words"))
        # Read up to three times: counting documents, unigrams, bigrams. On disk, as the words of a
        # large collection would fill the executors' heap, which is not given back for the steps after.
        words = words.persist(StorageLevel.DISK_ONLY)
        try:
            n_docs = words.count()
            top = self._top_terms(words)
        finally:
            words.unpersist()
        entries = tuple(
            (r.term, r.df, r.ctf, math.log((1 + n_docs) / (1 + r.df)) + 1) for r in sorted(top, key=lambda r: r.term)
        )
        return TfidfModel(entries, n_docs, self.ngram, self.stop_words)

    def _top_terms(self, words: DataFrame) -> list:
        low, high = self.ngram
        if (low, high) != (1, 2):
            stats = term_stats(words.select(terms(F.col("words"), self.ngram).alias("terms")))
            return self._cut(stats).collect()
        # Every occurrence of a bigram is an occurrence of both its words. So a
        # bigram reaches the top only if its words pass min_df and occur at least
        # as often as the last of the top unigrams, whose count is `floor`. Only
        # such bigrams are counted, instead of all bigrams of the collection.
        unigrams = term_stats(words.select(F.col("words").alias("terms"))).filter(F.col("df") >= self.min_df)
        unigrams = unigrams.persist()
        try:
            best = self._cut(unigrams).collect()
            floor = best[-1].ctf if len(best) == self.max_features else 0
            frequent = unigrams.filter(F.col("ctf") >= floor).select("term").limit(FREQUENT_LIMIT + 1).collect()
            candidates = F.col("words")
            if len(frequent) <= FREQUENT_LIMIT:
                # The words go into the plan as a hash set; a gap is a null, which no bigram survives.
                kept = [r.term for r in frequent]
                candidates = F.transform("words", lambda w: F.when(w.isin(kept), w))
            pairs = words.select(candidates.alias("words")).select(ngrams(F.col("words"), 2).alias("terms"))
            bigrams = term_stats(pairs).filter((F.col("df") >= self.min_df) & (F.col("ctf") >= floor))
            # Both sides are cut to max_features rows.
            rivals = best + self._cut(bigrams).collect()
            return sorted(rivals, key=lambda r: (-r.ctf, r.term))[: self.max_features]
        finally:
            unigrams.unpersist()

    def _cut(self, stats: DataFrame) -> DataFrame:
        kept = stats.filter(F.col("df") >= self.min_df)
        return kept.orderBy(F.desc("ctf"), "term").limit(self.max_features)


def term_stats(docs: DataFrame) -> DataFrame:
    """``term, df, ctf`` from a column ``terms`` with one array per document.

    Each document emits its terms once for the count and, after these, its distinct
    terms once for the document frequency; the place tells them apart, without a
    struct for each. Both sums merge on the map side, so there is one shuffle, by
    term, and a term found everywhere costs one row per task.
    """
    rows = docs.select(F.size("terms").alias("n"), F.posexplode_outer(F.concat("terms", F.array_distinct("terms"))).alias("i", "term"))
    own = (F.col("i") < F.col("n")).cast("int")
    return rows.filter("term IS NOT NULL").groupBy("term").agg(F.sum(1 - own).alias("df"), F.sum(own).alias("ctf"))

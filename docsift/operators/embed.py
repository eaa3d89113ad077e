"""Embeddings with a per-document cache, and feature assembly."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml import Transformer
from pyspark.ml.feature import MaxAbsScaler, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FEATURE_MODES
from ..schemas import EMBEDDINGS
from ..session import materialize

Encoder = Callable[[list[str]], np.ndarray]

#: Characters that a batch of texts may have after padding to its longest.
PADDED_CELLS = 1 << 18


class HashingEncoder:
    """Stand-in encoder: signed hashed word counts of unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in enumerate(texts):
            for word in re.findall(r"\w+", text):
                code = zlib.crc32(word.encode())
                out[row, code % self.dim] += 1.0 if code & 0x80000000 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)


def encode_texts(encoder: Encoder, texts: list[str], dim: int, cells: int = PADDED_CELLS) -> np.ndarray:
    """A vector for each text, in the same order; a blank text gives the zero vector.

    An encoder pads the texts of a batch to the longest. So texts are sorted by length, and a batch
    takes as many as fit into ``cells`` characters after padding; a longer text is a batch of its own.
    """
    vectors = np.zeros((len(texts), dim), dtype=np.float32)
    order = sorted((i for i, text in enumerate(texts) if text and text.strip()), key=lambda i: len(texts[i]))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and len(texts[order[stop]]) * (stop + 1 - at) <= cells:
            stop += 1
        batch = order[at:stop]
        found = np.asarray(encoder([texts[i] for i in batch]), dtype=np.float32)
        if found.shape != (len(batch), dim):
            raise ValueError(f"encoder returned {found.shape}, expected {(len(batch), dim)}")
        vectors[batch] = found
        at = stop
    return vectors


def encode(docs: DataFrame, encoder: Encoder, dim: int, text: str = "clean", cells: int = PADDED_CELLS) -> DataFrame:
    """``doc_id, embedding`` of each document; a blank text gives the zero vector.

    The encoder sees batches inside tasks, so only its weights must fit there.
    """

    def run(frames):
        for frame in frames:
            vectors = encode_texts(encoder, frame[text].fillna("").tolist(), dim, cells)
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "embedding": list(vectors)})

    return docs.select("doc_id", text).mapInPandas(run, EMBEDDINGS)


def sound_entries(cache: DataFrame, dim: int) -> DataFrame:
    """Entries of a cache that can be used: of the right length and without nulls."""
    return cache.filter((F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull()))


def with_semantic(
    docs: DataFrame, cache: DataFrame | None, encoder: Encoder, dim: int, text: str = "clean", output: str = "_semantic",
    cells: int = PADDED_CELLS,
) -> DataFrame:
    """``docs`` with their embedding as a vector: the cached one, else the encoder's for ``text``.

    One left join by ``doc_id``, in batch and in a stream alike; the encoder gets the texts of
    misses only. A null id is a miss. ``_encoded`` tells which rows were encoded.
    """

    @F.pandas_udf("array<float>")
    def encoded(texts: pd.Series) -> pd.Series:
        wanted = texts.notna().to_numpy()
        vectors = iter(encode_texts(encoder, texts[wanted].tolist(), dim, cells))
        return pd.Series([next(vectors) if w else None for w in wanted], dtype=object)

    if cache is None:
        joined = docs.withColumn("_cached", F.lit(None).cast("array<float>"))
    else:
        entries = sound_entries(cache, dim).groupBy("doc_id").agg(F.min("embedding").cast("array<float>").alias("_cached"))
        joined = docs.join(entries, "doc_id", "left")
    missing = F.col("_cached").isNull()
    filled = joined.withColumn("_encoded", missing).withColumn(
        "_made", encoded(F.when(missing, F.coalesce(F.col(text), F.lit(""))))
    )
    vector = array_to_vector(F.coalesce("_cached", "_made").cast("array<double>"))
    return sized(output, dim).transform(filled.withColumn(output, vector).drop("_cached", "_made"))


def split_embeddings(docs: DataFrame, cache: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Cached embeddings of the documents, and the documents without a sound one.

    Null entries and wrong lengths count as missing. Only ids are compared, so
    texts move only where misses are too many to broadcast.
    """
    sound = sound_entries(cache, dim)
    hits = sound.select("doc_id", "embedding").join(docs.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    missing = docs.select("doc_id").join(sound.select("doc_id"), "doc_id", "left_anti")
    return hits, docs.join(missing, "doc_id", "left_semi")


def embed_incremental(
    docs: DataFrame,
    cache: DataFrame,
    encoder: Encoder,
    dim: int,
    text: str = "clean",
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """All embeddings of the documents, and the new ones to append to the cache.

    ``prepare`` (such as the cleaning) then runs for the missing documents only. New
    embeddings are written once and read from there, however often they are used.
    """
    hits, misses = split_embeddings(docs, cache, dim)
    new = materialize(encode(prepare(misses) if prepare else misses, encoder, dim, text), "embeddings")
    return hits.unionByName(new), new


def combine(docs: DataFrame, embeddings: DataFrame | None, mode: str = "combined", output: str = "features_raw") -> DataFrame:
    """Feature vector of documents with ``tfidf``: words, embedding, or both side by side."""
    if mode not in FEATURE_MODES:
        raise ValueError(f"unknown feature mode {mode!r}; choose one of {', '.join(FEATURE_MODES)}")
    if mode == "tfidf":
        return docs.withColumn(output, F.col("tfidf"))
    vectors = embeddings.select("doc_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("_semantic"))
    joined = docs.join(vectors, "doc_id")
    if mode == "semantic":
        return joined.withColumnRenamed("_semantic", output)
    return assembler(output).transform(joined).drop("_semantic")


def sized(column: str, size: int) -> Transformer:
    """States the length of a vector column, so that an assembler need not read a row for it, which a stream can't."""
    return VectorSizeHint(inputCol=column, size=size, handleInvalid="optimistic")


def assembler(output: str = "features_raw") -> Transformer:
    return VectorAssembler(inputCols=["tfidf", "_semantic"], outputCol=output)


def fit_scaler(train: DataFrame, input_col: str = "features_raw", output_col: str = "features"):
    """Division by each column's largest magnitude in the training rows; empty columns stay 0."""
    return MaxAbsScaler(inputCol=input_col, outputCol=output_col).fit(train)

"""Stop words: a general English default plus lists given by the user."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Spark ML's public English stop words that can form a token of
# two or more plain letters.
ENGLISH = [
    "me", "my", "myself", "we", "our", "ours", "ourselves",
    "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves",
    "what", "which", "who", "whom", "this", "that", "these", "those",
    "am", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "having", "do", "does", "did", "doing",
    "an", "the", "and", "but", "if", "or", "because", "as", "until", "while",
    "of", "at", "by", "for", "with", "about", "against", "between", "into", "through",
    "during", "before", "after", "above", "below", "to", "from", "up", "down",
    "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each",
    "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own",
    "same", "so", "than", "too", "very", "can", "will", "just", "don", "should", "now",
    "cannot", "could", "ought", "would",
]


def combine(*lists: Iterable[str]) -> tuple[str, ...]:
    """Union of stop-word lists, first occurrence first."""
    return tuple(dict.fromkeys(word for words in lists for word in words))


def read_stop_words(spark: SparkSession, *paths: str, limit: int = 100_000) -> tuple[str, ...]:
    """Stop words from text files with one entry per line.

    Entries reach every executor inside the plan, so their number is checked.
    """
    words = spark.read.text(list(paths)).select(F.trim("value").alias("w")).filter("w != ''").distinct()
    rows = words.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} stop words")
    return tuple(sorted(r.w for r in rows))

"""Tokens and n-grams of a document, computed inside its row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import END, START
from .stopwords import ENGLISH

# Fixed value: a token is a whole word of two or more plain letters.
TOKEN_PATTERN = f"{START}[a-z]{{2,}}{END}"


def tokens(text: Column | str, stop_words: Sequence[str] | None = None) -> Column:
    """Lower-case tokens without stop words, in text order."""
    source = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(F.lower(source), F.lit(TOKEN_PATTERN), F.lit(0))
    words = list(ENGLISH if stop_words is None else stop_words)
    if not words:
        return found
    # IN with literals becomes a hash-set probe.
    return F.filter(found, lambda w: ~w.isin(words))


def ngrams(words: Column, n: int) -> Column:
    """Blank-separated n-grams over neighbouring tokens."""
    if n == 1:
        return words
    grams = words
    for shift in range(1, n):
        ahead = F.slice(words, shift + 1, F.greatest(F.size(words), F.lit(1)))
        # The shorter side is padded with null, and concat keeps the null.
        grams = F.zip_with(grams, ahead, lambda left, right: F.concat(left, F.lit(" "), right))
    return F.array_compact(grams)


def terms(words: Column, ngram: tuple[int, int]) -> Column:
    """All n-grams of the lengths ``ngram[0]``..``ngram[1]``."""
    low, high = ngram
    parts = [ngrams(words, n) for n in range(low, high + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)

"""Tokens for product and document search."""

from __future__ import annotations

from functools import cache

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the pattern of a token (two or more letters, digits or underscores).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


@cache
def default_stop_words() -> list[str]:
    """Spark ML's English list."""
    return StopWordsRemover.loadDefaultStopWords("english")


def raw_tokens(text: Column) -> Column:
    """Array of lower-case tokens of the whole text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def keep(term: Column, stop_words: list[str] | None = None) -> Column:
    """False for stop words (``stop_words=[]`` keeps everything)."""
    words = default_stop_words() if stop_words is None else stop_words
    return ~term.isin(words) if words else F.lit(True)


def tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Array of tokens with stop words left out."""
    return F.filter(raw_tokens(text), lambda t: keep(t, stop_words))

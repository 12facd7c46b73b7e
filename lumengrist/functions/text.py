"""Text expressions: markup, tokens, characters, predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BYTES_PER_KEYWORD, LEAST_KEYWORDS, MOST_KEYWORDS

CJK = r"^[一-鿿]+$"
BLANK = r"^[ \t\n\r\f\x0B]*$"


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def ascii_words(text: Column) -> Column:
    """Runs of ASCII letters, lower-cased after they are found, so that no other letter becomes one."""
    return F.filter(F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]+", " ")), " "), lambda w: w != "")


def is_cjk(word: Column) -> Column:
    return F.coalesce(word.rlike(CJK), F.lit(False))


def is_blank(word: Column) -> Column:
    return word.rlike(BLANK)


def characters(word: Column) -> Column:
    """The code points of a string; none of an empty one."""
    return F.filter(F.split(word, ""), lambda c: c != "")


def keyword_count(content: Column) -> Column:
    """How many keywords make a fingerprint, by the content's bytes."""
    share = F.floor(F.octet_length(content) / BYTES_PER_KEYWORD)
    return F.greatest(F.lit(LEAST_KEYWORDS), F.least(F.lit(MOST_KEYWORDS), share)).cast("int")


def without_stop_words(tokens: DataFrame, stop_words: DataFrame) -> DataFrame:
    """tokens (term, ...) without those of stop_words (term), a list short enough to broadcast only if the optimizer measures so."""
    return tokens.join(stop_words, "term", "left_anti")

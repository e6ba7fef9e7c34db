"""Scalar column functions shared by the operators."""

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from lyrascope.constants import NA_TOKENS, WHITESPACE


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is 0 where the denominator is 0."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def lookup(key: Column, mapping: Mapping, default=None) -> Column:
    """Value of a small constant mapping as a CASE expression, with a default."""
    result = F.lit(default)
    for name, value in mapping.items():
        result = F.when(key == name, F.lit(value)).otherwise(result)
    return result


def strip(text: Column) -> Column:
    """Remove all Unicode whitespace from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def missing_as_null(text: Column) -> Column:
    """NULL for texts that stand for a missing value."""
    return F.when(~text.isin(NA_TOKENS), text)


def source_words(text: Column) -> Column:
    """Words of a text whose lines are joined by <br>; the tag separates words."""
    spaced = F.regexp_replace(text, r"<br\s*/?>", " ")
    return F.array_remove(F.split(spaced, r"\s+"), "")


def plain_words(text: Column) -> Column:
    """Words between blanks, tabs and line ends."""
    return F.array_remove(F.split(text, "[ \\t\\n\\r]+"), "")


def terms(text: Column) -> Column:
    """Lower-case sequences of letters and marks of any script, used as topic terms."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}]+"), "")


def text_key(text: Column) -> Column:
    """Fixed-width stand-in for a text in groupings and joins."""
    return F.sha2(text, 256)

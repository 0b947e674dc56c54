"""Word sequences as built-in expressions, shared by the operators that may not leave the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts without a wider character take the fast function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def spaced_words(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text, one space between them; null is empty."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def word_array(spaced: Column) -> Column:
    """Array of the words of a spaced text; empty for none."""
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " ", -1))

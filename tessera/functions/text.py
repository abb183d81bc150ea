"""String and array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_WORD = "[A-Za-z]+"
PUNCTUATION = r"[ \(\[,\n.!?:;\]\)]+"


def punctuation_words(text: Column) -> Column:
    """Lower-cased words between punctuation and blanks; apostrophes and hyphens stay within words. May hold ''."""
    return F.transform(F.split(F.lower(text), PUNCTUATION), lambda w: F.trim(w))


def letter_words(text: Column) -> Column:
    """Lower-cased runs of the letters a-z."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "")


def comma_list(text: Column) -> Column:
    """The parts of a comma-separated list, trimmed."""
    return F.transform(F.split(text, ","), lambda w: F.trim(w))


def ascii_word(text: Column) -> Column:
    """Is it made of ASCII letters only?"""
    return text.rlike(f"^{ASCII_WORD}$")

"""Text functions as column expressions: normal forms, tokens, keys, hashes, overlap."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKEN = r"[\p{L}\p{N}]+"
#: The space characters that count as a plain space, as ranges of a character class.
EXOTIC_SPACES = r"[\t  -​  　]+"


@F.pandas_udf(StringType())
def nfc(values: pd.Series) -> pd.Series:
    """Unicode normal form C. Spark has no function for it; Arrow batches, and ASCII strings pass as they are."""
    return values.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def fold(text: Column) -> Column:
    """Case folding where it differs from lower case in Latin texts: sharp s."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded; texts are taken to be in normal form C (see nfc)."""
    return F.regexp_extract_all(fold(text), F.lit(f"({TOKEN})"), F.lit(1))


def word_count(text: Column) -> Column:
    """Runs of non-space characters: the deterministic token counter of passages."""
    return F.regexp_count(text, F.lit(r"\S+"))


def normalize_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(line, EXOTIC_SPACES, " "), " {2,}", " "))


def normalize_text(text: Column) -> Column:
    """Soft hyphens dropped, space runs collapsed within lines, empty lines dropped, lines joined by a space."""
    lines = F.split(F.replace(text, F.lit("­"), F.lit("")), r"\r\n|\r|\n")
    return F.trim(F.array_join(F.filter(F.transform(lines, normalize_line), lambda x: x != ""), " "))


def frequency_key(text: Column) -> Column:
    """What repeated page lines have in common: folded, digit runs as #, spaces collapsed."""
    return F.regexp_replace(F.regexp_replace(fold(normalize_text(text)), r"\d+", "#"), r"\s+", " ")


def normalize_reference(text: Column) -> Column:
    """Citations before matching: folded, dashes unified, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(text), "[–—]", "-"), r"\s+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def overlap_ratio(query: Column, source: Column) -> Column:
    """Distinct query tokens that the source has, as a share; 0 for a query without tokens."""
    q = F.array_distinct(tokens(query))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, tokens(source))), F.size(q)), F.lit(0.0))


def heading(text: Column) -> Column:
    return F.element_at(F.split(text, "\n"), 1)

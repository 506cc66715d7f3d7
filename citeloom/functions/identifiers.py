"""Identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    """Lower case of A to Z only."""
    return F.translate(as_column(c), ASCII_UPPER, ASCII_LOWER)


def normalize_doi(c: Column | str) -> Column:
    """Trimmed, one URL or 'doi:' prefix stripped, ASCII lower case; null for the placeholders NA, N/A, NULL, NONE, - and blank."""
    bare = F.trim(F.regexp_replace(F.trim(as_column(c)), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:)", ""))
    return F.when(F.upper(bare).isin("NA", "N/A", "NULL", "NONE", "-", ""), F.lit(None)).otherwise(ascii_lower(bare))

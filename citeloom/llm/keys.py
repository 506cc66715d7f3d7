"""Keys under which spellings of one identifier or title are the same, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.identifiers import as_column, ascii_lower

DOI_PREFIX = r"(?i)^(?:https?:/+)?(?:(?:dx|www)\.)*(?:doi\.org/+)?(?:(?:info:)?doi\s*[:/]?\s*)?"


def unescape_url(c: Column | str) -> Column:
    """Percent escapes resolved; the text itself where an escape is malformed. A plus sign stays one."""
    c = as_column(c)
    return F.when(c.contains("%"), F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)).otherwise(c)


def doi_key(c: Column | str) -> Column:
    """One key for all ways of writing a DOI: escapes, prefixes, case, blanks and end punctuation aside. Null for what is no DOI."""
    text = unescape_url(unescape_url(as_column(c)))
    text = F.regexp_replace(text, r"[\s\x{00A0}\x{00AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}]+", "")
    text = F.regexp_replace(text, r"^[<\[(\"'{]+", "")
    text = F.regexp_replace(text, DOI_PREFIX, "")
    text = F.regexp_replace(text, r"[.,;:\]\"'}>/]+$", "")
    # a closing bracket ends the DOI only if no bracket was opened in it
    text = F.when(text.contains("("), text).otherwise(F.regexp_replace(text, r"[)\].,;:\"'}>/]+$", ""))
    key = ascii_lower(text)
    return F.when(key.rlike(r"^10\.\d{2,9}(?:\.\d+)*/\S+$"), key)


def title_key(c: Column | str) -> Column:
    """The title's letters and digits in lower case; null under ten bytes."""
    key = F.regexp_replace(F.lower(as_column(c)), r"[^\p{L}\p{M}\p{N}]+", "")
    return F.when(F.octet_length(key) >= 10, key)

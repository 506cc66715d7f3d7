"""What of a text is its own: markup, cut-off marks and placeholders taken away."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.identifiers import as_column

MARKUP = r"</?[A-Za-z][^<>]*>|<!--.*?-->"
CUT_MARK = r"(?i)\s*(?:\[?\(?\s*(?:truncated|abstract truncated[^\])]*)\s*[\])]|…|\.\.\.+)\s*$"
# Texts that say there is none, without brackets, end punctuation and case.
NO_TEXT = ["", "-", "--", "n/a", "na", "none", "null", "nan", "unknown", "no abstract", "no abstract available", "abstract not available", "abstract missing", "abstract unavailable", "not available", "missing", "tbd"]


def own_text(c: Column | str) -> Column:
    """The text without markup and cut-off mark, blanks collapsed; null where nothing or a placeholder is left."""
    text = F.regexp_replace(as_column(c), MARKUP, " ")
    text = F.regexp_replace(text, r"[\s\x{00A0}\x{200B}\x{FEFF}]+", " ")
    text = F.trim(F.regexp_replace(text, CUT_MARK, ""))
    bare = F.lower(F.regexp_replace(text, r"^[\[(\s]+|[\])\s.!]+$", ""))
    return F.when(~bare.isin(NO_TEXT), text)


def trimmed_lower(c: Column | str) -> Column:
    """Lower case without outer blanks; null where nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(as_column(c), r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")), F.lit(""))

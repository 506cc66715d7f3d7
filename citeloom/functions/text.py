"""Text expressions: tokens, slugs, truncation, titles, journals, markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.identifiers import as_column

# The stop words of searching, and those of significant words.
STOP_WORDS = """a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with who what when where why how i you we he she me him her us do does did can could would should my your our""".split()
SIGNIFICANT_STOP_WORDS = """the a an and or of in to for with on at by from is are was were be been being have has had do does did will would could should may might this that these those it its we our they their which who whom what where when how not no nor as if then than too very can but however also such more most other some any all each every between through during before after above below about up out into over under again further using based used use study studies result results method methods approach approaches well""".split()
# Punctuation that a title key takes as a blank.
TITLE_PUNCTUATION = ".,;:!?'\"-()[]{}"


def literal_array(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


def tokenize(c: Column | str) -> Column:
    """Runs of letters and digits in lower case, in order; an empty array for null."""
    words = F.split(F.lower(as_column(c)), r"[^\p{IsAlphabetic}\p{N}]+")
    return F.coalesce(F.filter(words, lambda w: w != ""), F.array().cast("array<string>"))


def tokenize_for_match(c: Column | str) -> Column:
    """tokenize without stop words, or with them where nothing else is left."""
    raw = tokenize(c)
    kept = F.filter(raw, lambda w: ~w.isin(STOP_WORDS))
    return F.when(F.size(kept) == 0, raw).otherwise(kept)


def significant_words(c: Column | str) -> Column:
    """Words of four bytes or more that are no stop words, in lower case, repeats kept."""
    return F.filter(tokenize(c), lambda w: (F.octet_length(w) >= 4) & ~w.isin(SIGNIFICANT_STOP_WORDS))


def normalize_title(c: Column | str) -> Column:
    """Lower case, punctuation as blanks, blanks collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(as_column(c)), TITLE_PUNCTUATION, " " * len(TITLE_PUNCTUATION)), " +", " "))


def short_title(c: Column | str) -> Column:
    """Whether a title is too short, in bytes, for matching by title."""
    return F.octet_length(normalize_title(c)) < 10


def normalize_issn(c: Column | str) -> Column:
    """dddd-dddX of what precedes a bracket or semicolon, hyphenated where eight characters lack it; '' for anything else."""
    head = F.trim(F.regexp_replace(F.regexp_extract(F.trim(as_column(c)), r"^([^(;]*)", 1), r"\)+$", ""))
    dashed = F.when(head.rlike(r"^[A-Za-z0-9]{8}$"), F.concat(F.substring(head, 1, 4), F.lit("-"), F.substring(head, 5, 4))).otherwise(head)
    return F.when(dashed.rlike(r"^\d{4}-\d{3}[\dXx]$"), F.upper(dashed)).otherwise(F.lit(""))


def normalize_journal(c: Column | str) -> Column:
    """Lower case, trailing brackets off, '&' as 'and', ':' and '-' as blanks, blanks collapsed."""
    text = F.regexp_replace(F.lower(as_column(c)), r"(?:\s*\([^()]*\)\s*)+$", "")
    return F.trim(F.regexp_replace(F.translate(F.replace(text, F.lit("&"), F.lit("and")), ":-", "  "), r"\s+", " "))


def author_key(c: Column | str) -> Column:
    """Surname and initials: the first word before the others' initials where there is a comma, else the last word before those of the words before it."""
    raw = as_column(c)
    parts = F.filter(F.split(F.translate(F.lower(raw), ",.-_", "    "), r"\s+"), lambda w: w != "")
    initials = lambda a: F.array_join(F.transform(a, lambda w: F.substring(w, 1, 1)), "")
    n = F.size(parts)
    first = F.concat_ws(" ", F.element_at(parts, 1), initials(F.slice(parts, 2, F.greatest(n - 1, F.lit(0)))))
    last = F.concat_ws(" ", F.element_at(parts, -1), initials(F.slice(parts, 1, F.greatest(n - 1, F.lit(0)))))
    return F.when(n == 0, "").when(n == 1, F.element_at(parts, 1)).when(raw.contains(","), first).otherwise(last)


def author_display(c: Column | str) -> Column:
    """'Last, First': as it is where there is a comma, else the last word moved to the front."""
    text = F.trim(as_column(c))
    parts = F.split(text, r"\s+")
    moved = F.concat(F.element_at(parts, -1), F.lit(", "), F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), " "))
    return F.when(text.contains(",") | (F.size(parts) < 2), text).otherwise(moved)


def last_name(c: Column | str) -> Column:
    """What precedes the first comma, else the last word, in lower case."""
    text = F.trim(as_column(c))
    return F.lower(F.trim(F.when(text.contains(","), F.substring_index(text, ",", 1)).otherwise(F.element_at(F.split(text, r"\s+"), -1))))


def paper_label(authors: Column, year: Column) -> Column:
    """'First et al. (Year)', 'First (Year)' or 'Unknown'."""
    first = F.when(F.size(authors) > 0, F.element_at(authors, 1))
    name = F.when(first.isNull(), "Unknown").when(F.size(authors) > 1, F.concat(first, F.lit(" et al."))).otherwise(first)
    return F.when(year.isNull(), name).otherwise(F.concat(name, F.lit(" ("), year.cast("string"), F.lit(")")))


def sanitize_term(c: Column | str) -> Column:
    """Brackets and quotes off, outer punctuation off, blanks collapsed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(as_column(c), r"[\[\]\"']", ""), r"^[\s,.;:]+|[\s,.;:]+$", ""), r"\s+", " ")


def slug(c: Column | str) -> Column:
    """Lower-case letters and digits, anything between as one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(as_column(c)), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def snippet(c: Column | str, limit: int = 200) -> Column:
    """At most limit characters, cut at the last blank and marked with '...'."""
    text = F.trim(as_column(c))
    head = F.substring(text, 1, limit)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(head, r"\s+\S*$", ""), F.lit("...")))


def estimate_tokens(c: Column | str) -> Column:
    return F.floor(F.length(as_column(c)) / 4).cast("int")


def is_english(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(as_column(c))).isin("english", "en"), F.lit(False))


# Entities that markup removal decodes.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def strip_html(c: Column | str) -> Column:
    """Block tags as line ends, other tags off, entities decoded, blanks collapsed, at most one blank line."""
    text = F.regexp_replace(as_column(c), r"(?i)</?(?:p|div|br|h[1-6]|li|tr|table)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, plain in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(plain))
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def strip_rtf(c: Column | str) -> Column:
    """Control words and groups' braces off; paragraph marks as line ends."""
    text = F.regexp_replace(as_column(c), r"\\par[d]?\b ?", "\n")
    text = F.regexp_replace(text, r"\\'[0-9a-fA-F]{2}|\\[a-zA-Z]+-?\d* ?|[{}]", "")
    return F.regexp_replace(text, r"^\s+|\s+$", "")

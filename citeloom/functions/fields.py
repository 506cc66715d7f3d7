"""Expressions for single fields: lists in one string, tags, cuts at words, languages, colours, labels, ranges of dates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.identifiers import as_column, normalize_doi
from citeloom.functions.text import author_display, author_key

# Words that make a text English where they are 8 % of it or more.
ENGLISH = ["the", "of", "and", "to", "a", "in", "is", "for", "with", "on", "by", "this", "that", "from", "are", "was", "as", "be", "it", "an", "or"]
ENGLISH_SHARE, NON_LATIN_SHARE = 0.08, 0.9
# Keys under which a wrapped array may stand.
WRAPPERS = ["results", "result", "screenings", "data", "articles"]
# Labels of publication types.
TYPE_LABELS = {
    "JOUR": "Journal", "BOOK": "Book", "CHAP": "Chapter", "CONF": "Conference", "RPRT": "Reports", "MAGZ": "Magazine", "NEWS": "Newspaper", "THES": "Theses",
    "ELEC": "Electronic/Web", "DATA": "Data files", "ART": "Artwork", "BILL": "Bills", "PAMP": "Pamphlet", "PAT": "Patent", "VIDEO": "Video", "SOUND": "Sound",
}
# The colours of the first and last year, and of none.
FIRST_COLOUR, LAST_COLOUR, NO_COLOUR = (86, 180, 233), (230, 159, 0), "#cbd5e1"
#: Characters of a tag or label at most.
TAG_LENGTH = 35


def strip(c: Column | str) -> Column:
    return F.regexp_replace(as_column(c), r"^\s+|\s+$", "")


def _filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def split_authors(c: Column | str) -> Column:
    """The names in one string: a JSON array of strings or of objects with name, or family and given; else at semicolons, else at 'and', else at line ends."""
    raw = as_column(c)

    def name(x: Column) -> Column:
        field = lambda key: F.nullif(strip(F.get_json_object(x, f"$.{key}")), F.lit(""))
        of_object = F.coalesce(field("name"), F.when(field("family").isNotNull(), F.concat_ws(", ", field("family"), field("given"))))
        return F.when(x.startswith("{"), of_object).otherwise(strip(x))

    listed = F.when(strip(raw).startswith("["), F.from_json(strip(raw), "array<string>"))
    cut = F.when(raw.contains(";"), F.split(raw, ";")).when(F.lower(raw).contains(" and "), F.split(raw, "(?i) and ")).otherwise(F.split(raw, "\n"))
    return F.coalesce(F.filter(F.transform(listed, name), lambda x: x.isNotNull() & (x != "")), _filled(cut), F.array().cast("array<string>"))


def parse_authors(c: Column | str) -> Column:
    """(raw, display, key) of the names in one string."""
    return F.transform(split_authors(c), lambda x: F.struct(x.alias("raw"), author_display(x).alias("display"), author_key(x).alias("key")))


def split_keywords(c: Column | str) -> Column:
    """The keywords in one string: a JSON array, else at semicolons and commas."""
    raw = as_column(c)
    listed = F.when(strip(raw).startswith("["), F.from_json(strip(raw), "array<string>"))
    return F.coalesce(_filled(F.filter(listed, lambda x: x.isNotNull())), _filled(F.split(raw, "[;,]")), F.array().cast("array<string>"))


def term_form(c: Column | str) -> Column:
    """A term without case, outer punctuation, brackets and quotes, hyphens as blanks: what is stemmed word by word to its key."""
    outer = F.regexp_replace(F.lower(as_column(c)), r"^[\s,.;:\[\]]+|[\s,.;:\[\]]+$", "")
    return strip(F.regexp_replace(F.regexp_replace(F.translate(outer, "-_", "  "), r"[\[\]\"']", ""), r"\s+", " "))


def at_hyphen(c: Column, most: int = TAG_LENGTH) -> Column:
    """At most most characters of a hyphenated name, cut at its last hyphen where it has one."""
    head = F.substring(c, 1, most)
    return F.when(F.length(c) <= most, c).otherwise(F.regexp_replace(head, r"(?s)-[^-]*$", ""))


def sanitize_tag(c: Column | str) -> Column:
    """A tag or label: known prefixes off, small letters, hyphens for blanks and underscores, at most TAG_LENGTH characters."""
    bare = F.regexp_replace(F.lower(strip(c)), r"^(?:inclusion:|exclusion:|inclusion -|exclusion -)\s*", "")
    return at_hyphen(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"[\s_]", "-"), "-{2,}", "-"), "^-+|-+$", ""))


def sanitize_item_tag(c: Column | str) -> Column:
    """A tag of a reference manager: as sanitize_tag, but hyphens stand for all that is no letter or digit; null where nothing is left."""
    bare = F.regexp_replace(F.lower(strip(c)), r"^(?:inclusion:|exclusion:)\s*", "")
    plain = F.regexp_replace(F.regexp_replace(bare, r"[^\p{IsAlphabetic}\p{N}]+", "-"), "^-+|-+$", "")
    return F.nullif(F.regexp_replace(at_hyphen(plain), "^-+|-+$", ""), F.lit(""))


def tag_name(c: Column | str) -> Column:
    """'supply-chain' as 'Supply Chain'."""
    words = F.filter(F.split(as_column(c), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.translate(F.substring(w, 1, 1), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(w, 2, 1 << 30))), " ")


def cut_at_blank(c: Column | str, most: int) -> Column:
    """The words that end with a blank within most characters, and '...'; shorter texts as they are, a first word beyond that cut hard."""
    raw = as_column(c)
    head = F.substring(raw, 1, most)
    words = F.regexp_extract(head, r"(?s)^(.*\s)", 1)
    return F.when(F.length(raw) <= most, raw).otherwise(F.concat(F.regexp_replace(F.when(words == "", head).otherwise(words), r"\s+$", ""), F.lit("...")))


def cut_at_word(c: Column | str, most: int) -> Column:
    """cut_at_blank of the trimmed text, where a word may also end exactly at most characters."""
    text = strip(c)
    whole = F.substring(text, most + 1, 1).rlike(r"\s")
    return F.when(F.length(text) <= most, text).when(whole, F.concat(F.regexp_replace(F.substring(text, 1, most), r"\s+$", ""), F.lit("..."))).otherwise(cut_at_blank(text, most))


def english_abstract(c: Column | str) -> Column:
    """Whether a text is English by its stop words; never where nine in ten characters are outside Latin-1; false for blank texts."""
    raw = as_column(c)
    signs = F.regexp_replace(raw, r"\s", "")
    words = F.filter(F.split(raw, r"\s+"), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: F.regexp_replace(F.lower(w), r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$", "").isin(ENGLISH)))
    beyond = F.length(F.regexp_replace(signs, "[\u0000-ÿ]", ""))
    return F.coalesce((F.length(signs) > 0) & (beyond <= NON_LATIN_SHARE * F.length(signs)) & (hits >= ENGLISH_SHARE * F.size(words)), F.lit(False))


def array_in_json(c: Column | str) -> Column:
    """The JSON array in a JSON text, as JSON: itself, under a wrapper key, a single decision, an object of numbers, or the first array of objects; else null."""
    raw = as_column(c)
    root = F.from_json(raw, "map<string,string>")
    wrapped = F.coalesce(*(F.when(root[k].startswith("["), root[k]) for k in WRAPPERS))
    entries = F.map_entries(root)
    numbers = F.when((F.size(entries) > 0) & F.forall(entries, lambda e: e["key"].rlike(r"^\d+$") & e["value"].startswith("{")), F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].cast("long").alias("k"), e["value"].alias("v")))), lambda e: e["v"]), ","), F.lit("]")))
    first = F.get(F.filter(entries, lambda e: e["value"].rlike(r"^\[\s*\{")), F.lit(0))["value"]
    single = F.when(root["decision"].isNotNull(), F.concat(F.lit("["), raw, F.lit("]")))
    return F.when(strip(raw).startswith("["), strip(raw)).otherwise(F.coalesce(wrapped, single, numbers, first))


def claim_key(c: Column | str) -> Column:
    """A claim in small letters with single blanks."""
    return F.lower(F.regexp_replace(strip(c), r"\s+", " "))


def year_colour(year: Column, first: Column, last: Column) -> Column:
    """The colour of a year between the first and last one, as #rrggbb."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(year - first, last - first)))
    hexes = [F.lpad(F.lower(F.hex(F.floor(a + share * (b - a) + 0.5).cast("long"))), 2, "0") for a, b in zip(FIRST_COLOUR, LAST_COLOUR, strict=True)]
    plain = "#" + "".join(f"{x:02X}" for x in FIRST_COLOUR)
    return F.when(year.isNull(), NO_COLOUR).when(last <= first, plain).otherwise(F.concat(F.lit("#"), *hexes))


def type_label(c: Column | str) -> Column:
    """What a reference type is called; 'Publication' for others."""
    code, label = F.upper(F.trim(as_column(c))), F.lit("Publication")
    for key, name in TYPE_LABELS.items():
        label = F.when(code == key, name).otherwise(label)
    return label


def short_authors(names: Column, most: int = 3) -> Column:
    """Names joined by commas, or the first and 'et al.' beyond most."""
    return F.when(F.coalesce(F.size(names), F.lit(0)) <= 0, "").when(F.size(names) <= most, F.array_join(names, ", ")).otherwise(F.concat(F.element_at(names, 1), F.lit(" et al.")))


def search_terms(query: str) -> list[str]:
    """The words of a search of two characters or more that hold a letter or digit."""
    return [t for t in query.split() if len(t) >= 2 and any(x.isascii() and x.isalnum() for x in t)]


def highlighted(c: Column | str, query: str) -> Column:
    """HTML with the search's words marked, outside of tags."""
    import re

    terms = search_terms(query)
    if not terms:
        return as_column(c)
    return F.regexp_replace(as_column(c), f"(?i)({'|'.join(re.escape(t) for t in terms)})(?![^<]*>)", "<mark>$1</mark>")


def research_range(first: Column, last: Column, busiest: Column, today: str) -> Column:
    """(start, end): the years of a dataset after 2001; else two years about the busiest one; else the five years before today, an ISO date."""
    day, this = F.lit(today).cast("date"), int(today[:4])
    end_of = lambda year: F.least(F.make_date(year, F.lit(12), F.lit(31)), day)
    whole = F.struct(F.make_date(first, F.lit(1), F.lit(1)).alias("start"), end_of(F.least(F.lit(this), last)).alias("end"))
    low, high = F.when(busiest < 2004, 2002).otherwise(busiest - 2), F.when(busiest < 2004, 2006).otherwise(busiest + 2)
    start = F.when(high > this, F.greatest(F.lit(2002), F.lit(this - 4))).otherwise(low)
    about = F.struct(F.make_date(start, F.lit(1), F.lit(1)).alias("start"), end_of(F.least(high, F.lit(this))).alias("end"))
    return F.when(first > 2001, whole).when(busiest > 2001, about).otherwise(F.struct(F.date_sub(day, 1826).alias("start"), day.alias("end")))


def trend_keyword(c: Column | str) -> Column:
    """A keyword without punctuation at its end and without parentheses."""
    return strip(F.regexp_replace(strip(F.regexp_replace(strip(c), r"[.,;:!?]+$", "")), r"\s*[(\[][^)]*?[)\]]", ""))


def doi_query(c: Column | str) -> Column:
    """The DOI that a search asks for, null where it is none: then words are searched."""
    doi = normalize_doi(c)
    return F.when(doi.rlike(r"^10\.[^/\s]+/\S+$"), doi)


def vector_bytes(c: Column | str) -> Column:
    """A vector as the bytes of little-endian 32-bit floats."""
    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        import numpy as np

        return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())

    return pack(as_column(c))


def bytes_vector(c: Column | str) -> Column:
    """The vector that vector_bytes wrote; null where the bytes are no whole number of floats."""
    @F.pandas_udf("array<float>")
    def unpack(blobs: pd.Series) -> pd.Series:
        import numpy as np

        return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, dtype="<f4"))

    return unpack(as_column(c))


def repaired_json(c: Column | str) -> Column:
    """JSON inside fences or prose, with raw control characters, or cut off, as JSON; null where there is none."""
    @F.pandas_udf("string")
    def repair(texts: pd.Series) -> pd.Series:
        import json

        from citeloom.functions.repair import repair_json

        fixed = texts.map(lambda t: None if t is None else repair_json(t))
        return fixed.map(lambda v: None if v is None else json.dumps(v, ensure_ascii=False))

    return repair(as_column(c))


def parsed_affiliation(c: Column | str) -> Column:
    """(institution, city, country) of an affiliation in one line."""
    @F.pandas_udf("institution string, city string, country string")
    def parse(texts: pd.Series) -> pd.DataFrame:
        from citeloom.functions.repair import affiliation

        return pd.DataFrame([affiliation(t) for t in texts], columns=["institution", "city", "country"])

    return parse(as_column(c))


def truncated_query(c: Column | str, most: int = 1500) -> Column:
    """A boolean query within most bytes, its quotes and brackets whole."""
    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        from citeloom.functions.repair import truncate_query

        return texts.map(lambda t: None if t is None else truncate_query(t, most))

    return cut(as_column(c))

"""Records of catalogues and reference managers: works with inverted abstracts, items with creators, cited-reference lines, Markdown pages, CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.identifiers import as_column, normalize_doi
from citeloom.functions.text import strip_html

WORK = "id string, title string, doi string, publication_year int, language string, cited_by_count int, type string, abstract_inverted_index map<string, array<int>>, authorships array<struct<author: struct<id: string, display_name: string>>>, keywords array<struct<display_name: string>>, referenced_works array<string>, primary_location struct<source: struct<display_name: string, issn_l: string>>"
ITEM = "key string, itemType string, title string, abstractNote string, date string, DOI string, publicationTitle string, language string, creators array<struct<creatorType: string, firstName: string, lastName: string, name: string>>, tags array<struct<tag: string>>"


def abstract_of_index(index: Column | str) -> Column:
    """The text of an inverted index, a map from words to their positions; null for null and empty ones."""
    words = F.flatten(F.transform(F.map_entries(as_column(index)), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.nullif(F.array_join(F.transform(F.array_sort(words), lambda x: x["w"]), " "), F.lit(""))


def index_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, abstract_inverted_index) of rows with a text and a unique key: its words between blanks, with their positions."""
    words = rows.select(key, F.posexplode(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("p", "w"))
    each = words.groupBy(key, "w").agg(F.array_sort(F.collect_list("p")).alias("at"))
    return each.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("w", "at"))).alias("abstract_inverted_index"))


def works(rows: DataFrame, column: str) -> DataFrame:
    """Articles of catalogue works in JSON; a row that is no JSON has nulls."""
    w = rows.select(F.from_json(column, WORK).alias("w"))
    return w.select(F.col("w.id").alias("work_id"), "w.title", abstract_of_index("w.abstract_inverted_index").alias("abstract_text"), F.transform("w.authorships", lambda a: a["author"]["display_name"]).alias("authors"), "w.publication_year", normalize_doi("w.doi").alias("doi"), F.col("w.primary_location.source.display_name").alias("journal"), F.transform("w.keywords", lambda k: k["display_name"]).alias("keywords"), "w.language", F.col("w.cited_by_count").alias("num_cited"), F.size("w.referenced_works").alias("num_references"))


def read_works(spark: SparkSession, *paths: str) -> DataFrame:
    return works(spark.read.text(list(paths)), "value")


def items(rows: DataFrame, column: str) -> DataFrame:
    """Records of reference-manager items in JSON: authors, else editors, as 'Last, First'; notes and attachments have none."""
    i = rows.select(F.from_json(column, ITEM).alias("i")).where("i.itemType not in ('note', 'attachment', 'annotation')")
    people = lambda kind: F.transform(F.filter("i.creators", lambda c: c["creatorType"] == kind), lambda c: F.coalesce(F.nullif(F.concat_ws(", ", F.nullif(c["lastName"], F.lit("")), F.nullif(c["firstName"], F.lit(""))), F.lit("")), c["name"]))
    authors = F.when(F.size(people("author")) > 0, people("author")).otherwise(people("editor"))
    return i.select("i.key", "i.itemType", "i.title", F.col("i.abstractNote").alias("abstract_text"), authors.alias("authors"), F.regexp_extract("i.date", r"(\d{4})", 1).try_cast("int").alias("publication_year"), normalize_doi("i.DOI").alias("doi"), F.col("i.publicationTitle").alias("journal"), "i.language", F.transform("i.tags", lambda t: t["tag"]).alias("keywords"))


def merged_notes(rows: DataFrame, parent: str, note: str, added: str) -> DataFrame:
    """(parent, notes): the text of each parent's notes, oldest first."""
    text = rows.select(F.col(parent).alias("parent"), F.struct(F.col(added).alias("a"), strip_html(note).alias("t")).alias("n")).where("parent is not null")
    return text.groupBy("parent").agg(F.array_join(F.transform(F.array_sort(F.collect_list("n")), lambda x: x["t"]), "\n\n").alias("notes"))


def cited_reference(line: Column | str) -> Column:
    """The parts of a cited-reference line: author, year from 1000 to 2100, V volume, P page, DOI, and the rest as source. Null for a line without author and source."""
    parts = F.transform(F.split(as_column(line), ","), lambda x: F.trim(x))
    year = F.filter(parts, lambda x: x.rlike(r"^(?:1\d{3}|20\d{2}|2100)$"))
    volume, page = F.filter(parts, lambda x: x.rlike(r"^V\d+")), F.filter(parts, lambda x: x.rlike(r"^P[A-Z]?\d+"))
    doi = F.regexp_extract(as_column(line), r"(?i)DOI\s*\[?\s*(10\.[^\s,\]]+)", 1)
    rest = F.filter(F.slice(parts, 2, 99), lambda x: ~x.rlike(r"^(?:1\d{3}|20\d{2}|2100)$|^V\d+|^P[A-Z]?\d+|(?i)^\[?DOI|^10\.|\]$") & (x != ""))
    out = F.struct(F.get(parts, F.lit(0)).alias("author"), F.get(year, F.lit(0)).cast("int").alias("year"), F.get(rest, F.lit(0)).alias("source"), F.substring(F.get(volume, F.lit(0)), 2, 20).alias("volume"), F.substring(F.get(page, F.lit(0)), 2, 20).alias("page"), F.nullif(F.lower(doi), F.lit("")).alias("doi"))
    return F.when((F.size(parts) > 1) & (F.get(parts, F.lit(0)) != ""), out)


def frontmatter(text: Column | str) -> Column:
    """(meta, body) of a Markdown page: the keys of its block between '---' lines, lists as written; an empty map where there is none."""
    c = as_column(text)
    block = F.regexp_extract(c, r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?", 1)
    body = F.regexp_replace(c, r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "")
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^[\w-]+\s*:"))
    meta = F.map_from_entries(F.array_distinct(F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, r"^[^:]*:", ""))))))
    return F.struct(meta.alias("meta"), body.alias("body"))


def csv_to_markdown(text: Column | str) -> Column:
    """A Markdown table of CSV lines, cut at every comma; quotes off, blank lines left out."""
    lines = F.filter(F.split(as_column(text), r"\r?\n"), lambda x: F.trim(x) != "")
    row = lambda x: F.concat(F.lit("| "), F.array_join(F.transform(F.split(x, ","), lambda v: F.trim(F.regexp_replace(F.trim(v), '^"|"$', ""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.split(F.get(lines, F.lit(0)), ","))))
    return F.array_join(F.concat(F.transform(F.slice(lines, 1, 1), row), F.array(rule), F.transform(F.slice(lines, 2, 1 << 30), row)), "\n")


def to_camel(rows: DataFrame) -> DataFrame:
    """rows with column names in camel case, as a project export writes them."""
    camel = lambda c: c.split("_")[0] + "".join(p.capitalize() for p in c.split("_")[1:])
    return rows.toDF(*(camel(c) for c in rows.columns))

"""The faceted article query, paging, sorting and validation."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators.views import KEYS, article_tags, articles, links, papers
from citeloom.tables import table


@dataclass(frozen=True)
class ArticleFilter:
    """Predicates that are ANDed; what is left at its default filters nothing. all_of and none_of are keywords' semi and anti joins."""

    statuses: Sequence[str] | None = None
    search: str | None = None
    year_from: int | None = None
    year_to: int | None = None
    author: str | None = None
    journal: str | None = None
    doi: str | None = None
    doi_empty: bool = False
    language: Sequence[str] | None = None
    sources: Sequence[str] | None = None
    primary_only: bool = True
    sort: str = "imported_at"
    descending: bool = True
    limit: int | None = None
    offset: int = 0
    criterion: str | None = None
    criteria_outside: Sequence[str] | None = None
    criteria_empty: bool = False
    exclusion_empty: bool = False
    overridden: bool | None = None
    screening_error: bool = False
    notes: str | None = None
    extra: Sequence[Column] = field(default_factory=tuple)

    def predicates(self) -> list[Column]:
        has = lambda c, text: F.lower(F.coalesce(F.col(c), F.lit(""))).contains(text.lower())
        out: list[Column] = list(self.extra)
        if self.primary_only:
            out.append(F.col("duplicate_of").isNull())
        if self.statuses is not None:
            out.append(F.col("status").isin(list(self.statuses)))
        if self.search:
            out.append(has("title", self.search) | has("abstract_text", self.search))
        if self.year_from is not None:
            out.append(F.col("publication_year") >= self.year_from)
        if self.year_to is not None:
            out.append(F.col("publication_year") <= self.year_to)
        if self.author:
            out.append(F.exists("authors", lambda x: F.lower(x).contains(self.author.lower())))
        if self.journal:
            out.append(has("journal", self.journal))
        if self.doi_empty:
            out.append(F.col("doi").isNull() | (F.trim("doi") == ""))
        elif self.doi:
            out.append(has("doi", self.doi))
        if self.language is not None:
            out.append(F.lower(F.trim("language")).isin([x.lower() for x in self.language]))
        if self.sources is not None:
            out.append(F.col("import_source").isin(list(self.sources)))
        out += self.assessment_predicates()
        return out

    def assessment_predicates(self) -> list[Column]:
        """Those on the columns matched_inclusion and matched_exclusion (JSON arrays; what is no JSON counts as empty), screened, overridden and notes."""
        array = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
        both = lambda: F.concat(array("matched_inclusion"), array("matched_exclusion"))
        out: list[Column] = []
        if self.criterion is not None:
            out.append(F.array_contains(both(), self.criterion))
        if self.criteria_outside is not None:
            out.append(F.exists(both(), lambda x: ~x.isin(list(self.criteria_outside))))
        if self.criteria_empty:
            out.append(F.size(both()) == 0)
        if self.exclusion_empty:
            out.append(F.size(array("matched_exclusion")) == 0)
        if self.overridden is not None:
            out.append(F.col("overridden") == self.overridden)
        if self.screening_error:
            out.append((F.col("status") == "working") & F.col("screened"))
        if self.notes:
            out.append(F.lower(F.coalesce("notes", F.lit(""))).contains(self.notes.lower()))
        return out

    def apply(self, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        """The page of rows: filters that reach the scan, exact repeats once by the narrow key of articles, then the order with nulls last and the id as last key, then offset and limit."""
        kept = rows.where(reduce(lambda x, y: x & y, self.predicates(), F.lit(True)))
        once = kept.select(*dict.fromkeys((*KEYS["articles"], *columns, *([] if self.limit is None else [self.sort])))).distinct()
        if self.limit is None:
            return once.select(*columns)
        key = F.lower(self.sort) if dict(once.dtypes)[self.sort] == "string" else F.col(self.sort)
        return once.orderBy(key.desc_nulls_last() if self.descending else key.asc_nulls_last(), "id").offset(self.offset).limit(self.limit).select(*columns)

    def count(self, rows: DataFrame) -> DataFrame:
        return rows.where(reduce(lambda x, y: x & y, self.predicates(), F.lit(True))).select(*KEYS["articles"]).distinct().agg(F.count("*").alias("n"))


def parse_toolbar(text: str) -> ArticleFilter:
    """What a search line asks for: a: author, d: or doi: DOI, j: journal, y: or year: a year or range from 1850 to 2100; anything else is plain text."""
    m = re.match(r"\s*(a|d|doi|j|y|year):\s*(.*\S)\s*$", text, re.I)
    if not m:
        return ArticleFilter(search=text.strip() or None)
    kind, value = m.group(1).lower(), m.group(2)
    if kind == "a":
        return ArticleFilter(author=value)
    if kind in ("d", "doi"):
        return ArticleFilter(doi=value)
    if kind == "j":
        return ArticleFilter(journal=value)
    y = re.fullmatch(r"(\d{4})(?:\s*-\s*(\d{4}))?", value)
    if y:
        low, high = int(y.group(1)), int(y.group(2) or y.group(1))
        if 1850 <= low <= high <= 2100:
            return ArticleFilter(year_from=low, year_to=high)
    return ArticleFilter(search=text.strip())


PAGE = ("id", "title", "publication_year", "status")


def facet_query(spark: SparkSession, folder: str) -> DataFrame:
    f = ArticleFilter(statuses=["included", "working"], search="trial", year_from=2005, year_to=2020, author="a", sources=["openalex", "ris_import", "legacy_upload"])
    return f.apply(table(spark, folder, "articles"), PAGE)


def facet_page(spark: SparkSession, folder: str) -> DataFrame:
    return ArticleFilter(sort="title", descending=False, limit=50, offset=25).apply(table(spark, folder, "articles"), PAGE)


def facet_count(spark: SparkSession, folder: str) -> DataFrame:
    return ArticleFilter(language=["en", "english", "eng"], journal="reviews").count(table(spark, folder, "articles"))


def facet_doi_empty(spark: SparkSession, folder: str) -> DataFrame:
    return ArticleFilter(doi_empty=True).apply(table(spark, folder, "articles"), PAGE)


def facet_toolbar(spark: SparkSession, folder: str) -> DataFrame:
    return parse_toolbar("y: 2010-2012").apply(table(spark, folder, "articles"), PAGE)


def facet_all_of(spark: SparkSession, folder: str) -> DataFrame:
    """Papers that carry all of the wanted keywords, whatever their case: one grouped semi join for any number of keywords."""
    wanted = ["adult", "systematic review"]
    words = table(spark, folder, "reference_papers").select("id", F.explode("keywords").alias("k")).select("id", F.lower(F.trim("k")).alias("k")).where(F.col("k").isin(wanted)).groupBy("id").agg(F.countDistinct("k").alias("n")).where(F.col("n") == len(wanted))
    return words.select("id")


def facet_none_of(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "reference_papers").select("id", "keywords")
    has = p.where(F.exists("keywords", lambda k: F.lower(F.trim(k)).isin("adult", "humans"))).select("id")
    return p.select("id").distinct().join(has, "id", "left_anti")


def unknown_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """Papers with a keyword that no included article is tagged with: array elements absent from a dimension, as an anti join."""
    own = table(spark, folder, "articles").where("status = 'included'").select(F.col("id").alias("article_id"))
    known = article_tags(spark, folder).join(own, "article_id", "left_semi").select(F.col("tag").alias("k")).distinct()
    return table(spark, folder, "reference_papers").select("id", F.explode("keywords").alias("k")).select("id", F.lower(F.trim("k")).alias("k")).where("k <> ''").join(known, "k", "left_anti").select("id", "k").distinct()


def keyset_page(spark: SparkSession, folder: str) -> DataFrame:
    """The batch after a cursor: a range on the key, never an offset."""
    return articles(spark, folder, "status", "sequence_id").where("status = 'working' and sequence_id > 100").orderBy("sequence_id", "id").limit(40).select("id", "sequence_id")


def multi_sort(spark: SparkSession, folder: str) -> DataFrame:
    return articles(spark, folder, "num_cited", "publication_year").orderBy(F.coalesce("num_cited", F.lit(-1)).desc(), F.col("publication_year").desc_nulls_last(), "id").limit(40).select("id", "num_cited", "publication_year")


def paper_search(spark: SparkSession, folder: str) -> DataFrame:
    """Reference papers by text in title, abstract, DOI or journal, with their uses, most used first."""
    hit = reduce(lambda x, y: x | y, (F.lower(F.coalesce(c, F.lit(""))).contains("sleep") for c in ("title", "abstract_text", "doi", "journal")))
    p = table(spark, folder, "reference_papers").where(hit & (F.col("match_status") == "unmatched")).select("id", "title").distinct()
    uses = links(spark, folder).groupBy(F.col("paper").alias("id")).agg(F.count("*").alias("uses"))
    return p.join(uses, "id", "left").select("id", "title", F.coalesce("uses", F.lit(0)).alias("uses"))


def validation_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Records without title, abstract or authors, by message."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    errors = F.array_compact(F.array(F.when(blank("title"), "Missing title"), F.when(blank("abstract_text"), "Missing abstract"), F.when(F.coalesce(F.size("authors"), F.lit(0)) <= 0, "Missing authors")))
    return papers(spark, folder, "title", "abstract_text", "authors").select("id", F.explode(errors).alias("message")).groupBy("message").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def point_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Articles that other articles are duplicates of: an IN list as a semi join."""
    a = table(spark, folder, "articles").select("id", "title", "duplicate_of")
    return a.join(a.select(F.col("duplicate_of").alias("id")).where("id is not null"), "id", "left_semi").select("id", "title").distinct()


QUERIES = {f.__name__: f for f in (facet_query, facet_page, facet_count, facet_doi_empty, facet_toolbar, facet_all_of, facet_none_of, unknown_keywords, keyset_page, multi_sort, paper_search, validation_errors, point_lookup)}

A = "a as (select distinct * from articles)"
P = "p as (select distinct * from reference_papers)"
COLS = "id, title, publication_year, status"
SQL = {
    "facet_query": f"with {A} select {COLS} from a where duplicate_of is null and status in ('included', 'working') and (contains(lower(coalesce(title, '')), 'trial') or contains(lower(coalesce(abstract_text, '')), 'trial')) and publication_year between 2005 and 2020 and len(list_filter(authors, lambda x: contains(lower(x), 'a'))) > 0 and import_source in ('openalex', 'ris_import', 'legacy_upload')",
    "facet_page": f"with {A} select {COLS} from a where duplicate_of is null order by lower(title) nulls last, id limit 50 offset 25",
    "facet_count": f"with {A} select count(*) as n from a where duplicate_of is null and lower(trim(language)) in ('en', 'english', 'eng') and contains(lower(coalesce(journal, '')), 'reviews')",
    "facet_doi_empty": f"with {A} select {COLS} from a where duplicate_of is null and (doi is null or trim(doi) = '')",
    "facet_toolbar": f"with {A} select {COLS} from a where duplicate_of is null and publication_year between 2010 and 2012",
    "facet_all_of": "select id from (select id, lower(trim(unnest(keywords))) as k from reference_papers) where k in ('adult', 'systematic review') group by 1 having count(distinct k) = 2",
    "facet_none_of": "select distinct id from reference_papers where id not in (select id from (select id, lower(trim(unnest(keywords))) as k from reference_papers) where k in ('adult', 'humans'))",
    "unknown_keywords": "select distinct id, k from (select id, lower(trim(unnest(keywords))) as k from reference_papers) where k <> '' and k not in (select k from (select matched_article_id as a, lower(trim(unnest(keywords))) as k from reference_papers where matched_article_id in (select id from articles where status = 'included')) where k is not null)",
    "keyset_page": f"with {A} select id, sequence_id from a where status = 'working' and sequence_id > 100 order by 2, 1 limit 40",
    "multi_sort": f"with {A} select id, num_cited, publication_year from a order by coalesce(num_cited, -1) desc, publication_year desc nulls last, id limit 40",
    "paper_search": f"with {P}, s as (select distinct id, title from p where match_status = 'unmatched' and (contains(lower(coalesce(title, '')), 'sleep') or contains(lower(coalesce(abstract_text, '')), 'sleep') or contains(lower(coalesce(doi, '')), 'sleep') or contains(lower(coalesce(journal, '')), 'sleep'))) select id, title, coalesce(uses, 0) as uses from s left join (select paper as id, count(*) as uses from (select distinct parent, paper, type from article_links where parent is not null) group by 1) u using (id)",
    "validation_errors": f"with {P}, e as (select id, 'Missing title' as message from p where trim(coalesce(title, '')) = '' union all select id, 'Missing abstract' from p where trim(coalesce(abstract_text, '')) = '' union all select id, 'Missing authors' from p where coalesce(len(authors), 0) = 0) select message, count(*) as n, min(id) as first_id from e group by 1",
    "point_lookup": f"with {A} select distinct id, title from a where id in (select duplicate_of from a where duplicate_of is not null)",
}

"""The canonical views that the bibliometric operators work on, from the library's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.text import author_key, normalize_journal
from citeloom.tables import table


#: What tells rows of a table apart but for exact repeats: an article stands once for each source that it came from.
KEYS = {"articles": ("id", "import_source"), "reference_papers": ("id",), "audit_entries": ("id",)}


def once(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The key and the columns of a table, exact repeats once. No other column is read or shuffled, and filters on these reach the scan."""
    return table(spark, folder, name).select(*dict.fromkeys((*KEYS[name], *columns))).distinct()


def articles(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The library's articles, exact repeats once, with the columns asked for."""
    return once(spark, folder, "articles", *columns)


def papers(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The reference papers, exact repeats once, with the columns asked for."""
    return once(spark, folder, "reference_papers", *columns)


def entries(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The audit log, exact repeats once, with the columns asked for."""
    return once(spark, folder, "audit_entries", *columns)


def links(spark: SparkSession, folder: str) -> DataFrame:
    """(parent, paper, type), each once."""
    return table(spark, folder, "article_links").select("parent", "paper", "type").where("parent is not null and paper is not null").distinct()


def author_bridge(rows: DataFrame) -> DataFrame:
    """(article_id, author_order, raw_name, author): one row for each author with a key; the order counts all list elements from 0."""
    out = rows.select(F.col("id").alias("article_id"), F.posexplode("authors").alias("author_order", "raw_name"))
    return out.where("raw_name is not null").withColumn("author", author_key("raw_name")).where("author <> ''")


def article_tags(spark: SparkSession, folder: str) -> DataFrame:
    """(article_id, tag): the keywords of the papers that an article is matched with, in small letters, each once."""
    k = table(spark, folder, "reference_papers").where("matched_article_id is not null").select(F.col("matched_article_id").alias("article_id"), F.explode("keywords").alias("k"))
    return k.select("article_id", F.lower(F.trim("k")).alias("tag")).where("tag <> ''").distinct()


def criteria(spark: SparkSession, folder: str) -> DataFrame:
    """(id, kind, text, priority): the library's criteria, one for each source that trust is known of; trusted ones include, others exclude. A fixed table."""
    s = table(spark, folder, "source_trust").where("import_source is not null")
    return s.select(F.lower(F.trim("import_source")).alias("id"), F.when(F.col("trust_rank") <= 3, "inclusion").otherwise("exclusion").alias("kind"), F.initcap(F.translate("import_source", "_", " ")).alias("text"), F.col("trust_rank").alias("priority"))


def assessments(spark: SparkSession, folder: str) -> DataFrame:
    """(id, matched_inclusion, matched_exclusion): the criteria that each article met and failed, as JSON arrays, from the sources of what cites it and what it cites. The arrays are as long as there are sources."""
    r = table(spark, folder, "raw_references").where("parent_article_id is not null").select(F.col("parent_article_id").alias("id"), "reference_type", F.lower(F.trim("import_source")).alias("s"))
    of = lambda kind: F.to_json(F.array_sort(F.collect_set(F.when((F.col("reference_type") == kind) & (F.col("s") != ""), F.col("s")))))
    return r.groupBy("id").agg(of("reference").alias("matched_inclusion"), of("citation").alias("matched_exclusion"))


def journal_index(spark: SparkSession, folder: str) -> DataFrame:
    """(journal_id, title, journal_key, issn, eissn): the journals that articles and papers name; their numbers are made from the keys' hashes."""
    names = table(spark, folder, "articles").select("journal").unionByName(table(spark, folder, "reference_papers").select("journal")).where("trim(journal) <> ''")
    j = names.groupBy(normalize_journal("journal").alias("journal_key")).agg(F.min("journal").alias("title")).where("journal_key <> ''")
    return j.select(F.concat(F.lit("jn-"), F.substring(F.md5("journal_key"), 1, 10)).alias("journal_id"), "title", "journal_key", made_issn("journal_key", 1).alias("issn"), made_issn("journal_key", 9).alias("eissn"))


def made_issn(key: str, at: int) -> Column:
    """A number of the form dddd-dddd from the digest of a key."""
    d = F.translate(F.substring(F.md5(key), at, 8), "abcdef", "012345")
    return F.concat(F.substring(d, 1, 4), F.lit("-"), F.substring(d, 5, 4))

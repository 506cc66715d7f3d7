"""Indicators: yearly counts, growth, citation decay, h, g and i10 indices, author rankings, journals, countries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions.text import author_key, normalize_journal
from citeloom.operators.views import articles, links
from citeloom.tables import table

#: The year that counts as the current one where an operator needs it.
CURRENT_YEAR = 2025
# Shares of an article's citations in the years after it appeared.
DECAY = [0.02, 0.08, 0.13, 0.17, 0.15, 0.11]


def kpi_bundle(spark: SparkSession, folder: str) -> DataFrame:
    a = articles(spark, folder, "status", "publication_year", "num_cited").where("status = 'included'")
    years = F.countDistinct("publication_year")
    return a.agg(F.count("*").alias("n_articles"), F.coalesce(F.sum("num_cited"), F.lit(0)).alias("citations"), F.min("publication_year").alias("first_year"), F.max("publication_year").alias("last_year"), F.when(years > 0, F.round(F.count("*") / years, 6)).otherwise(0.0).alias("pubs_per_year"))


def pubs_by_year(spark: SparkSession, folder: str) -> DataFrame:
    return articles(spark, folder, "status", "publication_year").where("status = 'included' and publication_year is not null").groupBy("publication_year").agg(F.count("*").alias("n"))


def refs_by_year(spark: SparkSession, folder: str) -> DataFrame:
    """References (links of type 1) of the included articles by the article's year."""
    a = articles(spark, folder, "status", "publication_year").where("status = 'included' and publication_year is not null").select("id", "publication_year")
    n = links(spark, folder).where("type = 1").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("k"))
    return a.join(n, "id", "left").groupBy("publication_year").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_references"))


def growth_by_year(spark: SparkSession, folder: str) -> DataFrame:
    """Growth over the year before among the years that have articles; null for the first."""
    w = Window.orderBy("publication_year")  # one row a year
    before = F.lag("n").over(w)
    return pubs_by_year(spark, folder).select("publication_year", "n", F.round((F.col("n") - before) / before * 100, 6).alias("growth_pct"))


def growth_rate(spark: SparkSession, folder: str) -> DataFrame:
    return growth_by_year(spark, folder).agg(F.round(F.coalesce(F.avg("growth_pct"), F.lit(0.0)), 4).alias("avg_growth_pct"))


def citations_by_year(spark: SparkSession, folder: str) -> DataFrame:
    """Citing papers by their year; citations of articles without citing papers spread by DECAY, rounded each year, the rest on the current year."""
    a = articles(spark, folder, "status", "publication_year", "num_cited").where("status = 'included'").select("id", "publication_year", "num_cited")
    cites = links(spark, folder).where("type = 0").select(F.col("parent").alias("id"), "paper")
    years = table(spark, folder, "reference_papers").groupBy(F.col("id").alias("paper")).agg(F.min("publication_year").alias("year"))
    detail = cites.join(a.select("id"), "id", "left_semi").join(years, "paper").where("year is not null").groupBy("year").agg(F.count("*").alias("n"))
    plain = a.join(cites, "id", "left_anti").where("publication_year is not null and num_cited > 0")
    step = F.posexplode(F.array(*(F.lit(x) for x in DECAY))).alias("k", "share")
    spread = plain.select("id", "publication_year", "num_cited", step).withColumn("year", F.col("publication_year") + F.col("k")).where(F.col("year") <= CURRENT_YEAR).withColumn("n", F.round(F.col("num_cited") * F.col("share")).cast("long"))
    rest = plain.join(spread.groupBy("id").agg(F.sum("n").alias("s")), "id", "left").select(F.lit(CURRENT_YEAR).alias("year"), F.greatest(F.col("num_cited") - F.coalesce("s", F.lit(0)), F.lit(0)).alias("n"))
    return detail.union(spread.select("year", "n")).union(rest).groupBy("year").agg(F.sum("n").cast("long").alias("citations")).where("citations > 0")


def journal_year(spark: SparkSession, folder: str) -> DataFrame:
    return articles(spark, folder, "status", "publication_year", "journal").where("status = 'included' and publication_year is not null").groupBy(F.coalesce(F.upper(F.trim("journal")), F.lit("")).alias("journal"), "publication_year").agg(F.count("*").alias("n"))


def journal_info(spark: SparkSession, folder: str) -> DataFrame:
    return articles(spark, folder, "journal", "publication_year", "num_cited").where("journal is not null").groupBy(normalize_journal("journal").alias("journal")).agg(F.count("*").alias("n"), F.min("publication_year").alias("first_year"), F.max("publication_year").alias("last_year"), F.coalesce(F.sum("num_cited"), F.lit(0)).alias("citations"))


def top_journals(spark: SparkSession, folder: str) -> DataFrame:
    return journal_year(spark, folder).where("journal <> ''").groupBy("journal").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "journal").limit(10)


def _author_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(author, id, copies, num_cited, publication_year, places, first, last, alone): each author and article once; copies is how many rows the article has, one for each source.

    The articles are shuffled once, the authors once more; nothing is joined.
    """
    rows = table(spark, folder, "articles").groupBy("id").agg(F.max(F.struct("authors", "num_cited", "publication_year")).alias("m"), F.size(F.collect_set(F.coalesce("import_source", F.lit("")))).cast("long").alias("copies")).select("id", "copies", "m.*")
    keyed = F.filter(F.transform("authors", lambda x, i: F.struct(author_key(x).alias("author"), i.alias("place"))), lambda s: s["author"] != "")
    rows = rows.withColumn("keyed", keyed).where(F.size("keyed") > 0)
    each = rows.select("id", "copies", "num_cited", "publication_year", F.element_at("keyed", -1)["place"].alias("end"), (F.size("keyed") * F.col("copies") == 1).alias("alone"), F.explode("keyed").alias("x"))
    each = each.select("x.author", "id", "copies", "num_cited", "publication_year", "alone", F.col("x.place").alias("place"), "end")
    return each.groupBy("author", "id").agg(*(F.max(c).alias(c) for c in ("copies", "num_cited", "publication_year", "alone")), F.count("*").alias("places"), F.count_if(F.col("place") == 0).alias("first"), F.count_if(F.col("place") == F.col("end")).alias("last"))


def _author_stats(spark: SparkSession, folder: str) -> DataFrame:
    """One row an author: sums, years, places, and counts (num_cited, n) by number of citations, the most cited first. The list is as long as an author's citation counts are various."""
    r, k = _author_rows(spark, folder), F.col("copies")
    by_count = r.groupBy("author", "num_cited").agg(
        F.sum(k).alias("n"), F.sum(F.when(F.col("publication_year").isNotNull(), k)).alias("n_years"), F.sum(k * F.col("publication_year")).alias("years"), F.min("publication_year").alias("y0"), F.max("publication_year").alias("y1"),
        F.sum(k * k * F.col("first")).alias("n_first"), F.sum(k * k * F.col("last")).alias("n_last"), F.sum(F.when(F.col("alone"), k * k * F.col("places")).otherwise(0)).alias("n_alone"),
        F.sum(F.when(F.col("publication_year") > CURRENT_YEAR - 5, k * k * F.col("places")).otherwise(0)).alias("n_recent"),
    )
    counts = F.sort_array(F.collect_list(F.when(F.col("num_cited").isNotNull(), F.struct(F.col("num_cited").cast("long").alias("c"), F.col("n").alias("n")))), asc=False)
    return by_count.groupBy("author").agg(
        F.sum("n").alias("n_articles"), F.coalesce(F.sum(F.col("n") * F.col("num_cited")), F.lit(0)).alias("citations"), F.round(F.sum("years") / F.sum("n_years"), 6).alias("avg_year"), (F.max("y1") - F.min("y0") + 1).alias("years_active"),
        *(F.sum(c).alias(c) for c in ("n_first", "n_last", "n_alone", "n_recent")), F.sum(F.when(F.col("num_cited") >= 10, F.col("n")).otherwise(0)).alias("i10_index"), counts.alias("counts"),
    )


def _h(counts: str) -> Column:
    """The most h such that h articles are cited h times or more: over the counts from above, the greatest of least(count, articles so far)."""
    step = lambda s, x: F.struct((s["n"] + x["n"]).alias("n"), F.greatest(s["h"], F.least(x["c"], s["n"] + x["n"])).alias("h"))
    return F.aggregate(counts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("h")), step, lambda s: s["h"])


def _g(counts: str) -> Column:
    """The most g such that the g most cited articles together are cited g squared times or more: within equal counts c behind n articles of s citations, the greatest root of g * g <= s + (g - n) * c."""

    def step(s: Column, x: Column) -> Column:
        c = F.greatest(x["c"], F.lit(0).cast("long"))
        root = F.floor((c + F.sqrt((c * c + 4 * (s["s"] - s["n"] * c)).cast("double"))) / 2)
        g = F.least(root, s["n"] + x["n"])
        return F.struct((s["n"] + x["n"]).alias("n"), (s["s"] + x["n"] * c).alias("s"), F.when(g > s["n"], g).otherwise(s["g"]).alias("g"))

    return F.aggregate(counts, F.struct(*(F.lit(0).cast("long").alias(k) for k in ("n", "s", "g"))), step, lambda s: s["g"])


def author_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _author_stats(spark, folder).select("author", "n_articles", "citations", "avg_year")


def h_index(spark: SparkSession, folder: str) -> DataFrame:
    """The h-index of authors with a citation count."""
    return _author_stats(spark, folder).where(F.size("counts") > 0).select("author", _h("counts").alias("h_index"))


def g_index(spark: SparkSession, folder: str) -> DataFrame:
    """The g-index of authors with a citation count."""
    return _author_stats(spark, folder).where(F.size("counts") > 0).select("author", _g("counts").alias("g_index"))


def i10_index(spark: SparkSession, folder: str) -> DataFrame:
    return _author_stats(spark, folder).select("author", "i10_index")


def author_positions(spark: SparkSession, folder: str) -> DataFrame:
    """How often an author stands first, last and alone, and in the five latest years."""
    return _author_stats(spark, folder).select("author", "n_first", "n_last", "n_alone", "n_recent")


def author_rankings(spark: SparkSession, folder: str) -> DataFrame:
    productivity = F.round(F.when(F.col("years_active") > 0, F.col("n_articles") / F.col("years_active")).otherwise(F.col("n_articles").cast("double")), 6)
    return _author_stats(spark, folder).select("author", "n_articles", "citations", "avg_year", _h("counts").alias("h_index"), _g("counts").alias("g_index"), "i10_index", "years_active", "n_first", "n_last", "n_alone", "n_recent", productivity.alias("productivity"))


def author_kpis(spark: SparkSession, folder: str) -> DataFrame:
    r = author_rankings(spark, folder)
    return r.agg(F.count("*").alias("n_authors"), F.round(F.avg("h_index"), 6).alias("avg_h"), F.max("h_index").alias("max_h"), F.round(F.avg("citations"), 6).alias("avg_citations"))


def primary_institution(spark: SparkSession, folder: str) -> DataFrame:
    """Each author's institution of the latest row, the name deciding ties; one aggregation."""
    o = table(spark, folder, "openalex_authors").where("author_id is not null and institution is not null")
    best = F.max_by("institution", F.struct(F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp_ntz")), "institution"))
    return o.groupBy("author_id").agg(best.alias("institution"))


def geo_distribution(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "openalex_authors").where("trim(country) <> ''")
    return o.groupBy("country").agg(F.countDistinct("author_id").alias("n_authors"), F.countDistinct("institution").alias("n_institutions"))


def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return articles(spark, folder, "status").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("included", "working", "rejected", "duplicate")))


def articles_of_interest(spark: SparkSession, folder: str) -> DataFrame:
    """The ten papers outside the library that are used most, more than twice."""
    uses = links(spark, folder).groupBy("paper").agg(F.count("*").alias("uses")).where("uses > 2")
    unmatched = table(spark, folder, "reference_papers").where("match_status = 'unmatched'").select(F.col("id").alias("paper")).distinct()
    return uses.join(unmatched, "paper", "left_semi").orderBy(F.desc("uses"), "paper").limit(10)


def counters_by_article(spark: SparkSession, folder: str) -> DataFrame:
    """Each article's links by type."""
    return links(spark, folder).groupBy(F.col("parent").alias("article_id")).agg(F.count_if(F.col("type") == 0).alias("n_cited_by"), F.count_if(F.col("type") == 1).alias("n_references"))


def uses_by_paper(spark: SparkSession, folder: str) -> DataFrame:
    return links(spark, folder).groupBy("paper").pivot("type", [0, 1]).count().select("paper", F.coalesce(F.col("0"), F.lit(0)).alias("n_cites"), F.coalesce(F.col("1"), F.lit(0)).alias("n_cited"))


def language_counts(spark: SparkSession, folder: str) -> DataFrame:
    return articles(spark, folder, "language").groupBy(F.coalesce(F.lower(F.trim("language")), F.lit("")).alias("language")).agg(F.count("*").alias("n"))


def field_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many of an article's fields are filled."""
    filled = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in ("abstract_text", "authors", "publication_year", "doi", "journal", "language", "num_cited")), F.lit(0))
    return table(spark, folder, "articles").select("id", filled.alias("n_fields")).distinct()


def longest_article(spark: SparkSession, folder: str) -> DataFrame:
    size = F.length("title") + F.coalesce(F.length("abstract_text"), F.lit(0))
    return table(spark, folder, "articles").agg(F.coalesce(F.max(size), F.lit(0)).alias("max_chars"))


QUERIES = {
    f.__name__: f
    for f in (
        kpi_bundle, pubs_by_year, refs_by_year, growth_by_year, growth_rate, citations_by_year, journal_year, journal_info, top_journals, author_metrics, h_index, g_index, i10_index, author_positions, author_rankings,
        author_kpis, primary_institution, geo_distribution, status_counts, articles_of_interest, counters_by_article, uses_by_paper, language_counts, field_counts, longest_article,
    )
}

A = "a as (select distinct * from articles)"
L = "l as (select distinct parent, paper, type from article_links where parent is not null and paper is not null)"
#: The author key in SQL, of a column raw_name.
PARTS = r"list_filter(regexp_split_to_array(translate(lower(raw_name), ',.-_', '    '), '\s+'), lambda w: w <> '')"
KEY = "case when len(p) = 0 then '' when len(p) = 1 then p[1] when contains(raw_name, ',') then p[1] || ' ' || array_to_string(list_transform(p[2:], lambda w: left(w, 1)), '') else p[-1] || ' ' || array_to_string(list_transform(p[:-2], lambda w: left(w, 1)), '') end"
B = f"""{A}, e as (select id as article_id, unnest(authors) as raw_name, generate_subscripts(authors, 1) - 1 as author_order from a),
b as (select * from (select article_id, author_order, raw_name, {KEY} as author from (select *, {PARTS} as p from e where raw_name is not null)) where author <> '')"""
AA = f"{B}, aa as (select author, article_id, num_cited, publication_year from (select distinct author, article_id from b) x join a on a.id = x.article_id)"
H = "h as (select author, count(*) filter (num_cited >= r) as h_index from (select *, row_number() over (partition by author order by num_cited desc) as r from aa where num_cited is not null) group by author)"
G = "g as (select author, coalesce(max(r) filter (s >= r * r), 0) as g_index from (select author, row_number() over w as r, sum(greatest(num_cited, 0)) over (w rows unbounded preceding) as s from aa where num_cited is not null window w as (partition by author order by greatest(num_cited, 0) desc)) group by author)"
M = "m as (select author, count(*) as n_articles, coalesce(sum(num_cited), 0) as citations, round(avg(publication_year), 6) as avg_year from aa group by author)"
POS = "pos as (select author, count(*) filter (author_order = 0) as n_first, count(*) filter (author_order = last) as n_last, count(*) filter (n = 1) as n_alone, count(*) filter (publication_year > 2020) as n_recent from b join (select article_id, max(author_order) as last, count(*) as n from b group by 1) s using (article_id) join a on a.id = b.article_id group by author)"
I10 = "i as (select author, count(*) filter (num_cited >= 10) as i10_index from aa group by author)"
R = f"""{AA}, {H}, {G}, {M}, {POS}, {I10}, r as (select m.*, coalesce(h_index, 0) as h_index, coalesce(g_index, 0) as g_index, i10_index, years_active, n_first, n_last, n_alone, n_recent, round(case when years_active > 0 then n_articles / years_active else n_articles end, 6) as productivity
from m left join h using (author) left join g using (author) left join i using (author) left join (select author, max(publication_year) - min(publication_year) + 1 as years_active from aa group by author) y using (author) left join pos using (author))"""
PY = f"{A}, py as (select publication_year, count(*) as n from a where status = 'included' and publication_year is not null group by 1)"
JY = f"{A}, jy as (select coalesce(upper(trim(journal)), '') as journal, publication_year, count(*) as n from a where status = 'included' and publication_year is not null group by all)"
SQL = {
    "kpi_bundle": f"with {A} select count(*) as n_articles, coalesce(sum(num_cited), 0) as citations, min(publication_year) as first_year, max(publication_year) as last_year, round(count(*) / count(distinct publication_year), 6) as pubs_per_year from a where status = 'included'",
    "pubs_by_year": f"with {PY} select * from py",
    "refs_by_year": f"with {A}, {L} select publication_year, coalesce(sum(k), 0) as n_references from a left join (select parent as id, count(*) as k from l where type = 1 group by 1) n using (id) where status = 'included' and publication_year is not null group by 1",
    "growth_by_year": f"with {PY} select *, round((n - lag(n) over (order by publication_year)) / lag(n) over (order by publication_year) * 100, 6) as growth_pct from py",
    "growth_rate": f"with {PY} select round(coalesce(avg(g), 0), 4) as avg_growth_pct from (select round((n - lag(n) over (order by publication_year)) / lag(n) over (order by publication_year) * 100, 6) as g from py)",
    "citations_by_year": f"""with {A}, {L}, i as (select id, publication_year, num_cited from a where status = 'included'), c as (select parent as id, paper from l where type = 0),
      y as (select id as paper, min(publication_year) as year from reference_papers group by 1), p as (select * from i where id not in (select id from c) and publication_year is not null and num_cited > 0),
      d as (select k, [0.02, 0.08, 0.13, 0.17, 0.15, 0.11][k + 1]::double as share from range(6) t(k)),
      s as (select id, publication_year + k as year, round(num_cited * share)::bigint as n from p, d where publication_year + k <= 2025),
      u as (select year, count(*) as n from c join y using (paper) where year is not null and id in (select id from i) group by 1 union all select year, n from s union all select 2025, greatest(num_cited - coalesce(t, 0), 0) from p left join (select id, sum(n) as t from s group by 1) using (id))
      select year, sum(n)::bigint as citations from u group by 1 having sum(n) > 0""",
    "journal_year": f"with {JY} select * from jy",
    "journal_info": rf"with {A} select trim(regexp_replace(translate(replace(regexp_replace(lower(journal), '(?:\s*\([^()]*\)\s*)+$', ''), '&', 'and'), ':-', '  '), '\s+', ' ', 'g')) as journal, count(*) as n, min(publication_year) as first_year, max(publication_year) as last_year, coalesce(sum(num_cited), 0) as citations from a where journal is not null group by 1",
    "top_journals": f"with {JY} select journal, sum(n) as n from jy where journal <> '' group by 1 order by 2 desc, 1 limit 10",
    "author_metrics": f"with {AA}, {M} select * from m",
    "h_index": f"with {AA}, {H} select * from h",
    "g_index": f"with {AA}, {G} select * from g",
    "i10_index": f"with {AA}, {I10} select * from i",
    "author_positions": f"with {B}, {POS} select * from pos",
    "author_rankings": f"with {R} select * from r",
    "author_kpis": f"with {R} select count(*) as n_authors, round(avg(h_index), 6) as avg_h, max(h_index) as max_h, round(avg(citations), 6) as avg_citations from r",
    "primary_institution": "select author_id, last(institution order by coalesce(updated_at, timestamp '0001-01-01'), institution) as institution from openalex_authors where author_id is not null and institution is not null group by 1",
    "geo_distribution": "select country, count(distinct author_id) as n_authors, count(distinct institution) as n_institutions from openalex_authors where trim(country) <> '' group by 1",
    "status_counts": f"with {A} select count(*) filter (status = 'included') as included, count(*) filter (status = 'working') as working, count(*) filter (status = 'rejected') as rejected, count(*) filter (status = 'duplicate') as duplicate from a",
    "articles_of_interest": f"with {L} select paper, count(*) as uses from l where paper in (select id from reference_papers where match_status = 'unmatched') group by 1 having count(*) > 2 order by 2 desc, 1 limit 10",
    "counters_by_article": f"with {L} select parent as article_id, count(*) filter (type = 0) as n_cited_by, count(*) filter (type = 1) as n_references from l group by 1",
    "uses_by_paper": f"with {L} select paper, count(*) filter (type = 0) as n_cites, count(*) filter (type = 1) as n_cited from l group by 1",
    "language_counts": f"with {A} select coalesce(lower(trim(language)), '') as language, count(*) as n from a group by 1",
    "field_counts": f"with {A} select distinct id, (abstract_text is not null)::int + (authors is not null)::int + (publication_year is not null)::int + (doi is not null)::int + (journal is not null)::int + (language is not null)::int + (num_cited is not null)::int as n_fields from a",
    "longest_article": f"with {A} select coalesce(max(length(title) + coalesce(length(abstract_text), 0)), 0) as max_chars from a",
}

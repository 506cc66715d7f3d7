"""Keys, matches and duplicates of the library's records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions.identifiers import normalize_doi
from citeloom.functions.text import author_display, estimate_tokens, is_english, last_name, normalize_journal, normalize_title, paper_label, sanitize_term, significant_words, slug, snippet
from citeloom.operators.dedup import duplicate_pairs, kept_pairs, tiered_match
from citeloom.operators.views import articles, author_bridge, links, papers
from citeloom.tables import table


def doi_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "reference_papers").select("id", normalize_doi("doi").alias("doi")).distinct()


def title_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "reference_papers").select("id", normalize_title("title").alias("title_key"), (F.octet_length(normalize_title("title")) < 10).alias("short")).distinct()


def journal_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "reference_papers").select("journal", normalize_journal("journal").alias("journal_key")).where("journal is not null").distinct()


def name_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Author keys, display forms and last names of all raw names."""
    b = author_bridge(table(spark, folder, "reference_papers"))
    return b.select("raw_name", "author", author_display("raw_name").alias("display"), last_name("raw_name").alias("last_name")).distinct()


def text_measures(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "articles")
    return a.select("id", (F.length("title") + F.coalesce(F.length("abstract_text"), F.lit(0))).alias("data_length"), estimate_tokens("abstract_text").alias("token_estimate"), is_english("language").alias("english"), snippet("abstract_text").alias("snippet"), slug("title").alias("slug")).distinct()


def paper_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "articles").select("id", paper_label(F.col("authors"), F.col("publication_year")).alias("label")).distinct()


def term_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords of the papers as terms: sanitized, in lower case, with their papers."""
    k = papers(spark, folder, "keywords").select("id", F.explode("keywords").alias("raw")).where("raw is not null").select("id", F.lower(sanitize_term("raw")).alias("term")).where("term <> ''")
    return k.groupBy("term").agg(F.countDistinct("id").alias("n_papers"), F.count("*").alias("frequency"))


def significant_word_counts(spark: SparkSession, folder: str) -> DataFrame:
    a = articles(spark, folder, "title").select("id", F.explode(significant_words("title")).alias("word"))
    return a.groupBy("word").agg(F.count("*").alias("frequency"), F.countDistinct("id").alias("n_articles"))


def semi_exists(spark: SparkSession, folder: str) -> DataFrame:
    return papers(spark, folder).join(table(spark, folder, "article_links").where("parent is not null"), F.col("id") == F.col("paper"), "left_semi")


def anti_missing(spark: SparkSession, folder: str) -> DataFrame:
    return papers(spark, folder).join(table(spark, folder, "article_links").where("parent is not null"), F.col("id") == F.col("paper"), "left_anti")


def dois_in_library(spark: SparkSession, folder: str) -> DataFrame:
    own = table(spark, folder, "articles").select(normalize_doi("doi").alias("doi")).where("doi is not null")
    return table(spark, folder, "reference_papers").select(normalize_doi("doi").alias("doi")).distinct().join(own, "doi", "left_semi")


def references_of_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Each article's references, newest first, numbered."""
    p = table(spark, folder, "reference_papers").groupBy(F.col("id").alias("paper")).agg(F.max_by("title", F.struct("updated_at", "title")).alias("title"), F.max("publication_year").alias("year"))
    w = Window.partitionBy("parent").orderBy(F.col("year").desc_nulls_last(), "title", "paper")
    return links(spark, folder).where("type = 1").join(p, "paper").select("parent", "paper", F.row_number().over(w).alias("n"))


def tiered_matches(spark: SparkSession, folder: str) -> DataFrame:
    return tiered_match(table(spark, folder, "reference_papers"), table(spark, folder, "articles"))


def merge_survivor(spark: SparkSession, folder: str) -> DataFrame:
    """For each DOI the paper that stays: matched or imported ones first, then unmatched, then the oldest."""
    order = F.when(F.col("match_status").isin("matched", "imported"), 0).when(F.col("match_status") == "unmatched", 1).otherwise(2)
    w = Window.partitionBy("doi").orderBy(order, "created_at", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return papers(spark, folder, "match_status", "created_at", "doi").select("id", "match_status", "created_at", normalize_doi("doi").alias("doi")).where("doi is not null").select("id", "doi", F.first("id").over(w).alias("survivor")).distinct()


def links_after_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Links moved to the surviving papers, collisions dropped, counted."""
    to = merge_survivor(spark, folder).groupBy("id").agg(F.min("survivor").alias("survivor"))
    moved = links(spark, folder).join(to, F.col("paper") == F.col("id"), "left").select("parent", F.coalesce("survivor", "paper").alias("paper"), "type").distinct()
    return moved.groupBy("paper").agg(F.count_if(F.col("type") == 0).alias("n_cites"), F.count_if(F.col("type") == 1).alias("n_cited"))


def dedup_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return duplicate_pairs(table(spark, folder, "articles"))


def dedup_greedy(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs that a pass in id order keeps: each record takes its first partner that is left."""
    return kept_pairs(duplicate_pairs(table(spark, folder, "articles")))


def doc_exact_dups(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("hash")).distinct()
    return d.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


QUERIES = {
    f.__name__: f
    for f in (doi_normalize, title_normalize, journal_normalize, name_normalize, text_measures, paper_labels, term_counts, significant_word_counts, semi_exists, anti_missing, dois_in_library, references_of_articles, tiered_matches, merge_survivor, links_after_merge, dedup_pairs, dedup_greedy, doc_exact_dups)
}

from citeloom.functions.text import SIGNIFICANT_STOP_WORDS  # noqa: E402
from citeloom.plans.bibliometrics import KEY, PARTS, A, L  # noqa: E402

P = "p as (select distinct * from reference_papers)"
DOI = r"(case when upper(d) in ('NA', 'N/A', 'NULL', 'NONE', '-', '') then null else translate(d, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') end)"
BARE = r"trim(regexp_replace(trim(doi), '(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:)', ''))"
TITLE = "trim(regexp_replace(translate(lower(title), '.,;:!?''\"-()[]{}', '               '), ' +', ' ', 'g'))"
SURVIVOR = f"s as (select distinct id, doi, first_value(id) over (partition by doi order by case when match_status in ('matched', 'imported') then 0 when match_status = 'unmatched' then 1 else 2 end, created_at nulls first, id rows between unbounded preceding and unbounded following) as survivor from (select id, match_status, created_at, {DOI} as doi from (select *, {BARE} as d from p)) where doi is not null)"
SQL = {
    "doi_normalize": f"with {P} select distinct id, {DOI} as doi from (select id, {BARE} as d from p)",
    "title_normalize": f"with {P} select distinct id, {TITLE} as title_key, strlen({TITLE}) < 10 as short from p",
    "journal_normalize": r"select distinct journal, trim(regexp_replace(translate(replace(regexp_replace(lower(journal), '(?:\s*\([^()]*\)\s*)+$', ''), '&', 'and'), ':-', '  '), '\s+', ' ', 'g')) as journal_key from reference_papers where journal is not null",
    "name_normalize": rf"with e as (select distinct unnest(authors) as raw_name from reference_papers), b as (select *, {KEY} as author from (select *, {PARTS} as p from e where raw_name is not null)), t as (select *, trim(raw_name) as t, regexp_split_to_array(trim(raw_name), '\s+') as q from b where author <> '') select raw_name, author, case when contains(t, ',') or len(q) < 2 then t else q[-1] || ', ' || array_to_string(q[:-2], ' ') end as display, lower(trim(case when contains(t, ',') then split_part(t, ',', 1) else q[-1] end)) as last_name from t",
    "text_measures": rf"""with {A} select distinct id, length(title) + coalesce(length(abstract_text), 0) as data_length, length(abstract_text) // 4 as token_estimate, coalesce(lower(trim(language)) in ('english', 'en'), false) as english,
      case when length(trim(abstract_text)) <= 200 then trim(abstract_text) else regexp_replace(left(trim(abstract_text), 200), '\s+\S*$', '') || '...' end as snippet, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from a""",
    "paper_labels": f"with {A} select distinct id, case when authors[1] is null then 'Unknown' when len(authors) > 1 then authors[1] || ' et al.' else authors[1] end || case when publication_year is null then '' else ' (' || publication_year || ')' end as label from a",
    "term_counts": rf"with {P}, k as (select id, lower(regexp_replace(regexp_replace(regexp_replace(raw, '[\[\]\"'']', '', 'g'), '^[\s,.;:]+|[\s,.;:]+$', '', 'g'), '\s+', ' ', 'g')) as term from (select id, unnest(keywords) as raw from p) where raw is not null) select term, count(distinct id) as n_papers, count(*) as frequency from k where term <> '' group by 1",
    "significant_word_counts": rf"with {A}, w as (select id, unnest(regexp_split_to_array(lower(title), '[^\p{{L}}\p{{N}}]+')) as word from a) select word, count(*) as frequency, count(distinct id) as n_articles from w where strlen(word) >= 4 and word not in ({', '.join(repr(x) for x in SIGNIFICANT_STOP_WORDS)}) group by 1",
    "semi_exists": f"with {L} select distinct id from reference_papers where id in (select paper from l)",
    "anti_missing": f"with {L} select distinct id from reference_papers where id not in (select paper from l)",
    "dois_in_library": f"select distinct {DOI} as doi from (select {BARE} as d from reference_papers) where doi in (select {DOI} from (select {BARE} as d from articles) where {DOI} is not null)",
    "references_of_articles": f"with {L}, q as (select id as paper, last(title order by updated_at nulls first, title) as title, max(publication_year) as year from (select distinct * from reference_papers) group by 1) select parent, paper, row_number() over (partition by parent order by year desc nulls last, title, paper) as n from l join q using (paper) where type = 1",
    "merge_survivor": f"with {P}, {SURVIVOR} select * from s",
    "links_after_merge": f"with {P}, {L}, {SURVIVOR}, m as (select distinct parent, coalesce(survivor, paper) as paper, type from l left join (select id, min(survivor) as survivor from s group by 1) t on t.id = l.paper) select paper, count(*) filter (type = 0) as n_cites, count(*) filter (type = 1) as n_cited from m group by 1",
    "tiered_matches": f"""with k as (select 'p' as side, id, doi, title, journal, publication_year from reference_papers union select 'a', id, doi, title, journal, publication_year from articles),
      n as (select distinct side, id, {DOI} as doi, title, nullif(lower(trim(journal)), '') as journal, publication_year as year from (select *, {BARE} as d from (select side, id, doi, {TITLE} as title, journal, publication_year from k))),
      a as (select * from n where side = 'a'), p as (select * from n where side = 'p'),
      h as (select p.id, 0 as o, 'doi' as tier, a.id as article_id from p join a on p.doi = a.doi
        union all select p.id, 1, 'title_journal_year', a.id from p join a on p.title = a.title and p.journal = a.journal and p.year = a.year where p.title <> ''
        union all select p.id, 1, 'title_journal', a.id from p join a on p.title = a.title and p.journal = a.journal where p.year is null and p.title <> ''
        union all select p.id, 1, 'title_year', a.id from p join a on p.title = a.title and p.year = a.year where p.journal is null and p.title <> ''
        union all select p.id, 1, 'title', a.id from p join a on p.title = a.title where p.journal is null and p.year is null and p.title <> '')
      select id, first(article_id order by o, tier, article_id) as article_id, first(tier order by o, tier, article_id) as tier from h group by id""",
    "dedup_pairs": f"""with {A}, n as (select distinct id, {DOI} as doi, title, publication_year as year, lower(trim(case when contains(u, ',') then split_part(u, ',', 1) else regexp_split_to_array(u, '\\s+')[-1] end)) as author from (select *, {BARE} as d, trim(authors[1]) as u from (select id, doi, {TITLE} as title, publication_year, authors from a))),
      s as (select x.id as a, y.id as b, x.doi = y.doi as same_doi, x.year = y.year as same_year, x.author = y.author and x.author <> '' as same_author, strlen(x.title) >= 10 and strlen(y.title) >= 10 as long, 1 - levenshtein(x.title, y.title) / greatest(length(x.title), length(y.title), 1) as sim from n x join n y on x.id < y.id and (x.doi = y.doi or x.year = y.year or x.author = y.author)),
      t as (select a, b, case when same_doi then 1 when long and same_year and sim >= 0.95 then 2 when long and same_year and sim >= 0.7 then 3 when long and same_author and sim >= 0.8 then 4 end as tier, case when same_doi then 1.0 else sim end as score from s)
      select a, b, case when min(tier) <= 2 then 'exact' else 'fuzzy' end as kind, round(first(score order by tier, score), 6) as score from t where tier is not null group by a, b""",
    "doc_exact_dups": "select sha256(text) as hash, count(distinct doc_id) as n, min(doc_id) as first_id from documents where text is not null group by 1 having count(distinct doc_id) > 1",
}

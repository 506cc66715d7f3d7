"""Feeds over the audit log, and round trips of the sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.text import SIGNIFICANT_STOP_WORDS
from citeloom.operators.views import articles, entries
from citeloom.sources import bibtex, catalog, ris
from citeloom.streaming import audit
from citeloom.tables import table


def activity_feed(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred latest feed rows: entries as they are, imports grouped by their details."""
    e = entries(spark, folder, "ts", "action", "details").where("ts is not null")
    single = e.where("action <> 'imported'").select("id", "ts", "action", "details", F.lit(1).alias("n"))
    grouped = e.where("action = 'imported'").groupBy("details").agg(F.min("id").alias("id"), F.min("ts").alias("ts"), F.count("*").alias("n")).select("id", "ts", F.lit("imported").alias("action"), "details", "n")
    return single.unionByName(grouped).orderBy(F.desc("ts"), "id").limit(100)


def import_groups(spark: SparkSession, folder: str) -> DataFrame:
    return entries(spark, folder, "action", "details", "ts").where("action = 'imported'").groupBy("details").agg(F.min("ts").alias("ts"), F.count("*").alias("n"))


def feed_page(spark: SparkSession, folder: str) -> DataFrame:
    """The page before a time: a range on the key."""
    return entries(spark, folder, "ts", "action").where("ts < timestamp_ntz'2024-01-01 00:00:00'").orderBy(F.desc("ts"), "id").limit(50).select("id", "ts", "action")


def audit_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Each article's latest entry; one aggregation."""
    e = table(spark, folder, "audit_entries").where("article_id is not null and ts is not null")
    return e.groupBy("article_id").agg(F.max(F.struct("ts", "id", "action")).alias("m")).select("article_id", "m.ts", "m.id", "m.action")


def audit_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Entries by article title, cut at 55 characters, unknown articles under ''."""
    t = table(spark, folder, "articles").groupBy(F.col("id").alias("article_id")).agg(F.max(F.substring("title", 1, 55)).alias("title"))
    return entries(spark, folder, "article_id").join(t, "article_id", "left").groupBy(F.coalesce("title", F.lit("")).alias("title")).agg(F.count("*").alias("n"))


def audit_coalesce(spark: SparkSession, folder: str) -> DataFrame:
    return audit.coalesced(entries(spark, folder, "article_id", "action", "source", "ts", "to_status"))


def late_entries(spark: SparkSession, folder: str) -> DataFrame:
    """How late entries are loaded, by action, in whole days."""
    days = F.datediff("loaded_at", "ts")
    return entries(spark, folder, "ts", "loaded_at", "action").where("ts is not null and loaded_at is not null").groupBy("action").agg(F.count("*").alias("n"), F.count_if(days >= 1).alias("n_late"), F.max(days).alias("most_days"))


def _record(a: DataFrame) -> DataFrame:
    text = ris.write_record({"TY": F.lit("JOUR"), "TI": F.col("title"), "PY": F.col("publication_year").cast("string"), "DO": F.col("doi"), "T2": F.col("journal"), "AB": F.regexp_replace("abstract_text", r"\s*[\r\n]+\s*", " "), "LA": F.col("language")}, {"AU": F.col("authors")})
    return a.select("id", text.alias("record"))


def ris_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Articles written as RIS and read again."""
    return ris.parse_records(_record(table(spark, folder, "articles"))).select("id", "reference_type", "title", "publication_year", "doi", F.size("authors").alias("n_authors"), "journal").distinct()


def bibtex_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Articles written as BibTeX, with unique keys, and read again."""
    a = table(spark, folder, "articles").groupBy("id").agg(F.max(F.struct("title", "publication_year", "doi", "authors", "journal")).alias("m")).select("id", "m.*")
    a = a.withColumn("key", bibtex.citation_key(F.col("authors"), F.col("publication_year"), F.col("title"), SIGNIFICANT_STOP_WORDS))
    a = bibtex.unique_keys(a, "key", ["id"])
    text = bibtex.write_entry(F.col("key"), F.lit("article"), {"author": F.array_join("authors", " and "), "title": F.col("title"), "journal": F.col("journal"), "year": F.col("publication_year").cast("string"), "doi": F.col("doi")})
    back = bibtex.parse_texts(a.select(text.alias("text")), "text")
    return back.select("key", "title", "publication_year", F.size("authors").alias("n_authors"))


def citation_keys(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "articles").select("id", "title", "publication_year", "authors")
    return a.select("id", bibtex.citation_key(F.col("authors"), F.col("publication_year"), F.col("title"), SIGNIFICANT_STOP_WORDS).alias("key")).distinct()


def inverted_index_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    """Abstracts turned into inverted indexes and back: words between single blanks."""
    a = table(spark, folder, "articles").where(r"abstract_text rlike '\\S'").select("id", "abstract_text").distinct()
    return catalog.index_rows(a, "id", "abstract_text").select("id", catalog.abstract_of_index("abstract_inverted_index").alias("abstract_text"))


def project_json(spark: SparkSession, folder: str) -> DataFrame:
    """Articles as the JSON objects of a project export, read again."""
    a = table(spark, folder, "articles").select("id", "sequence_id", "title", "publication_year", "num_cited")
    text = catalog.to_camel(a).select(F.to_json(F.struct("*")).alias("j"))
    back = text.select(F.from_json("j", "id string, sequenceId bigint, title string, publicationYear int, numCited int").alias("x"))
    return back.select("x.id", F.col("x.sequenceId").alias("sequence_id"), "x.title", F.col("x.publicationYear").alias("publication_year"), F.col("x.numCited").alias("num_cited")).distinct()


def manifest_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Embedded texts against the tasks: what is added, removed or changed, by article and chunk."""
    one = lambda df, c: df.groupBy("article_id", "chunk_index").agg(F.max(c).alias("h"))
    return audit.changed(one(table(spark, folder, "article_embeddings"), "input_hash"), one(table(spark, folder, "embed_tasks"), "input_hash"), ["article_id", "chunk_index"], "h")


QUERIES = {f.__name__: f for f in (activity_feed, import_groups, feed_page, audit_latest, audit_titles, audit_coalesce, late_entries, ris_round_trip, bibtex_round_trip, citation_keys, inverted_index_rebuild, project_json, manifest_changes)}

E = "e as (select distinct * from audit_entries)"
A = "a as (select distinct * from articles)"
from citeloom.plans.matching import BARE, DOI  # noqa: E402

STOP = ", ".join(repr(w) for w in SIGNIFICANT_STOP_WORDS)
FOLD = "regexp_replace(translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]', '', 'g')"
SURNAME = r"case when contains(f, ',') then split_part(f, ',', 1) else regexp_split_to_array(f, '\s+')[-1] end"
CK = rf"""k as (select id, title, publication_year, coalesce(len(authors), 0) as n_authors, coalesce(nullif({FOLD.format(SURNAME)}, ''), 'anon') || coalesce(publication_year::varchar, 'nd')
|| coalesce(list_filter(list_transform(regexp_split_to_array(coalesce(title, ''), '\s+'), lambda w: {FOLD.format('w')}), lambda w: w <> '' and w not in ({STOP}))[1], '') as key from (select distinct id, title, publication_year, authors, trim(authors[1]) as f from a))"""
SQL = {
    "activity_feed": f"with {E}, f as (select id, ts, action, details, 1 as n from e where ts is not null and action <> 'imported' union all select min(id), min(ts), 'imported', details, count(*) from e where ts is not null and action = 'imported' group by details) select * from f order by ts desc, id limit 100",
    "import_groups": f"with {E} select details, min(ts) as ts, count(*) as n from e where action = 'imported' group by 1",
    "feed_page": f"with {E} select id, ts, action from e where ts < timestamp '2024-01-01' order by ts desc, id limit 50",
    "audit_latest": f"with {E} select article_id, max(ts) as ts, last(id order by ts, id, action nulls first) as id, last(action order by ts, id, action nulls first) as action from e where article_id is not null and ts is not null group by 1",
    "audit_titles": f"with {E}, {A} select coalesce(t, '') as title, count(*) as n from e left join (select id as article_id, max(left(title, 55)) as t from a group by 1) x using (article_id) group by 1",
    "audit_coalesce": f"""with {E}, g as (select *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) over w > 300000000, true)::int as fresh from e where ts is not null window w as (partition by article_id, action, source order by ts, id)),
      r as (select *, sum(fresh) over (partition by article_id, action, source order by ts, id rows unbounded preceding) as run from g)
      select article_id, action, source, min(ts) as started, max(ts) as ts, count(*) as n, last(id order by ts, id) as id, last(to_status order by ts, id) as to_status from r group by article_id, action, source, run""",
    "late_entries": f"with {E} select action, count(*) as n, count(*) filter (date_diff('day', ts::date, loaded_at::date) >= 1) as n_late, max(date_diff('day', ts::date, loaded_at::date)) as most_days from e where ts is not null and loaded_at is not null group by 1",
    "ris_round_trip": rf"with {A} select distinct id, 'JOUR' as reference_type, nullif(trim(title), '') as title, publication_year, {DOI} as doi, coalesce(len(authors), 0) as n_authors, nullif(trim(journal), '') as journal from (select *, {BARE} as d from a)",
    "citation_keys": f"with {A}, {CK} select distinct id, key from k",
    "bibtex_round_trip": rf"with {A}, {CK}, o as (select *, row_number() over (partition by key order by id) as r from k) select case when r = 1 then key else key || chr(96 + least(r, 26)::int) end as key, trim(regexp_replace(title, '\s+', ' ', 'g')) as title, publication_year, n_authors from o",
    "inverted_index_rebuild": rf"with {A} select distinct id, trim(regexp_replace(abstract_text, '\s+', ' ', 'g')) as abstract_text from a where regexp_matches(abstract_text, '\S')",
    "project_json": f"with {A} select distinct id, sequence_id, title, publication_year, num_cited from a",
    "manifest_changes": "with o as (select article_id, chunk_index, max(input_hash) as o from article_embeddings group by all), n as (select article_id, chunk_index, max(input_hash) as n from embed_tasks group by all) select article_id, chunk_index, case when o is null then 'added' when n is null then 'removed' else 'changed' end as change from o full join n using (article_id, chunk_index) where o is distinct from n",
}

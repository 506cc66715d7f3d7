"""What is read and written as a whole: records of other programs made of the library's tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.identifiers import normalize_doi
from citeloom.functions.text import slug, strip_html, strip_rtf
from citeloom.operators.views import article_tags, assessments, journal_index
from citeloom.plans.library import prisma_counts
from citeloom.plans.networks import citation_edges, coauthor_edges
from citeloom.plans.pages import wiki_pages
from citeloom.session import scratch_dir
from citeloom.sources import catalog, exchange, ris
from citeloom.tables import table


def _articles(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "articles").select("id", *columns).distinct()


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def works_read(spark: SparkSession, folder: str) -> DataFrame:
    """Articles written as a catalogue's works in JSON, with inverted abstracts, and read as articles."""
    a = _articles(spark, folder, "title", "abstract_text", "authors", "publication_year", "doi", "language", "num_cited", "journal")
    index = catalog.index_rows(a.where(r"abstract_text rlike '\\S'").select("id", "abstract_text").distinct(), "id", "abstract_text")
    people = F.transform("authors", lambda n: F.struct(F.struct(n.alias("id"), n.alias("display_name")).alias("author")))
    work = F.struct("id", "title", "doi", "publication_year", "language", F.col("num_cited").alias("cited_by_count"), "abstract_inverted_index", people.alias("authorships"), F.struct(F.struct(F.col("journal").alias("display_name")).alias("source")).alias("primary_location"))
    rows = a.join(index, "id", "left").select(F.to_json(work).alias("j"))
    return catalog.works(rows, "j").select(F.col("work_id").alias("id"), "title", "doi", F.size("authors").alias("n_authors"), F.length("abstract_text").alias("abstract_chars"), "journal", "num_cited")


def works_as_papers(spark: SparkSession, folder: str) -> DataFrame:
    """Reference papers out of works: DOI, year, counts, and their identity by DOI or title."""
    p = table(spark, folder, "reference_papers").select("id", "title", "doi", "publication_year", "citation_count").distinct()
    rows = p.select(F.to_json(F.struct("id", "title", "doi", "publication_year", F.col("citation_count").alias("cited_by_count"), F.array("id", "id").alias("referenced_works"))).alias("j"))
    return catalog.works(rows, "j").select(F.col("work_id").alias("id"), "doi", "publication_year", F.col("num_cited").alias("citation_count"), "num_references")


def items_read(spark: SparkSession, folder: str) -> DataFrame:
    """Articles written as a reference manager's items and read again; notes are none."""
    a = _articles(spark, folder, "title", "abstract_text", "authors", "publication_year", "doi", "journal", "language")
    items = exchange.to_items(a).select(F.col("item").alias("j"))
    keyed = exchange.to_items(a).select(F.concat(F.lit('{"key":"'), "id", F.lit('",'), F.substring("item", 2, 1 << 30)).alias("j"))
    note = items.limit(3).select(F.lit('{"key":"n","itemType":"note"}').alias("j"))
    return catalog.items(keyed.unionByName(note), "j").select(F.col("key").alias("id"), "title", "publication_year", "doi", "journal", F.size("authors").alias("n_authors"))


def items_written(spark: SparkSession, folder: str) -> DataFrame:
    """The items of articles, field by field."""
    i = exchange.to_items(_articles(spark, folder, "title", "abstract_text", "authors", "publication_year", "doi", "journal", "language"))
    field = lambda p: F.get_json_object("item", p)
    return i.select("id", field("$.itemType").alias("kind"), field("$.title").alias("title"), field("$.date").alias("date"), field("$.DOI").alias("doi"), field("$.creators[0].lastName").alias("last_name"), field("$.creators[0].firstName").alias("first_name"))


def notes_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Notes in HTML by article, oldest first, as one text."""
    d = table(spark, folder, "documents").where("article_id is not null and trim(lower(source)) = 'screening_note' and text is not null")
    rows = d.select("article_id", F.concat(F.lit("<p>note <b>"), F.col("doc_id").cast("string"), F.lit("</b></p>")).alias("note"), F.struct(F.coalesce("added_at", F.lit("0001-01-01").cast("timestamp_ntz")), "doc_id").alias("added"))
    return catalog.merged_notes(rows, "article_id", "note", "added")


def cited_references(spark: SparkSession, folder: str) -> DataFrame:
    """Cited-reference lines of articles, taken apart into papers: one row a line that can be read."""
    r = table(spark, folder, "raw_references").where("title is not null and trim(get(authors, 0)) <> ''").select("link_id", "authors", "publication_year", "doi").distinct()
    author = F.regexp_replace(F.element_at("authors", 1), ",", "")
    line = F.concat_ws(", ", author, F.col("publication_year").cast("string"), F.lit("J CLIN RES"), F.lit("V12"), F.lit("P34"), F.when(normalize_doi("doi").isNotNull(), F.concat(F.lit("DOI "), normalize_doi("doi"))))
    rows = r.where(r"doi is null or doi not rlike '[\\s,\\]]'").select("link_id", F.map_from_arrays(F.array(F.lit("CR")), F.array(F.array(line, F.lit("nothing")))).alias("extras"))
    each = rows.select("link_id", F.explode(F.col("extras")["CR"]).alias("line")).select("link_id", catalog.cited_reference("line").alias("x"))
    return each.where("x is not null").select("link_id", "x.author", "x.year", "x.source", "x.volume", "x.page")


def reference_types(spark: SparkSession, folder: str) -> DataFrame:
    """The codes of all names that kinds of references go by, and those of records under them."""
    names = [(n, code) for code, all_names in ris.TYPES.items() for n in all_names.split("|")]
    known = spark.createDataFrame(names, "name string, code string")  # fixed
    return known.select("name", ris.reference_type(F.initcap("name")).alias("code"))


def citation_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Articles written as RIS with counts in a note that goes on over lines, and read again."""
    a = _articles(spark, folder, "title", "num_cited").where("title is not null and num_cited >= 0")
    note = F.concat(F.lit("Times Cited in X: 3\nTotal Times Cited: "), F.col("num_cited").cast("string"), F.lit("\nCited Reference Count: 17"))
    record = F.concat(F.lit("TY  - JOUR\nTI  - "), F.regexp_replace(F.trim("title"), r"\s*[\r\n]+\s*", " "), F.lit("\nN1  - "), note, F.lit("\nER  - \n"))
    return ris.parse_records(a.select("id", record.alias("record"))).select("id", "num_cited", "num_references")


def journals_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The journal list written as CSV and loaded."""
    path = _scratch(spark, "journals")
    journal_index(spark, folder).select(F.col("title").alias("journal_title"), "issn", "eissn", F.lit("a publisher").alias("publisher_name")).write.option("header", True).csv(path)
    return exchange.read_journals(spark, path)


def page_frontmatter(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown pages with a block of fields, read: fields and body."""
    a = _articles(spark, folder, "status", "publication_year")
    text = F.concat(F.lit("---\ntitle: Page of "), "id", F.lit("\ntype: concept\ntags: [a, b]\nstatus: "), "status", F.lit("\n---\nBody "), F.coalesce(F.col("publication_year").cast("string"), F.lit("none")))
    return a.select("id", catalog.frontmatter(text).alias("f")).select("id", F.col("f.meta")["title"].alias("title"), F.col("f.meta")["status"].alias("status"), F.size("f.meta").alias("n_fields"), "f.body")


def rtf_to_text(spark: SparkSession, folder: str) -> DataFrame:
    """Rich text of articles as plain text."""
    a = _articles(spark, folder, "status")
    return a.select("id", strip_rtf(F.concat(F.lit(r"{\rtf1\ansi{\fonttbl}\b "), "id", F.lit(r"\b0\par status "), "status", F.lit("}"))).alias("text"))


def csv_tables(spark: SparkSession, folder: str) -> DataFrame:
    """CSV of articles' figures as Markdown tables."""
    a = _articles(spark, folder, "status", "publication_year")
    return a.select("id", catalog.csv_to_markdown(F.concat(F.lit('id,"status",year\n\n'), "id", F.lit(","), "status", F.lit(","), F.coalesce(F.col("publication_year").cast("string"), F.lit("")))).alias("table"))


def note_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Notes in HTML as text, one of each article."""
    a = _articles(spark, folder, "status")
    return a.select("id", strip_html(F.concat(F.lit("<div>"), "id", F.lit("<br/><i>"), "status", F.lit("</i> &amp; more</div>"))).alias("text"))


def project_written(spark: SparkSession, folder: str) -> DataFrame:
    """All tables of the library exported as a project and read again, counted."""
    names = {"articles": ("id", "title", "publication_year"), "reference_papers": ("id", "title", "match_status"), "article_links": ("parent", "paper", "type"), "audit_entries": ("id", "action", "article_id")}
    path = _scratch(spark, "project")
    tables = {name: table(spark, folder, name).select(*columns).distinct() for name, columns in names.items()}
    exchange.write_project(tables, path)
    schemas = {name: ", ".join(f"{catalog.to_camel(rows).columns[i]} {kind}" for i, (_, kind) in enumerate(rows.dtypes)) for name, rows in tables.items()}
    out = None
    for name, rows in exchange.read_project(spark, path, schemas).items():
        n = rows.agg(F.count("*").alias("n"), F.count_distinct(rows.columns[0]).alias("n_keys")).select(F.lit(name).alias("part"), "n", "n_keys")
        out = n if out is None else out.unionByName(n)
    return out


def project_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Papers of another project put into the library: those that it has by DOI keep its id, and their links move to it."""
    p = table(spark, folder, "reference_papers").select("id", "doi").distinct()
    other = p.select(F.concat(F.lit("x-"), "id").alias("id"), "doi")
    links = table(spark, folder, "article_links").select("parent", F.concat(F.lit("x-"), "paper").alias("paper"), "type").where("parent is not null and paper is not null").distinct()
    new, moved = exchange.merge_import(p, other, normalize_doi("doi"), links, "paper")
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return n(new, "new papers").unionByName(n(moved, "links")).unionByName(n(moved.where("paper like 'x-%'"), "links to new papers"))


def legacy_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """Papers of an old file once each, and their links."""
    p = table(spark, folder, "reference_papers").select("id", "doi", "title").distinct()
    kept, links = exchange.collapse_legacy(p, table(spark, folder, "article_links").select("parent", "paper", "type").where("parent is not null and paper is not null"))
    return kept.agg(F.count("*").alias("n")).select(F.lit("papers").alias("part"), "n").unionByName(links.agg(F.count("*").alias("n")).select(F.lit("links").alias("part"), "n"))


def catalogue_search(spark: SparkSession, folder: str) -> DataFrame:
    """What a filtered catalogue search means on the papers of the library, and the filter itself."""
    p = table(spark, folder, "raw_references").select("link_id", "abstract_text", "publication_year", "reference_type", "language").distinct()
    asked = {"year_from": 2005, "year_to": 2015, "types": ("citation", "reference"), "language": "en"}
    return p.where(exchange.catalogue_predicate(**asked)).select("link_id", F.lit(exchange.catalogue_filter(**asked)).alias("filter"))


def export_selection(spark: SparkSession, folder: str) -> DataFrame:
    """What an export of all, of one status and of given ids takes."""
    a = table(spark, folder, "articles").select("id", "status", "import_source").distinct()
    ids = article_tags(spark, folder).where("tag = 'adult'").select(F.col("article_id").alias("id"))
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("selection"), "n")
    return n(exchange.selection(a), "all").unionByName(n(exchange.selection(a, "included"), "included")).unionByName(n(exchange.selection(a, ids=ids), "tagged"))


def article_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Articles as Markdown pages: of their summary in JSON, in plain text, or of their abstract."""
    a = _articles(spark, folder, "title", "abstract_text", "sequence_id")
    n = F.col("sequence_id") % 3
    summary = F.when(n == 0, F.to_json(F.struct(F.lit("To see").alias("aim"), F.lit("It works").alias("finding")))).when(n == 1, F.lit("A plain summary."))
    return a.select("id", exchange.article_page(summary, F.col("title"), F.col("abstract_text")).alias("page"))


def vault_written(spark: SparkSession, folder: str) -> DataFrame:
    """Wiki pages, but those of one slug, as a vault's: links by slug rewritten to the pages' names."""
    p = wiki_pages(spark, folder).groupBy("slug").agg(F.max("body").alias("body"), F.max("title").alias("title"), F.count("*").alias("n")).where("slug <> ''")
    out = exchange.vault_pages(p.where("n = 1").select("slug", "body"), p.where("title is not null").select("slug", F.concat(F.lit("P "), "slug").alias("name")), "body")
    return out.select("slug", F.size(F.regexp_extract_all("body", F.lit(r"\[\[(P [^\]]+)\]\]"))).alias("n_named"), F.size(F.regexp_extract_all("body", F.lit(r"\[\[([^\]|]+)\|"))).alias("n_left"))


def network_written(spark: SparkSession, folder: str) -> DataFrame:
    """A network's nodes and edges written as CSV and JSON and read again, counted."""
    e = citation_edges(spark, folder)
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    out = None
    for kind in ("csv", "json"):
        path = _scratch(spark, "network")
        exchange.write_network(nodes, e, path, kind)
        for part, schema in (("nodes", "id string"), ("edges", "src string, dst string")):
            reader = spark.read.schema(schema).option("header", True)
            n = (reader.csv if kind == "csv" else reader.json)(f"{path}/{part}").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(part).alias("part"), "n")
            out = n if out is None else out.unionByName(n)
    return out


def networks_saved(spark: SparkSession, folder: str) -> DataFrame:
    """Networks kept under their labels, one of them replaced, and listed with their edges."""
    path = _scratch(spark, "saved")
    exchange.save_network(citation_edges(spark, folder).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("weight")).limit(1), "citation", path)
    exchange.save_network(citation_edges(spark, folder).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("weight")), "citation", path)
    exchange.save_network(coauthor_edges(spark, folder).select("a", "b", F.col("weight").cast("double").alias("weight")), "coauthor", path)
    return spark.read.schema("a string, b string, weight double, network string").parquet(path).groupBy("network").agg(F.count("*").alias("n_edges"), F.sum("weight").alias("weight"))


def flow_report(spark: SparkSession, folder: str) -> DataFrame:
    """The review's flow as a Markdown table."""
    return exchange.flow_report(prisma_counts(spark, folder).select("identified", "duplicates", "screened", "included"))


def screening_text(spark: SparkSession, folder: str) -> DataFrame:
    """A sentence on how many articles have which decision, and how many criteria they met and failed."""
    a = table(spark, folder, "articles").select("id", "status").distinct().join(assessments(spark, folder), "id", "left")
    size: Column = F.coalesce(F.size(F.from_json("matched_inclusion", "array<string>")), F.lit(0))
    n = a.groupBy("status").agg(F.count("*").alias("n"), F.sum(size).alias("met"))
    return n.select("status", F.format_string("%d articles are %s; they met %d criteria.", "n", "status", "met").alias("sentence"))


def slugs_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _articles(spark, folder, "title").select("id", slug("title").alias("slug")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        works_read, works_as_papers, items_read, items_written, notes_merged, cited_references, reference_types, citation_notes, journals_loaded, page_frontmatter, rtf_to_text, csv_tables, note_texts, project_written,
        project_merged, legacy_collapsed, catalogue_search, export_selection, article_pages, vault_written, network_written, networks_saved, flow_report, screening_text, slugs_of_pages,
    )
}

from citeloom.plans.bibliometrics import A  # noqa: E402
from citeloom.plans.library import AS, J, T  # noqa: E402
from citeloom.plans.library import SQL as LIBRARY  # noqa: E402
from citeloom.plans.matching import BARE, DOI, TITLE  # noqa: E402
from citeloom.plans.networks import SQL as NETWORKS  # noqa: E402
from citeloom.plans.pages import SLUG, WIKI  # noqa: E402

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
NL = "chr(10)"
CODES = ", ".join(f"('{n.replace(chr(39), chr(39) * 2)}', '{code}')" for code, names in ris.TYPES.items() for n in names.split("|"))
SQL: dict[str, str] = {
    "works_read": rf"select distinct id, title, {DOI} as doi, len(authors) as n_authors, length(nullif(trim(regexp_replace(abstract_text, '\s+', ' ', 'g')), '')) as abstract_chars, journal, num_cited from (select *, {BARE} as d from (select distinct id, title, abstract_text, authors, publication_year, doi, language, num_cited, journal from articles))",
    "works_as_papers": f"select id, {DOI} as doi, publication_year, citation_count, 2 as num_references from (select *, {BARE} as d from (select distinct id, title, doi, publication_year, citation_count from reference_papers))",
    "items_read": f"select id, title, publication_year, {DOI} as doi, journal, len(authors) as n_authors from (select *, {BARE} as d from (select distinct id, title, abstract_text, authors, publication_year, doi, journal, language from articles))",
    "items_written": "select id, 'journalArticle' as kind, title, publication_year::varchar as date, doi, case when len(authors) > 0 then trim(split_part(authors[1], ',', 1)) end as last_name, case when len(authors) > 0 then trim(regexp_extract(authors[1], '^[^,]*,(.*)$', 1)) end as first_name from (select distinct id, title, abstract_text, authors, publication_year, doi, journal, language from articles)",
    "notes_merged": "select article_id as parent, array_to_string(list('note ' || doc_id order by coalesce(added_at, timestamp '0001-01-01'), doc_id), chr(10) || chr(10)) as notes from documents where article_id is not null and trim(lower(source)) = 'screening_note' and text is not null group by 1",
    "cited_references": r"select distinct link_id, trim(replace(authors[1], ',', '')) as author, publication_year as year, 'J CLIN RES' as source, '12' as volume, '34' as page from (select distinct link_id, authors, publication_year, doi from raw_references where title is not null and authors[1] is not null) where (doi is null or not regexp_matches(doi, '[\s,\]]')) and trim(authors[1]) <> ''",
    "reference_types": f"select * from (values {CODES}) t(name, code)",
    "citation_notes": "select distinct id, num_cited, 17 as num_references from (select distinct id, title, num_cited from articles where title is not null and num_cited >= 0)",
    "journals_loaded": f"with {J} select title as journal_title, issn, eissn, 'a publisher' as publisher_name from j",
    "page_frontmatter": "select id, 'Page of ' || id as title, status, 4 as n_fields, 'Body ' || coalesce(publication_year::varchar, 'none') as body from (select distinct id, status, publication_year from articles)",
    "rtf_to_text": f"select id, id || {NL} || 'status ' || status as text from (select distinct id, status from articles)",
    "csv_tables": f"select id, '| id | status | year |' || {NL} || '| --- | --- | --- |' || {NL} || '| ' || id || ' | ' || status || ' | ' || coalesce(publication_year::varchar, '') || ' |' as table from (select distinct id, status, publication_year from articles)",
    "note_texts": f"select id, id || {NL} || status || ' & more' as text from (select distinct id, status from articles)",
    "project_written": "select 'articles' as part, count(*) as n, count(distinct id) as n_keys from (select distinct id, title, publication_year from articles) union all select 'reference_papers', count(*), count(distinct id) from (select distinct id, title, match_status from reference_papers) union all select 'article_links', count(*), count(distinct parent) from (select distinct parent, paper, type from article_links) union all select 'audit_entries', count(*), count(distinct id) from (select distinct id, action, article_id from audit_entries)",
    "project_merged": f"with p as (select id, {DOI} as d from (select distinct id, {BARE} as d from reference_papers)), h as (select d, min(id) as h from p where d is not null group by 1), m as (select distinct parent, coalesce(h, 'x-' || paper) as paper, type from article_links l left join p on p.id = l.paper left join h on h.d = p.d where parent is not null and paper is not null) select 'new papers' as part, count(*) as n from p where d is null union all select 'links', count(*) from m union all select 'links to new papers', count(*) from m where paper like 'x-%'",
    "legacy_collapsed": f"with p as (select distinct id, {DOI} as d, {TITLE} as t from (select id, {BARE} as d, title from reference_papers)), k as (select id, min(id) over (partition by coalesce('d:' || d, 't:' || nullif(t, ''), 'i:' || id)) as h from p), l as (select distinct parent, coalesce(h, paper), type from article_links left join k on k.id = paper where parent is not null and paper is not null) select 'papers' as part, count(distinct h) as n from k union all select 'links', count(*) from l",
    "catalogue_search": "select distinct link_id, 'has_abstract:true,is_retracted:false,publication_year:2005-2015,type:citation|reference,language:en' as filter from (select distinct link_id, abstract_text, publication_year, reference_type, language from raw_references) where trim(abstract_text) <> '' and publication_year between 2005 and 2015 and reference_type in ('citation', 'reference') and language = 'en'",
    "export_selection": f"with {A}, {T} select 'all' as selection, count(*) as n from a union all select 'included', count(*) from a where status = 'included' union all select 'tagged', count(*) from a where id in (select article_id from t where tag = 'adult')",
    "article_pages": f"select distinct id, '# ' || coalesce(title, '') || {NL} || {NL} || case sequence_id % 3 when 0 then '## aim' || {NL} || {NL} || 'To see' || {NL} || {NL} || '## finding' || {NL} || {NL} || 'It works' when 1 then 'A plain summary.' else coalesce(abstract_text, '') end as page from articles",
    "vault_written": f"with {WIKI}, s as (select slug, max(title) as title from w where slug <> '' group by 1), b as (select w.slug, count(distinct target) filter (target in (select slug from s where title is not null)) as n_named, count(distinct target) filter (target not in (select slug from s where title is not null)) as n_left from s w left join pl using (slug) group by 1) select slug, n_named, n_left from b where slug in (select slug from w group by slug having count(*) = 1)",
    "network_written": f"with e as ({NETWORKS['citation_edges']}), n as (select src as id from e union select dst from e), k as (select 'nodes' as part, count(*) as n from n union all select 'edges', count(*) from e) select kind, part, n from (values ('csv'), ('json')) t(kind), k",
    "networks_saved": f"with c as ({NETWORKS['citation_edges']}), u as ({NETWORKS['coauthor_edges']}) select 'citation' as network, count(*) as n_edges, count(*)::double as weight from c union all select 'coauthor', count(*), sum(weight)::double from u",
    "flow_report": f"with p as ({LIBRARY['prisma_counts']}) select '| step | records |' || {NL} || '|---|---|' || {NL} || '| identified | ' || identified || ' |' || {NL} || '| duplicates | ' || duplicates || ' |' || {NL} || '| screened | ' || screened || ' |' || {NL} || '| included | ' || included || ' |' as report from p",
    "screening_text": f"with {AS}, a as (select distinct id, status from articles), n as (select status, count(*) as n, coalesce(sum(len(i)), 0) as met from a left join s using (id) group by 1) select status, n || ' articles are ' || status || '; they met ' || met || ' criteria.' as sentence from n",
    "slugs_of_pages": f"select distinct id, {SLUG.format('title')} as slug from articles",
}

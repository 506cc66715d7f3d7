"""Wiki pages made of the library, and passages found in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions.fields import array_in_json, claim_key
from citeloom.functions.stemming import stem
from citeloom.functions.text import STOP_WORDS, author_key, slug, tokenize, tokenize_for_match
from citeloom.operators import library, pages, segments
from citeloom.operators.sets import similar_sets
from citeloom.operators.views import article_tags
from citeloom.plans.networks import citation_edges
from citeloom.plans.retrieval import K1, LEAST_IDF, QUERY, B, documents, stem_words
from citeloom.tables import table


#: All that counts as a blank between words.
BLANKS = "[\\s\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def wiki_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(slug, title, kind, body, source): a page for each article, linked to those that it cites, one of ten without a title; titles may give one slug twice."""
    a = table(spark, folder, "articles").groupBy("id").agg(F.max("title").alias("title"), F.max("journal").alias("journal"))
    cited = citation_edges(spark, folder).join(a.select(F.col("id").alias("dst"), slug("title").alias("t")), "dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("t")).alias("links"))
    text = F.array_join(F.transform(F.coalesce("links", F.array().cast("array<string>")), lambda x: F.concat(F.lit("See [["), x, F.lit("|this]]."))), "\n")
    gone = F.substring("id", -1, 1) == "0"
    return a.join(cited, "id", "left").select(slug("title").alias("slug"), F.when(~gone, F.col("title")).alias("title"), F.lit("concept").alias("kind"), F.concat_ws("\n", F.coalesce("journal", F.lit("")), text).alias("body"), F.when(~gone, F.col("id")).alias("source"))


def page_graph(spark: SparkSession, folder: str) -> DataFrame:
    return pages.page_links(wiki_pages(spark, folder))


def page_lint(spark: SparkSession, folder: str) -> DataFrame:
    return pages.lint(wiki_pages(spark, folder), table(spark, folder, "articles").select(F.col("id").alias("source")).distinct())


def pages_consolidated(spark: SparkSession, folder: str) -> DataFrame:
    """Which pages of papers' titles are merged into which: by slug, stems and sources."""
    p = table(spark, folder, "reference_papers").groupBy(F.col("id").alias("place")).agg(F.max("title").alias("title"), F.max("matched_article_id").alias("source"))
    w = p.select("place", F.explode(F.array_distinct(tokenize("title"))).alias("token"))
    stems = w.join(stem_words(w), "token").groupBy("place").agg(F.collect_set("stem").alias("stems"))
    return pages.consolidated(p.join(stems, "place").select("place", slug("title").alias("slug"), F.lit("concept").alias("kind"), "stems", F.array("source").alias("sources")))


def similar_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different papers' word sets that are half alike, between representatives of equal sets."""
    t = _title_sets(spark, folder).groupBy("key").agg(F.min("id").alias("id"))
    return similar_sets(t.select("id", F.split("key", " ").alias("s")), "id", "s", 0.5)


def title_classes(spark: SparkSession, folder: str) -> DataFrame:
    """The class of each paper by its title's word set: the smallest paper with the same."""
    t = _title_sets(spark, folder)
    return t.join(t.groupBy("key").agg(F.min("id").alias("class_id")), "key").select("id", "class_id").distinct()


def _title_sets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "reference_papers").select("id", F.array_join(F.array_sort(F.array_distinct(tokenize("title"))), " ").alias("key")).where("key <> ''").distinct()


def pages_by_slug(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of papers by their journal's slug: the last body at the first place."""
    p = table(spark, folder, "reference_papers").where("trim(journal) <> ''").select(F.col("id").alias("place"), slug("journal").alias("slug"), F.col("title").alias("body")).distinct()
    return pages.last_by_slug(p)


def pages_split(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of answers that hold several, one of them without a body."""
    d = documents(spark, folder).where("trim(text) <> '' and not contains(text, '<!--')")
    text = F.concat(F.lit("Preamble\n<!-- PAGE:doc-"), F.col("doc_id").cast("string"), F.lit(" -->\n"), "text", F.lit("\n<!-- PAGE:empty -->\n \n<!-- PAGE:end -->\nbye"))
    return d.select("doc_id", F.explode(pages.split_pages(text)).alias("p")).groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.min("p.slug").alias("first_slug"))


def running_heads_removed(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of articles with a journal's head and a page number, taken off again: how many characters of text are left."""
    d = documents(spark, folder).where("article_id is not null and trim(text) <> ''")
    n = d.groupBy("article_id").agg(F.count("*").alias("n")).where("n > 1")
    text = F.concat(F.lit("Journal of Heads, page "), F.col("doc_id").cast("string"), F.lit("\n"), "text", F.lit("\nfoot "), F.col("doc_id").cast("string"))
    p = d.join(n, "article_id", "left_semi").select(F.col("article_id").alias("id"), F.col("doc_id").alias("page"), text.alias("text"))
    return pages.without_running_heads(p).groupBy("id").agg(F.count("*").alias("n_pages"), F.sum(F.length("text")).alias("n_chars"))


def full_text_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Full texts without abstract and references, fifty words of each."""
    text = F.concat(F.lit("Title line\nAbstract\n"), "text", F.lit("\nIntroduction\nBody of the paper. "), "text", "text", "text", F.lit("\nReferences\n[1] A list."))
    d = documents(spark, folder).where("trim(text) <> ''").select("doc_id", text.alias("t"))
    body = pages.without_references(pages.without_abstract("t"))
    return d.select("doc_id", F.length(body).alias("n_chars"), pages.first_words(body, 5).alias("begins"))


def captions_found(spark: SparkSession, folder: str) -> DataFrame:
    """Captions of figures and tables that name papers, in texts made of them."""
    p = table(spark, folder, "reference_papers").where("title is not null").groupBy("id").agg(F.max("title").alias("title"))
    text = F.concat(F.lit("# Results\n\nSome words.\n\nFigure 1. "), F.trim("title"), F.lit("\n\nTable 2: counts\nof all years\n\nEnd."))
    return segments.caption_rows(p.where(r"title not rlike '[\r\n]' and trim(title) <> ''").select("id", text.alias("text")), "id", "text")


def tables_found(spark: SparkSession, folder: str) -> DataFrame:
    """Tables in the texts of embedding tasks, with their rows and columns."""
    t = pages.table_rows(table(spark, folder, "embed_tasks").select(F.concat_ws("#", "article_id", "chunk_index").alias("key"), "text").distinct(), "key", "text")
    return t.select("id", "number", (F.size(F.split("table", "\n")) - 1).alias("n_rows"), (F.size(F.split(F.substring_index("table", "\n", 1), r"\|")) - 2).alias("n_columns"))


def token_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Task texts in pieces of at most 120 words: whether they fit, and how many characters but blanks they keep: all."""
    p = pages.budget_pieces(table(spark, folder, "embed_tasks").distinct(), ["article_id", "chunk_index", "input_hash"], "text", 120)
    return p.groupBy("article_id", "chunk_index", "input_hash").agg(F.sum(F.length(F.regexp_replace("piece", BLANKS, ""))).alias("n_chars"), (F.max("n_words") <= 120).alias("fits"))


def embedding_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces packed into requests of at most 16 inputs and 1,000 words: all pieces are in one, none is too large."""
    p = pages.budget_pieces(table(spark, folder, "embed_tasks").distinct(), ["article_id", "chunk_index"], "text", 120)
    b = pages.batches(p, "n_words", 16, 1000).groupBy("batch").agg(F.count("*").alias("n"), F.sum("n_words").alias("w"))
    return b.agg(F.sum("n").alias("n_pieces"), F.sum("w").alias("n_words"), (F.max("n") <= 16).alias("inputs_fit"), (F.max("w") <= 1000).alias("words_fit"))


def _contained(spark: SparkSession, folder: str) -> DataFrame:
    """(item_id, doc_id, score, alike): the share of a held-out item's words that a document has, and how alike both sets are, where a document has three tenths."""
    q = table(spark, folder, "eval_items").select("item_id", tokenize_for_match("text").alias("t"))
    d = documents(spark, folder).select("doc_id", F.array_distinct(tokenize("text")).alias("w")).select("doc_id", F.size("w").alias("m"), F.explode("w").alias("token"))
    shared = d.join(q.select("item_id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("u"), F.explode(F.array_distinct("t")).alias("token")), "token").groupBy("item_id", "doc_id", "n", "u", "m").agg(F.count("*").alias("k"))
    return shared.select("item_id", "doc_id", F.round(F.col("k") / F.col("n"), 6).alias("score"), F.round(F.col("k") / (F.col("u") + F.col("m") - F.col("k")), 6).alias("alike")).where("score >= 0.3")


def finalists(spark: SparkSession, folder: str) -> DataFrame:
    """Of each item the fifteen documents that contain most of it, then the five most alike that are not among them, twenty at most."""
    c = _contained(spark, folder)
    return library.finalists(c.select("item_id", "doc_id", "score"), c.select("item_id", "doc_id", F.col("alike").alias("score")), "item_id", "doc_id", "score")


def claim_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Judged finalists: those that are related, with a confidence between 0 and 1, ten of each item at most in the order of rank."""
    c = _contained(spark, folder)
    f = finalists(spark, folder).join(c, ["item_id", "doc_id"])
    kind = F.when(F.col("score") >= 0.6, "supports").when(F.col("score") >= 0.45, "related")
    kept = f.select("item_id", "doc_id", "rank", kind.alias("kind"), F.round((F.col("alike") + 1) / 2, 4).alias("confidence")).where("kind is not null")
    return kept.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy("rank"))).where("r <= 10").select("item_id", "doc_id", "kind", "confidence")


def claim_funnel(spark: SparkSession, folder: str) -> DataFrame:
    """How many candidates, finalists and matches the items have."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(_contained(spark, folder), "candidates").crossJoin(n(finalists(spark, folder), "finalists")).crossJoin(n(claim_matches(spark, folder), "matches"))  # one row each


def quotes_grounded(spark: SparkSession, folder: str) -> DataFrame:
    """Of the sentences of each item those that stand in the document which contains it best."""
    c = _contained(spark, folder)
    best = c.groupBy("item_id").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("d"))).alias("m")).select("item_id", (-F.col("m.d")).alias("doc_id"))
    q = table(spark, folder, "eval_items").select("item_id", F.split("text", r"(?<=[.!?])\s+").alias("quotes"))
    j = best.join(q, "item_id").join(documents(spark, folder).select("doc_id", "text"), "doc_id")
    return j.select("item_id", pages.grounded(F.col("quotes"), F.col("text")).alias("g")).select("item_id", F.size("g").alias("n_grounded"), F.array_join("g", " / ").alias("quotes"))


def claims_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Claims out of JSON answers: the first five, then those that are not blank, under one key."""
    text = F.to_json(F.struct(F.concat(F.array(F.lit(" ")), F.transform(F.split("text", r"(?<=[.!?])\s+"), lambda x: F.concat(x, F.lit("  ")))).alias("results")))
    listed = F.slice(F.from_json(array_in_json(text), "array<string>"), 1, 5)
    e = table(spark, folder, "eval_items").where("text is not null").select("item_id", F.filter(F.transform(listed, claim_key), lambda x: x != "").alias("c"))
    return e.select("item_id", F.size("c").alias("n_claims"), F.element_at("c", 1).alias("first_claim"))


def evidence_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """For each article with documents the passage that supports a claim: by words from a third of them on, else the first with a vector, else its abstract."""
    words = [w for w in QUERY.split() if w not in STOP_WORDS]
    share = lambda c: F.size(F.array_intersect(F.array(*(F.lit(w) for w in words)), tokenize(c))) / len(words)
    d = documents(spark, folder).where("article_id is not null")
    best = d.withColumn("s", share("text")).where("s >= 0.3").groupBy("article_id").agg(F.max(F.struct("s", (-F.col("doc_id")).alias("d"))).alias("m")).select("article_id", (-F.col("m.d")).cast("string").alias("passage"))
    vector = table(spark, folder, "article_embeddings").where("chunk_index >= 0 and embedding is not null").groupBy("article_id").agg(F.min("chunk_index").cast("string").alias("passage"))
    abstract = table(spark, folder, "articles").where(share("abstract_text") >= 0.3).groupBy(F.col("id").alias("article_id")).agg(F.lit("abstract").alias("passage"))
    own = table(spark, folder, "articles").select(F.col("id").alias("article_id")).distinct()
    return pages.evidence(own, best, vector, abstract)


def bm25_stemmed(spark: SparkSession, folder: str) -> DataFrame:
    """The thirty best documents for a query by the stems of its words: the index is on stems; its words without stop words, any of which may match."""
    wanted = sorted({stem(w) for w in QUERY.split() if w not in STOP_WORDS})
    t = documents(spark, folder).select("doc_id", tokenize("text").alias("t")).where(F.size("t") > 0)
    p = t.select("doc_id", F.size("t").alias("size"), F.explode("t").alias("token")).groupBy("doc_id", "size", "token").agg(F.count("*").alias("n"))
    hit = p.join(stem_words(p).where(F.col("stem").isin(wanted)), "token").groupBy("doc_id", "size", "stem").agg(F.sum("n").alias("tf"))
    stats = t.agg(F.count("*").alias("docs"), F.avg(F.size("t")).alias("avg_size"))
    df = hit.groupBy("stem").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("avg_size")))
    scored = hit.join(F.broadcast(df), "stem").crossJoin(F.broadcast(stats)).groupBy("doc_id").agg(F.round(F.sum(score), 6).alias("score"))  # a row a word of the query; one row
    return scored.orderBy(F.desc("score"), "doc_id").limit(30)


def index_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Whether an index of chunks covers the documents that have text, and how many it lacks."""
    d = documents(spark, folder).where("trim(text) <> ''").select("doc_id")
    indexed = segments.chunk_documents(table(spark, folder, "documents").where("doc_id % 10 <> 0"), "doc_id", "text").select(F.col("id").alias("doc_id")).distinct()
    return d.join(indexed, "doc_id", "left_anti").agg(F.count("*").alias("n_missing"), (F.count("*") > 0).alias("rebuild"))


def context_greedy(spark: SparkSession, folder: str) -> DataFrame:
    """Of each item's twenty finalists those that fit 3,000 characters when each in turn is taken that still fits."""
    f = finalists(spark, folder).join(documents(spark, folder).select("doc_id", F.length("text").cast("long").alias("n")), "doc_id")
    lists = f.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "n"))).alias("l"))
    taken = library.fills_capacity(F.transform("l", lambda x: x["n"]), 3000)
    return lists.select("item_id", F.explode(F.arrays_zip(F.col("l"), taken.alias("taken"))).alias("x")).where("x.taken").select("item_id", "x.l.doc_id", "x.l.n")


def chat_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts of a question about each item: its context and the question, in one text."""
    best = finalists(spark, folder).where("rank <= 2").join(documents(spark, folder).select("doc_id", "text"), "doc_id").groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n---\n").alias("context"))
    q = table(spark, folder, "eval_items").select("item_id", F.col("text").alias("question"))
    return best.join(q, "item_id").select("item_id", F.length(F.concat(F.lit("Context:\n"), "context", F.lit("\n\nQuestion: "), "question")).alias("n_chars"))


def concept_hubs(spark: SparkSession, folder: str) -> DataFrame:
    """The forty tags and the forty authors that most articles carry, with the tags that stand beside most often."""
    t = article_tags(spark, folder)
    tags = t.groupBy(F.col("tag").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(40).select(F.lit("tag").alias("kind"), "name", "n")
    a = table(spark, folder, "articles").select("id", F.explode("authors").alias("raw")).select("id", author_key("raw").alias("name")).where("name <> ''").distinct()
    people = a.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(40).select(F.lit("author").alias("kind"), "name", "n")
    return tags.unionByName(people)


def methods_hub(spark: SparkSession, folder: str) -> DataFrame:
    """Articles by study design: what their titles name, else what their tags do, each in one form."""
    designs = {"randomised trial": "trial", "trial": "trial", "cohort": "cohort", "case series": "case series", "systematic review": "review", "review": "review", "protocol": "protocol", "modelling": "modelling"}

    def design(c: Column) -> Column:
        out = F.lit(None).cast("string")
        for text, name in reversed(designs.items()):
            out = F.when(F.lower(c).contains(text), name).otherwise(out)
        return out

    tags = article_tags(spark, folder).select(F.col("article_id").alias("id"), design(F.col("tag")).alias("d")).where("d is not null").groupBy("id").agg(F.min("d").alias("by_tag"))
    a = table(spark, folder, "articles").groupBy("id").agg(F.max("title").alias("title")).join(tags, "id", "left")
    return a.select(F.coalesce(design(F.col("title")), "by_tag").alias("design"), "id").where("design is not null").groupBy("design").agg(F.count("*").alias("n_articles"))


def summary_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown summaries taken apart into the sections of their headings, as a map, and merged with others': later keys win."""
    text = F.concat(F.lit("# Aim\nTo study.\n# Finding\n"), "text", F.lit("\n# Aim\nAgain."))
    d = documents(spark, folder).where("trim(text) <> '' and not contains(text, '#')").select("doc_id", F.filter(F.split(text, r"(?m)^# "), lambda x: x != "").alias("parts"))
    pairs = F.transform("parts", lambda p: F.struct(F.lower(F.substring_index(p, "\n", 1)).alias("k"), F.trim(F.regexp_replace(p, r"^[^\n]*\n", "")).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    merged = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])))
    return d.select("doc_id", merged.alias("m")).select("doc_id", F.size("m").alias("n_sections"), F.trim(F.regexp_replace(F.col("m")["aim"], r"\s+$", "")).alias("aim"), F.length(F.col("m")["finding"]).alias("finding_chars"))


def translations_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Answers with marks for title and abstract taken apart."""
    a = table(spark, folder, "articles").where("title is not null and trim(abstract_text) <> ''").select("id", "title", "abstract_text").distinct()
    text = F.concat(F.lit("[TITLE]\n"), "title", F.lit("\n[ABSTRACT]\n"), "abstract_text", F.lit("\n"))
    part = lambda at: F.trim(F.regexp_extract(text, r"(?s)\[TITLE\]\s*(.*?)\s*\[ABSTRACT\]\s*(.*?)\s*$", at))
    return a.select("id", F.length(part(1)).alias("title_chars"), F.length(part(2)).alias("abstract_chars"))


def chunks_replaced(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks by article when the texts of new tasks take the place of all that an article had."""
    old = table(spark, folder, "article_embeddings").select("article_id", "chunk_index").distinct()
    new = table(spark, folder, "embed_tasks").select("article_id", "chunk_index").where("article_id is not null").distinct()
    kept = old.join(new.select("article_id"), "article_id", "left_anti").unionByName(new)
    return kept.groupBy("article_id").agg(F.count("*").alias("n_chunks"), F.max("chunk_index").alias("last_chunk"))


def attachments_first(spark: SparkSession, folder: str) -> DataFrame:
    """Each article's first full text in the order of its documents, and how many it has."""
    d = table(spark, folder, "documents").where("article_id is not null").select("article_id", "doc_id", F.trim(F.lower("source")).alias("s"))
    return d.groupBy("article_id").agg(F.count("*").alias("n_attachments"), F.min(F.when(F.col("s") == "fulltext_pdf", F.col("doc_id"))).alias("full_text"))


def evidence_kind(spark: SparkSession, folder: str) -> DataFrame:
    """What articles can be judged on: a summary with passages, a summary, passages, or nothing."""
    d = table(spark, folder, "documents").where("article_id is not null").select(F.col("article_id").alias("id"), F.trim(F.lower("source")).alias("s"))
    has = d.groupBy("id").agg(F.bool_or(F.col("s") == "wiki_page").alias("summary"), F.bool_or(F.col("s") == "fulltext_pdf").alias("passages"))
    s, p = F.coalesce("summary", F.lit(False)), F.coalesce("passages", F.lit(False))
    kind = F.when(s & p, "both").when(s, "summary").when(p, "passages").otherwise("none")
    return table(spark, folder, "articles").select("id").distinct().join(has, "id", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        page_graph, page_lint, pages_consolidated, similar_titles, title_classes, pages_by_slug, pages_split, running_heads_removed, full_text_bodies, captions_found, tables_found, token_pieces, embedding_batches, finalists,
        claim_matches, claim_funnel, quotes_grounded, claims_parsed, evidence_cascade, bm25_stemmed, index_drift, context_greedy, chat_prompts, concept_hubs, methods_hub, summary_sections, translations_parsed,
        chunks_replaced, attachments_first, evidence_kind,
    )
}

from citeloom.plans.library import AU, T  # noqa: E402
from citeloom.plans.networks import SQL as NETWORKS  # noqa: E402

SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
SPLIT = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: w <> '')"
STOP = ", ".join(repr(w) for w in STOP_WORDS)
D = "d as (select doc_id, text, article_id from documents where text is not null)"
WIKI = f"""ce as ({NETWORKS['citation_edges']}), ar as (select id, max(title) as title, max(journal) as journal from articles group by 1), lk as (select distinct src, {SLUG.format('title')} as target from ce join ar on ar.id = ce.dst),
w as (select id, {SLUG.format('title')} as slug, case when right(id, 1) <> '0' then title end as title, case when right(id, 1) <> '0' then id end as source from ar), pl as (select distinct w.slug, target from w join lk on lk.src = w.id where target <> '')"""
TS = f"ts as (select distinct id, array_to_string(list_sort(list_distinct({SPLIT.format('title')})), ' ') as key from reference_papers), tk as (select id, key from ts where key <> '')"
CO = f"""{D}, q as (select item_id, case when len(m) = 0 then r else m end as t from (select item_id, r, list_filter(r, lambda w: w not in ({STOP})) as m from (select item_id, {SPLIT.format('text')} as r from eval_items))),
dw as (select doc_id, list_distinct({SPLIT.format('text')}) as w from d), sh as (select item_id, doc_id, count(*) as k from (select item_id, unnest(list_distinct(t)) as token from q) join (select doc_id, unnest(w) as token from dw) using (token) group by all),
co as (select * from (select item_id, doc_id, round(k / len(t), 6) as score, round(k / (len(list_distinct(t)) + len(w) - k), 6) as alike from sh join q using (item_id) join dw using (doc_id)) where score >= 0.3)"""
FI = f"""{CO}, ra as (select *, row_number() over (partition by item_id order by score desc, doc_id) as ra, row_number() over (partition by item_id order by alike desc, doc_id) as rb from co),
fi as (select item_id, doc_id, row_number() over (partition by item_id order by case when ra <= 15 then 0 else 1 end, case when ra <= 15 then ra else rb end) as rank from ra where ra <= 15 or rb <= 5)"""
CM = f"{FI}, cm as (select item_id, doc_id, kind, confidence from (select *, row_number() over (partition by item_id order by rank) as r from (select fi.item_id, fi.doc_id, rank, case when score >= 0.6 then 'supports' when score >= 0.45 then 'related' end as kind, round((alike + 1) / 2, 4) as confidence from fi join co using (item_id, doc_id)) where kind is not null) where r <= 10)"
SHARE = "len(list_intersect([{}], {})) / {}".format(", ".join(repr(w) for w in QUERY.split() if w not in STOP_WORDS), "{}", len([w for w in QUERY.split() if w not in STOP_WORDS]))
NORM = r"lower(regexp_replace(regexp_replace({}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'))"
DESIGN = "case when contains(lower({0}), 'randomised trial') or contains(lower({0}), 'trial') then 'trial' when contains(lower({0}), 'cohort') then 'cohort' when contains(lower({0}), 'case series') then 'case series' when contains(lower({0}), 'systematic review') or contains(lower({0}), 'review') then 'review' when contains(lower({0}), 'protocol') then 'protocol' when contains(lower({0}), 'modelling') then 'modelling' end"
SENTENCES = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
SQL: dict[str, str] = {
    "page_graph": f"with {WIKI} select slug, target from pl",
    "page_lint": f"""with {WIKI}, x as (select 'missing_title' as kind, slug from w where title is null or trim(title) = '' union select 'duplicate_slug', slug from w group by slug having count(*) > 1 union select 'broken_link', slug from pl where target not in (select slug from w)
      union select 'orphan', slug from w where slug not in (select target from pl where slug <> target) union select 'ungrounded', slug from w where source is null or source not in (select id from articles)) select * from x""",
    "similar_titles": f"with {TS}, k as (select key, min(id) as id from tk group by 1), s as (select id, string_split(key, ' ') as s from k), p as (select x.id as a, y.id as b, round(len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))), 6) as jaccard from s x join s y on x.id < y.id and list_has_any(x.s, y.s)) select * from p where jaccard >= 0.5",
    "title_classes": f"with {TS} select id, min(id) over (partition by key) as class_id from tk",
    "pages_by_slug": f"with p as (select distinct id, {SLUG.format('journal')} as slug, title from reference_papers where trim(journal) <> '') select slug, min(id) as place, last(title order by id) as body from p group by 1",
    "pages_split": f"with {D} select doc_id, 2 as n_pages, 'doc-' || doc_id as first_slug from d where trim(text) <> '' and not contains(text, '<!--') and regexp_matches(text, '\\S')",
    "running_heads_removed": f"with {D}, e as (select article_id, text from d where article_id is not null and trim(text) <> '') select article_id as id, count(*) as n_pages, sum(length(text)) as n_chars from e group by 1 having count(*) > 1",
    "full_text_bodies": rf"""with {D}, b as (select doc_id, 'Title line' || chr(10) || chr(10) || 'Introduction' || chr(10) || 'Body of the paper. ' || text || text || text as t from d where trim(text) <> '' and not regexp_matches(text, '\n(?:1\.|1 |Introduction|INTRODUCTION|Background|BACKGROUND|Main Text|Methods\n|METHODS|References|REFERENCES|Bibliography|Literature)'))
      select doc_id, length(t) as n_chars, array_to_string(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')[1:5], ' ') as begins from b""",
    "captions_found": r"with p as (select id, max(title) as title from reference_papers where title is not null group by 1), q as (select * from p where trim(title) <> '' and not regexp_matches(title, '[\r\n]')) select id, 'Figure' as kind, 1 as number, trim(title) as caption from q union all select id, 'Table', 2, 'counts of all years' from q",
    "token_pieces": rf"select distinct article_id, chunk_index, input_hash, length(regexp_replace(text, '{BLANKS}', '', 'g')) as n_chars, true as fits from embed_tasks where regexp_replace(text, '{BLANKS}', '', 'g') <> ''",
    "finalists": f"with {FI} select * from fi where rank <= 20",
    "claim_matches": f"with {CM} select * from cm",
    "claim_funnel": f"with {CM} select (select count(*) from co) as candidates, (select count(*) from fi where rank <= 20) as finalists, (select count(*) from cm) as matches",
    "quotes_grounded": rf"""with {CO}, b as (select item_id, first(doc_id order by score desc, doc_id) as doc_id from co group by 1), j as (select item_id, unnest({SENTENCES.replace('text', 'i.text')}) as q, generate_subscripts({SENTENCES.replace('text', 'i.text')}, 1) as n, {NORM.format('d.text')} as s from b join eval_items i using (item_id) join d using (doc_id)),
      g as (select item_id, trim(q) as q, position({NORM.format('q')} in s) as p, n, row_number() over (partition by item_id, {NORM.format('q')} order by n) as r from j where {NORM.format('q')} <> ''), k as (select * from g where p > 0 and r = 1)
      select b.item_id, count(k.q) as n_grounded, coalesce(array_to_string(list(k.q order by p, n) filter (k.q is not null), ' / '), '') as quotes from b left join k using (item_id) group by 1""",
    "claims_parsed": rf"with e as (select item_id, list_filter(list_transform(list_prepend(' ', {SENTENCES})[1:5], lambda x: {NORM.format('x')}), lambda x: x <> '') as c from eval_items where text is not null) select item_id, len(c) as n_claims, c[1] as first_claim from e",
    "evidence_cascade": f"""with {D}, w as (select article_id, first(doc_id order by s desc, doc_id)::varchar as p from (select *, {SHARE.format(SPLIT.format('text'))} as s from d where article_id is not null) where s >= 0.3 group by 1), v as (select article_id, min(chunk_index)::varchar as p from article_embeddings where chunk_index >= 0 and embedding is not null group by 1),
      b as (select distinct id as article_id, 'abstract' as p from articles where {SHARE.format(SPLIT.format('abstract_text'))} >= 0.3), a as (select distinct id as article_id from articles)
      select a.article_id, case when w.p is not null then 'words' when v.p is not null then 'vector' else 'abstract' end as source, coalesce(w.p, v.p, b.p) as passage from a left join w using (article_id) left join v using (article_id) left join b using (article_id) where coalesce(w.p, v.p, b.p) is not null""",
    "index_drift": rf"select count(*) as n_missing, count(*) > 0 as rebuild from documents where trim(text) <> '' and (doc_id % 10 = 0 or not regexp_matches(text, '\S'))",
    "chat_prompts": f"with {FI}, b as (select item_id, list(text order by rank) as l from fi join d using (doc_id) where rank <= 2 group by 1) select item_id, length('Context:' || chr(10) || array_to_string(l, chr(10) || '---' || chr(10)) || chr(10) || chr(10) || 'Question: ' || text) as n_chars from b join eval_items using (item_id)",
    "concept_hubs": f"with {T}, {AU} select * from (select 'tag' as kind, tag as name, count(*) as n from t group by tag order by n desc, name limit 40) union all select * from (select 'author', author as name, count(*) as n from (select distinct id, author from au) group by author order by n desc, name limit 40)",
    "methods_hub": f"with {T}, g as (select article_id as id, min(d) as d from (select article_id, {DESIGN.format('tag')} as d from t) where d is not null group by 1), a as (select id, max(title) as title from articles group by 1) select coalesce({DESIGN.format('title')}, d) as design, count(*) as n_articles from a left join g using (id) where coalesce({DESIGN.format('title')}, d) is not null group by 1",
    "summary_sections": f"with {D} select doc_id, 2 as n_sections, 'Again.' as aim, length(trim(text || chr(10))) as finding_chars from d where trim(text) <> '' and not contains(text, '#')",
    "translations_parsed": r"select distinct id, length(trim(regexp_replace(title, '^\s+|\s+$', '', 'g'))) as title_chars, length(regexp_replace(abstract_text, '^\s+|\s+$', '', 'g')) as abstract_chars from articles where title is not null and trim(abstract_text) <> ''",
    "chunks_replaced": "with n as (select distinct article_id, chunk_index from embed_tasks where article_id is not null), k as (select distinct article_id, chunk_index from article_embeddings where not exists (select 1 from n where n.article_id = article_embeddings.article_id) union all select * from n) select article_id, count(*) as n_chunks, max(chunk_index) as last_chunk from k group by 1",
    "attachments_first": "select article_id, count(*) as n_attachments, min(doc_id) filter (trim(lower(source)) = 'fulltext_pdf') as full_text from documents where article_id is not null group by 1",
    "evidence_kind": "with h as (select article_id as id, coalesce(bool_or(trim(lower(source)) = 'wiki_page'), false) as s, coalesce(bool_or(trim(lower(source)) = 'fulltext_pdf'), false) as p from documents where article_id is not null group by 1) select case when s and p then 'both' when s then 'summary' when p then 'passages' else 'none' end as kind, count(*) as n from (select distinct id from articles) left join h using (id) group by 1",
}

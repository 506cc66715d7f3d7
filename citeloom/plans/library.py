"""The library's criteria, tags, journals, imports and bridges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions import fields
from citeloom.functions.identifiers import normalize_doi
from citeloom.functions.text import SIGNIFICANT_STOP_WORDS, author_display, author_key, normalize_journal, significant_words, slug
from citeloom.operators import library
from citeloom.operators.dedup import duplicate_pairs, exact_pairs
from citeloom.operators.views import article_tags, articles, assessments, criteria, journal_index, links, made_issn
from citeloom.plans.facets import ArticleFilter
from citeloom.plans.matching import dedup_greedy
from citeloom.sources.exchange import file_doi
from citeloom.tables import table

#: Statuses that citations may be looked for in.
CITABLE = ["working", "included", "rejected"]
NOT_MET = "NOT MET: "


def _assessed(spark: SparkSession, folder: str) -> DataFrame:
    """Articles with the criteria that they met and failed."""
    a = table(spark, folder, "articles").select("id", "title", "status", "publication_year", "import_source", "duplicate_of")
    return a.join(assessments(spark, folder), "id", "left")


def facet_criterion(spark: SparkSession, folder: str) -> DataFrame:
    """Articles with a criterion in either array."""
    return ArticleFilter(criterion="openalex", primary_only=False).apply(_assessed(spark, folder), ("id", "status"))


def facet_unknown_criteria(spark: SparkSession, folder: str) -> DataFrame:
    """Articles with an element that is no criterion."""
    known = [r[0] for r in criteria(spark, folder).select("id").collect()]  # a fixed table
    return ArticleFilter(criteria_outside=known, primary_only=False).apply(_assessed(spark, folder), ("id",))


def facet_no_exclusion(spark: SparkSession, folder: str) -> DataFrame:
    return ArticleFilter(exclusion_empty=True, statuses=["working"], primary_only=False).apply(_assessed(spark, folder), ("id",))


def facet_no_criteria(spark: SparkSession, folder: str) -> DataFrame:
    return ArticleFilter(criteria_empty=True, primary_only=False).apply(_assessed(spark, folder), ("id",))


def _flags(spark: SparkSession, folder: str) -> DataFrame:
    """(id, screened, overridden) from the audit log: whether an article was screened, and whether a user set its status last."""
    e = table(spark, folder, "audit_entries").where("article_id is not null")
    last = F.max(F.when((F.col("action") == "status_changed") & F.col("ts").isNotNull(), F.struct("ts", "id", F.coalesce("source", F.lit("")).alias("source"))))
    return e.groupBy(F.col("article_id").alias("id")).agg(F.bool_or(F.col("action") == "screened").alias("screened"), F.coalesce(last["source"] == "user", F.lit(False)).alias("overridden"))


def facet_screening_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Articles still to work on though they were screened."""
    a = table(spark, folder, "articles").join(_flags(spark, folder), "id")
    return ArticleFilter(screening_error=True, primary_only=False).apply(a, ("id",))


def facet_overridden(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "articles").join(_flags(spark, folder), "id")
    return ArticleFilter(overridden=True, primary_only=False).apply(a, ("id", "status"))


def facet_statuses(spark: SparkSession, folder: str) -> DataFrame:
    """Articles of the wanted statuses that may be cited."""
    wanted = F.array_intersect(F.array(*(F.lit(s) for s in ("included", "nonsense", "duplicate", "working"))), F.array(*(F.lit(s) for s in CITABLE)))
    return articles(spark, folder, "status").where(F.array_contains(wanted, F.col("status"))).select("id", "status")


def facet_years_or_none(spark: SparkSession, folder: str) -> DataFrame:
    """Articles of a range of years, and those without a year."""
    return articles(spark, folder, "publication_year").where("publication_year is null or publication_year between 2008 and 2012").select("id", "publication_year")


def facet_borderline(spark: SparkSession, folder: str) -> DataFrame:
    """Articles with full text whose confidence, the share of trusted criteria among theirs, is between a half and nine tenths."""
    text = table(spark, folder, "documents").where("trim(lower(source)) = 'fulltext_pdf' and article_id is not null").select(F.col("article_id").alias("id")).distinct()
    both = F.array_union(F.from_json("matched_inclusion", "array<string>"), F.from_json("matched_exclusion", "array<string>"))
    trusted = [r[0] for r in criteria(spark, folder).where("kind = 'inclusion'").select("id").collect()]  # a fixed table
    share = F.try_divide(F.size(F.filter(both, lambda x: x.isin(trusted))), F.size(both))
    return assessments(spark, folder).where(F.size(both) > 0).select("id", F.round(share, 6).alias("confidence")).where("confidence >= 0.5 and confidence < 0.9").join(text, "id", "left_semi")


def full_text_missing_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Articles with full text of which no chunk has a vector."""
    text = table(spark, folder, "documents").where("trim(lower(source)) = 'fulltext_pdf' and article_id is not null").select("article_id").distinct()
    return text.join(table(spark, folder, "article_embeddings").where("chunk_index >= 0"), "article_id", "left_anti")


def sorted_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The first five articles by each sort key: text without case, nulls last, the id deciding ties."""
    keys = ("title", "publication_year", "journal", "num_cited", "status", "imported_at", "sequence_id", "doi", "language")
    out = None
    for key in keys:
        page = ArticleFilter(sort=key, descending=key not in ("title", "doi"), limit=5).apply(table(spark, folder, "articles"), ("id",)).select(F.lit(key).alias("sort"), "id")
        out = page if out is None else out.unionByName(page)
    return out


def page_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many pages of 25 each status fills."""
    return articles(spark, folder, "status").groupBy("status").agg(F.count("*").alias("n"), F.ceil(F.count("*") / 25).cast("long").alias("n_pages"))


def imports_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Records of each import without those whose row a user took out: rows are numbered by link within their article."""
    out = spark.createDataFrame([(0,), (2,)], "row int")  # fixed
    r = table(spark, folder, "raw_references").where("parent_article_id is not null").select("parent_article_id", "link_id").distinct()
    w = Window.partitionBy("parent_article_id").orderBy("link_id")
    return r.withColumn("row", F.row_number().over(w) - 1).join(F.broadcast(out), "row", "left_anti").groupBy("parent_article_id").agg(F.count("*").alias("n_kept"))


def prisma_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of a review's flow, in one pass."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    rejected, reasons = F.col("status") == "rejected", F.coalesce(F.col("matched_exclusion") != "[]", F.lit(False))
    c = _assessed(spark, folder).select("id", "import_source", "status", "duplicate_of", "matched_exclusion").distinct().agg(
        F.count("*").alias("identified"), n(F.col("duplicate_of").isNotNull()).alias("duplicates"), n(rejected).alias("excluded"), n(rejected & ~reasons).alias("excluded_generally"), n(rejected & reasons).alias("excluded_with_reasons"),
        n(F.col("status") == "working").alias("in_progress"), n(F.col("status") == "included").alias("included"),
    )
    screened = F.col("identified") - F.col("duplicates")
    return c.withColumn("screened", screened).withColumn("assessed", F.greatest(screened - F.col("excluded_generally"), F.lit(0)))


def exclusion_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """How many rejected articles failed each criterion; unknown ones under their id, requirements not met marked."""
    a = _assessed(spark, folder).where("status = 'rejected'").select("id", "import_source", F.explode(F.from_json("matched_exclusion", "array<string>")).alias("criterion")).distinct()
    n = a.groupBy("criterion").agg(F.count("*").alias("n"))
    text = F.when(F.col("kind") == "inclusion", F.concat(F.lit(NOT_MET), "text")).otherwise(F.coalesce("text", "criterion"))
    return n.join(F.broadcast(criteria(spark, folder)), F.col("criterion") == F.col("id"), "left").select("criterion", text.alias("reason"), "n")  # a fixed table


def criterion_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Criteria numbered through, those of inclusion first; a fixed table in one task."""
    w = Window.orderBy(F.when(F.col("kind") == "inclusion", 0).otherwise(1), "priority", "id")
    return criteria(spark, folder).select("id", F.row_number().over(w).alias("number"))


def tags_with_counts(spark: SparkSession, folder: str) -> DataFrame:
    """All tags with their articles of the library, none counted too."""
    t = article_tags(spark, folder)
    own = t.join(table(spark, folder, "articles").where("status = 'included'").select(F.col("id").alias("article_id")), "article_id", "left_semi").groupBy("tag").agg(F.count("*").alias("k"))
    return t.select("tag").distinct().join(own, "tag", "left").select("tag", F.coalesce("k", F.lit(0)).alias("n_articles"))


def tag_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Tags with a text in them, the most frequent first, ties from A to Z."""
    found = tags_with_counts(spark, folder).where(F.lower("tag").contains("care"))
    return found.orderBy(F.desc("n_articles"), "tag").limit(50)


def tags_by_article(spark: SparkSession, folder: str) -> DataFrame:
    """Each article's tags as a JSON array, in order; [] for none."""
    t = article_tags(spark, folder).groupBy(F.col("article_id").alias("id")).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return table(spark, folder, "articles").select("id").distinct().join(t, "id", "left").select("id", F.to_json(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags"))


def tags_merged(spark: SparkSession, folder: str) -> DataFrame:
    """The articles of two tags when one is merged into the other."""
    t = library.merged_tags(article_tags(spark, folder), "article_id", "tag", "humans", "adult")
    return t.groupBy("tag").agg(F.count("*").alias("n_articles"))


def tags_bulk_added(spark: SparkSession, folder: str) -> DataFrame:
    """The articles that get a tag they lack when all included ones are given it: the ids that change."""
    have = article_tags(spark, folder).where("tag = 'adult'")
    return table(spark, folder, "articles").where("status = 'included'").select(F.col("id").alias("article_id")).distinct().join(have, "article_id", "left_anti")


def tags_bulk_removed(spark: SparkSession, folder: str) -> DataFrame:
    """What tags the rejected articles keep when one is taken from them."""
    rejected = table(spark, folder, "articles").where("status = 'rejected'").select(F.col("id").alias("article_id"))
    t = article_tags(spark, folder).join(rejected, "article_id", "left_semi").where("tag <> 'adult'")
    return t.groupBy("tag").agg(F.count("*").alias("n_articles"))


def biblio_status(spark: SparkSession, folder: str) -> DataFrame:
    """How many articles, authors, terms, institutions, papers and links there are."""
    t = lambda name: table(spark, folder, name)
    parts = [
        ("articles", t("articles").select(F.countDistinct("id"))), ("authors", t("articles").select(F.explode("authors").alias("a")).select(author_key("a").alias("k")).where("k <> ''").select(F.countDistinct("k"))),
        ("terms", t("reference_papers").select(F.explode("keywords").alias("k")).select(fields.term_form("k").alias("k")).where("k <> ''").select(F.countDistinct("k"))),
        ("institutions", t("openalex_authors").where("institution is not null").select(F.countDistinct(F.lower("institution")))), ("papers", t("reference_papers").select(F.countDistinct("id"))), ("links", links(spark, folder).select(F.count("*"))),
    ]
    out = None
    for name, n in parts:
        row = n.toDF("n").select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def screening_progress(spark: SparkSession, folder: str) -> DataFrame:
    """The shares of articles that programs and users screened, in whole percent."""
    e = table(spark, folder, "audit_entries").where("action = 'screened' and article_id is not null")
    by = lambda s: F.count_distinct(F.when(F.col("source") == s, F.col("article_id")))
    n = table(spark, folder, "articles").agg(F.countDistinct("id").alias("n"))
    return e.agg(by("ai").alias("by_ai"), by("user").alias("by_user")).crossJoin(n).select("n", "by_ai", "by_user", F.round(100 * F.col("by_ai") / F.col("n")).cast("long").alias("ai_pct"), F.round(100 * F.col("by_user") / F.col("n")).cast("long").alias("user_pct"))  # one row each


def _papers_with_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Papers of which some carry their journal's print number, some its electronic one, some the name alone."""
    n = F.ascii(F.substring("id", -1, 1)) % 3
    p = table(spark, folder, "reference_papers").select("id", "journal", "match_status").distinct().withColumn("k", normalize_journal("journal"))
    return p.select("id", "journal", "match_status", F.when((n == 0) & (F.col("k") != ""), made_issn("k", 1)).alias("issn"), F.when((n == 1) & (F.col("k") != ""), F.regexp_replace(made_issn("k", 9), "-", "")).alias("eissn"))


def journal_match(spark: SparkSession, folder: str) -> DataFrame:
    return library.match_journals(_papers_with_numbers(spark, folder), journal_index(spark, folder))


def journals_relinked(spark: SparkSession, folder: str) -> DataFrame:
    """How many papers without a match get a journal, by tier; others keep theirs."""
    found = library.match_journals(_papers_with_numbers(spark, folder).where("match_status = 'unmatched'"), journal_index(spark, folder))
    return found.groupBy("tier").agg(F.count("*").alias("n"))


def journal_search(spark: SparkSession, folder: str) -> DataFrame:
    return library.search_journals(journal_index(spark, folder), "review").select("title", "tier")


def batch_zip(spark: SparkSession, folder: str) -> DataFrame:
    """Answers joined to articles by batch and place in it."""
    w = Window.partitionBy("batch").orderBy("sequence_id", "id", "import_source")
    a = articles(spark, folder, "sequence_id", "status").where("status = 'working'").withColumn("batch", F.floor((F.col("sequence_id") - 1) / 10)).withColumn("place", F.row_number().over(w))
    answers = table(spark, folder, "eval_items").select(F.floor((F.col("item_id") - 1) / 10).alias("batch"), (F.pmod(F.col("item_id") - 1, F.lit(10)) + 1).cast("int").alias("place"), "item_id")
    return a.join(answers, ["batch", "place"]).select("id", "item_id")


def batch_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files that are named by an article's DOI, and whether they hold its references or citations, joined to the articles."""
    p = table(spark, folder, "reference_papers").select(normalize_doi("doi").alias("d")).where("d is not null").distinct()
    names = p.select(F.concat(F.regexp_replace("d", "/", "_"), F.when(F.length("d") % 2 == 0, "_references.ris").otherwise("_citations.ris")).alias("file"))
    own = table(spark, folder, "articles").select(normalize_doi("doi").alias("doi"), "id").where("doi is not null").groupBy("doi").agg(F.min("id").alias("id"))
    return names.select("file", file_doi("file").alias("x")).select("file", "x.doi", "x.kind").join(own, "doi").select("file", "id", "kind")


def terms_to_articles(spark: SparkSession, folder: str) -> DataFrame:
    """The articles of wanted terms, by keywords and tags and words of their titles, compared in one form."""
    wanted = ["Systematic-Review", "sleep", "remote costs"]
    t = article_tags(spark, folder).select("article_id", fields.term_form("tag").alias("form"))
    words = table(spark, folder, "articles").select(F.col("id").alias("article_id"), F.explode(significant_words("title")).alias("form"))
    forms = spark.createDataFrame([(x,) for x in wanted], "term string").select("term", fields.term_form("term").alias("form"))  # fixed
    return t.unionByName(words).distinct().join(F.broadcast(forms), "form").select("term", "article_id").distinct()


def authors_to_articles(spark: SparkSession, folder: str) -> DataFrame:
    """The forty articles of the most frequent authors that are cited most, unknown counts last."""
    a = table(spark, folder, "articles").select("id", "num_cited", "publication_year", F.explode("authors").alias("raw")).select("id", "num_cited", "publication_year", author_key("raw").alias("author")).where("author <> ''").distinct()
    top = a.groupBy("author").agg(F.countDistinct("id").alias("n")).orderBy(F.desc("n"), "author").limit(20)
    found = a.join(F.broadcast(top), "author", "left_semi").select("id", "num_cited", "publication_year").distinct()  # twenty rows
    return found.orderBy(F.coalesce("num_cited", F.lit(-1)).desc(), F.coalesce("publication_year", F.lit(-1)).desc(), "id").limit(40)


def paper_identity(spark: SparkSession, folder: str) -> DataFrame:
    """For each delivery the reference paper that it is: by DOI, else by title, authors and year; new ones under their first delivery."""
    names = F.to_json("authors")
    keys = [normalize_doi("doi"), F.when(F.trim("title") != "", F.concat_ws("\x01", F.lower("title"), names, F.coalesce(F.col("publication_year").cast("string"), F.lit(""))))]
    have = table(spark, folder, "reference_papers").select("id", "doi", "title", "authors", "publication_year")
    new = table(spark, folder, "raw_references").select("link_id", "doi", "title", "authors", "publication_year").distinct()
    return library.identify(have, new, keys, "link_id")


def authors_upserted(spark: SparkSession, folder: str) -> DataFrame:
    """Authors by key when those of the papers are put into those of the articles: a known key takes the later name."""
    of = lambda name: table(spark, folder, name).select(F.explode("authors").alias("raw")).select(author_key("raw").alias("author"), author_display("raw").alias("display")).where("author <> ''")
    return library.upsert(of("articles").groupBy("author").agg(F.min("display").alias("display")), of("reference_papers"), ["author"], "display")


def sequence_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """New papers numbered after the last article, in order of time and id."""
    last = table(spark, folder, "articles").agg(F.max("sequence_id")).first()[0] or 0  # one figure
    new = table(spark, folder, "reference_papers").select("id", "created_at").distinct()
    return library.numbered(new, [F.col("created_at").asc_nulls_first(), F.col("id").asc()], last).select("id", "sequence_id")


def imports_classified(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of newly imported articles: exact duplicates of another leave for it, near ones wait for a review, the rest is worked on."""
    new = table(spark, folder, "articles").where("import_source = 'ris_import'").select("id").distinct()
    # each pair counts for its second record where that is new, else for its first; the pairs are read once, those of no new record meet none
    pairs = dedup_greedy(spark, folder).join(new.select(F.col("id").alias("b"), F.lit(True).alias("_new")), "b", "left")
    of = lambda x, y: F.when(F.col("_new"), F.col(x)).otherwise(F.col(y))
    found = pairs.select(of("b", "a").alias("id"), of("a", "b").alias("other"), "kind").groupBy("id").agg(F.min(F.struct("kind", "other")).alias("m"))
    return new.join(found, "id", "left").select("id", F.when(F.col("m.kind") == "exact", "duplicate").when(F.col("m.kind") == "fuzzy", "review").otherwise("working").alias("status"), F.when(F.col("m.kind") == "exact", F.col("m.other")).alias("duplicate_of"))


def duplicates_rechecked(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs among articles that are duplicates or worked on."""
    return duplicate_pairs(table(spark, folder, "articles").where("status in ('duplicate', 'working')"))


def duplicates_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Of each exact pair the record that stays: the one with more fields, else the first; pairs with a record that is merged already are left out."""
    a = table(spark, folder, "articles")
    filled = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in ("abstract_text", "authors", "publication_year", "doi", "journal", "language", "num_cited")), F.lit(0))
    f = a.groupBy("id").agg(F.max(filled).alias("n"), F.bool_or(F.col("duplicate_of").isNotNull()).alias("gone"))
    f = f.where("not gone").select("id", "n")
    pairs = exact_pairs(a.join(f, "id", "left_semi")).join(f.toDF("a", "na"), "a").join(f.toDF("b", "nb"), "b")
    return pairs.select(F.when(F.col("na") >= F.col("nb"), F.col("a")).otherwise(F.col("b")).alias("survivor"), F.when(F.col("na") >= F.col("nb"), F.col("b")).otherwise(F.col("a")).alias("duplicate"))


def fuzzy_resolved(spark: SparkSession, folder: str) -> DataFrame:
    """Near pairs when a reviewer keeps the better scored ones' first record, and both of the others."""
    pairs = duplicate_pairs(table(spark, folder, "articles")).where("kind = 'fuzzy'")
    keep = F.when(F.col("score") >= 0.8, "first").otherwise("both")
    return pairs.select("a", "b", keep.alias("kept"), F.when(keep == "first", F.col("a")).alias("duplicate_of"))


def author_bridge_built(spark: SparkSession, folder: str) -> DataFrame:
    """The bridge of articles and authors: place, key, and affiliation: a list as long as the authors is dealt out, a single one goes to all."""
    lists = table(spark, folder, "openalex_authors").where("institution is not null").groupBy(author_key("display_name").alias("k")).agg(F.max("institution").alias("i"))
    a = articles(spark, folder, "status", "authors").where("status = 'included'").select("id", "import_source", "authors", F.posexplode("authors").alias("place", "raw")).where("raw is not null").withColumn("author", author_key("raw")).where("author <> ''")
    return a.join(lists, F.col("author") == F.col("k"), "left").select(F.col("id").alias("article_id"), "place", "author", F.col("i").alias("affiliation")).distinct()


def affiliations_dealt(spark: SparkSession, folder: str) -> DataFrame:
    """Affiliation lists dealt to authors: one each where there are as many, a single one to all, none otherwise."""
    n = F.size("authors")
    listed = F.when(F.col("sequence_id") % 3 == 0, F.transform("authors", lambda x, i: F.concat(F.lit("Inst "), i.cast("string")))).when(F.col("sequence_id") % 3 == 1, F.array(F.lit("Inst all"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    a = table(spark, folder, "articles").where("size(authors) > 0").select("id", "authors", listed.alias("l"), n.alias("n")).distinct()
    at = lambda i: F.when(F.size("l") == F.col("n"), F.get("l", i)).when(F.size("l") == 1, F.get("l", F.lit(0)))
    return a.select("id", F.posexplode("authors").alias("place", "raw"), "l", "n").select("id", "place", at(F.col("place")).alias("affiliation"))


def term_bridge(spark: SparkSession, folder: str) -> DataFrame:
    """The bridge of articles and terms: tags as keywords, words of title and abstract as phrases, with their frequency."""
    own = articles(spark, folder, "status", "title", "abstract_text").where("status = 'included'").select("id", "title", "abstract_text").distinct()
    words = own.select("id", F.explode(significant_words(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract_text", F.lit(""))))).alias("term"), F.lit("noun_phrase").alias("kind"))
    tags = article_tags(spark, folder).join(own.select(F.col("id").alias("article_id")), "article_id", "left_semi").select(F.col("article_id").alias("id"), F.col("tag").alias("term"), F.lit("keyword").alias("kind"))
    return words.unionByName(tags).groupBy("id", "term", "kind").agg(F.count("*").alias("frequency"))


def term_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Terms with their occurrences, by kind: what is rebuilt when the derived ones are dropped and made again."""
    return term_bridge(spark, folder).groupBy("term", "kind").agg(F.sum("frequency").alias("frequency"), F.count("*").alias("n_articles"))


def institutions_built(spark: SparkSession, folder: str) -> DataFrame:
    """Institutions by key with the first country seen, by author."""
    o = table(spark, folder, "openalex_authors").where("institution is not null").select("author_id", F.lower(F.regexp_replace(F.trim("institution"), r"\s+", " ")).alias("institution"), "country").distinct()
    return o.groupBy("institution").agg(F.min(F.when(F.col("country").isNotNull(), F.struct("author_id", "country")))["country"].alias("country"), F.countDistinct("author_id").alias("n_authors"))


def institutions_by_author(spark: SparkSession, folder: str) -> DataFrame:
    """Each author's institutions, the latest first."""
    o = table(spark, folder, "openalex_authors").where("institution is not null and author_id is not null").groupBy("author_id", "institution").agg(F.max(F.coalesce(F.year("updated_at"), F.lit(0))).alias("year"))
    return o.select("author_id", "institution", F.row_number().over(Window.partitionBy("author_id").orderBy(F.desc("year"), "institution")).alias("place"))


def first_author_counts(spark: SparkSession, folder: str) -> DataFrame:
    b = table(spark, folder, "articles").select("id", F.posexplode("authors").alias("place", "raw")).select("id", "place", author_key("raw").alias("author")).where("author <> ''").distinct()
    return b.groupBy("author").agg(F.count("*").alias("n"), F.count_if(F.col("place") == 0).alias("n_first"))


def author_detail(spark: SparkSession, folder: str) -> DataFrame:
    """Each author's five most cited articles and the years of all."""
    a = table(spark, folder, "articles").select("id", "num_cited", "publication_year", F.explode("authors").alias("raw")).select("id", "num_cited", "publication_year", author_key("raw").alias("author")).where("author <> ''").distinct()
    w = Window.partitionBy("author").orderBy(F.coalesce("num_cited", F.lit(-1)).desc(), "id")
    top = a.withColumn("r", F.row_number().over(w)).where("r <= 5").groupBy("author").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]), " ").alias("top"))
    years = a.where("publication_year is not null").groupBy("author", "publication_year").agg(F.count("*").alias("n")).groupBy("author").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("publication_year", "n"))), lambda x: F.concat(x["publication_year"].cast("string"), F.lit(":"), x["n"].cast("string"))), " ").alias("by_year"))
    return top.join(years, "author", "left")


def author_themes(spark: SparkSession, folder: str) -> DataFrame:
    """The three tags that most of an author's articles carry, ties by name."""
    a = table(spark, folder, "articles").select(F.col("id").alias("article_id"), F.explode("authors").alias("raw")).select("article_id", author_key("raw").alias("author")).where("author <> ''").distinct()
    n = a.join(article_tags(spark, folder), "article_id").groupBy("author", "tag").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("author").orderBy(F.desc("n"), "tag"))).where("r <= 3")


def canonical_names(spark: SparkSession, folder: str) -> DataFrame:
    """Each spelling of a journal and the one that stands for all of its key: the most frequent, the longest, the last by letters."""
    n = table(spark, folder, "reference_papers").select(F.trim("journal").alias("name")).where("name <> ''").groupBy("name", slug("name").alias("slug")).agg(F.count("*").alias("n")).where("slug <> ''")
    best = n.groupBy("slug").agg(F.max(F.struct("n", F.length("name").alias("l"), "name"))["name"].alias("canonical"))
    return n.join(best, "slug").select("name", "canonical")


QUERIES = {
    f.__name__: f
    for f in (
        facet_criterion, facet_unknown_criteria, facet_no_exclusion, facet_no_criteria, facet_screening_errors, facet_overridden, facet_statuses, facet_years_or_none, facet_borderline, full_text_missing_chunks, sorted_pages,
        page_counts, imports_kept, prisma_counts, exclusion_reasons, criterion_numbers, tags_with_counts, tag_panel, tags_by_article, tags_merged, tags_bulk_added, tags_bulk_removed, biblio_status, screening_progress,
        journal_match, journals_relinked, journal_search, batch_zip, batch_files, terms_to_articles, authors_to_articles, paper_identity, authors_upserted, sequence_numbers, imports_classified, duplicates_rechecked,
        duplicates_merged, fuzzy_resolved, author_bridge_built, affiliations_dealt, term_bridge, term_totals, institutions_built, institutions_by_author, first_author_counts, author_detail, author_themes, canonical_names,
    )
}

from citeloom.plans.bibliometrics import KEY, PARTS, A, L  # noqa: E402
from citeloom.plans.matching import BARE, DOI  # noqa: E402
from citeloom.plans.matching import SQL as MATCHING  # noqa: E402

C = "c as (select lower(trim(import_source)) as id, case when trust_rank <= 3 then 'inclusion' else 'exclusion' end as kind, array_to_string(list_transform(string_split(import_source, '_'), lambda w: upper(left(w, 1)) || lower(w[2:])), ' ') as text, trust_rank as priority from source_trust where import_source is not null)"
AS = "s as (select parent_article_id as id, coalesce(list_sort(list(distinct x) filter (x <> '' and reference_type = 'reference')), []) as i, coalesce(list_sort(list(distinct x) filter (x <> '' and reference_type = 'citation')), []) as e from (select *, lower(trim(import_source)) as x from raw_references where parent_article_id is not null) group by 1)"
AA = f"{A}, {AS}, aa as (select a.*, i, e, coalesce(list_concat(i, e), []) as crit from a left join s using (id))"
T = "t as (select distinct article_id, tag from (select matched_article_id as article_id, lower(trim(unnest(keywords))) as tag from reference_papers where matched_article_id is not null) where tag <> '')"
FLAGS = "f as (select article_id as id, bool_or(action = 'screened') as screened, coalesce(last(coalesce(source, '') order by ts, id) filter (action = 'status_changed' and ts is not null) = 'user', false) as overridden from audit_entries where article_id is not null group by 1)"
JKEY = r"trim(regexp_replace(translate(replace(regexp_replace(lower(journal), '(?:\s*\([^()]*\)\s*)+$', ''), '&', 'and'), ':-', '  '), '\s+', ' ', 'g'))"
ISSN = "left(translate(md5({0})[{1}:{2}], 'abcdef', '012345'), 4) || '-' || translate(md5({0})[{1}:{2}], 'abcdef', '012345')[5:8]"
J = f"j as (select 'jn-' || left(md5(k), 10) as journal_id, min(journal) as title, k, {ISSN.format('k', 1, 8)} as issn, {ISSN.format('k', 9, 16)} as eissn from (select journal, {JKEY} as k from (select journal from articles union all select journal from reference_papers) where trim(journal) <> '') where k <> '' group by k)"
PJ = f"pj as (select distinct id, match_status, k, case when ascii(right(id, 1)) % 3 = 0 and k <> '' then {ISSN.format('k', 1, 8)} end as issn, case when ascii(right(id, 1)) % 3 = 1 and k <> '' then {ISSN.format('k', 9, 16)} end as eissn from (select id, match_status, {JKEY} as k from reference_papers))"
JM = f"""{J}, {PJ}, h as (select id, 1 as tier, journal_id from pj join j on pj.issn = j.issn union all select id, 2, journal_id from pj join j on pj.issn = j.eissn union all select id, 3, journal_id from pj join j on pj.eissn = j.eissn union all select id, 4, journal_id from pj join j on pj.eissn = j.issn union all select id, 5, journal_id from pj join j on pj.k = j.k where pj.k <> ''),
jm as (select id, min(tier) as tier, first(journal_id order by tier, journal_id) as journal_id from h group by 1)"""
NK = f"select *, {KEY} as author from (select *, {PARTS} as p from ({{}}) where raw_name is not null)"
AU = f"au as (select distinct id, num_cited, publication_year, author from ({NK.format('select id, num_cited, publication_year, unnest(authors) as raw_name from articles')}) where author <> '')"
WORDS = rf"list_filter(regexp_split_to_array(lower({{}}), '[^\p{{{{L}}}}\p{{{{N}}}}]+'), lambda w: strlen(w) >= 4 and w not in ({', '.join(repr(x) for x in SIGNIFICANT_STOP_WORDS)}))"
FORM = r"regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(lower({}), '^[\s,.;:\[\]]+|[\s,.;:\[\]]+$', '', 'g'), '-_', '  '), '[\[\]\"'']', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
TB = f"""{A}, {T}, own as (select distinct id, title, abstract_text from a where status = 'included'), tb as (select id, term, kind, count(*) as frequency from (select id, unnest({WORDS.format("coalesce(title, '') || ' ' || coalesce(abstract_text, '')")}) as term, 'noun_phrase' as kind from own
  union all select article_id, tag, 'keyword' from t where article_id in (select id from own)) group by all)"""
FIELDS = "(abstract_text is not null)::int + (authors is not null)::int + (publication_year is not null)::int + (doi is not null)::int + (journal is not null)::int + (language is not null)::int + (num_cited is not null)::int"
DP = f"dp as ({MATCHING['dedup_pairs']})"
SORTS = {"title": "lower(title) asc", "publication_year": "publication_year desc", "journal": "lower(journal) desc", "num_cited": "num_cited desc", "status": "lower(status) desc", "imported_at": "imported_at desc", "sequence_id": "sequence_id desc", "doi": "lower(doi) asc", "language": "lower(language) desc"}
SQL: dict[str, str] = {
    "facet_criterion": f"with {AA} select id, status from aa where list_contains(crit, 'openalex')",
    "facet_unknown_criteria": f"with {AA}, {C} select id from aa, (select list(id) as known from c) where len(list_filter(crit, lambda x: not list_contains(known, x))) > 0",
    "facet_no_exclusion": f"with {AA} select id from aa where coalesce(len(e), 0) = 0 and status = 'working'",
    "facet_no_criteria": f"with {AA} select id from aa where len(crit) = 0",
    "facet_screening_errors": f"with {A}, {FLAGS} select a.id from a join f using (id) where status = 'working' and screened",
    "facet_overridden": f"with {A}, {FLAGS} select a.id, status from a join f using (id) where overridden",
    "facet_statuses": f"with {A} select id, status from a where status in ('included', 'working')",
    "facet_years_or_none": f"with {A} select id, publication_year from a where publication_year is null or publication_year between 2008 and 2012",
    "facet_borderline": f"with {AS}, {C}, x as (select id, list_distinct(list_concat(i, e)) as b from s), y as (select id, round(len(list_filter(b, lambda k: list_contains(known, k))) / len(b), 6) as confidence from x, (select list(id) as known from c where kind = 'inclusion') where len(b) > 0) select * from y where confidence >= 0.5 and confidence < 0.9 and id in (select article_id from documents where trim(lower(source)) = 'fulltext_pdf')",
    "full_text_missing_chunks": "select distinct article_id from documents where trim(lower(source)) = 'fulltext_pdf' and article_id is not null and article_id not in (select article_id from article_embeddings where chunk_index >= 0 and article_id is not null)",
    "sorted_pages": f"with {A} " + " union all ".join(f"select * from (select '{k}' as sort, id from a where duplicate_of is null order by {o} nulls last, id limit 5)" for k, o in SORTS.items()),
    "page_counts": f"with {A} select status, count(*) as n, ceil(count(*) / 25)::bigint as n_pages from a group by 1",
    "imports_kept": "select parent_article_id, count(*) as n_kept from (select parent_article_id, row_number() over (partition by parent_article_id order by link_id) - 1 as r from (select distinct parent_article_id, link_id from raw_references where parent_article_id is not null)) where r not in (0, 2) group by 1",
    "prisma_counts": f"with {AA}, k as (select count(*) as identified, count(*) filter (duplicate_of is not null) as duplicates, count(*) filter (status = 'rejected') as excluded, count(*) filter (status = 'rejected' and coalesce(len(e), 0) = 0) as excluded_generally, count(*) filter (status = 'rejected' and len(e) > 0) as excluded_with_reasons, count(*) filter (status = 'working') as in_progress, count(*) filter (status = 'included') as included from aa) select *, identified - duplicates as screened, greatest(identified - duplicates - excluded_generally, 0) as assessed from k",
    "exclusion_reasons": f"with {AA}, {C}, n as (select criterion, count(*) as n from (select id, import_source, unnest(e) as criterion from aa where status = 'rejected') group by 1) select criterion, case when kind = 'inclusion' then 'NOT MET: ' || text else coalesce(text, criterion) end as reason, n from n left join c on criterion = c.id",
    "criterion_numbers": f"with {C} select id, row_number() over (order by kind desc, priority, id) as number from c",
    "tags_with_counts": f"with {T} select tag, count(*) filter (article_id in (select id from articles where status = 'included')) as n_articles from t group by 1",
    "tag_panel": f"with {T} select tag, count(*) filter (article_id in (select id from articles where status = 'included')) as n_articles from t where contains(lower(tag), 'care') group by 1 order by 2 desc, 1 limit 50",
    "tags_by_article": f"""with {T}, g as (select article_id as id, list_sort(list(tag)) as l from t group by 1) select id, case when l is null then '[]' else '["' || array_to_string(l, '","') || '"]' end as tags from (select distinct id from articles) left join g using (id)""",
    "tags_merged": f"with {T} select tag, count(*) as n_articles from (select distinct article_id, case when tag = 'humans' then 'adult' else tag end as tag from t) group by 1",
    "tags_bulk_added": f"with {T} select distinct id as article_id from articles where status = 'included' and id not in (select article_id from t where tag = 'adult')",
    "tags_bulk_removed": f"with {T} select tag, count(*) as n_articles from t where tag <> 'adult' and article_id in (select id from articles where status = 'rejected') group by 1",
    "biblio_status": f"with {L}, {AU} select 'articles' as part, count(distinct id) as n from articles union all select 'authors', count(distinct author) from au union all select 'terms', count(distinct k) from (select {FORM.format('k')} as k from (select unnest(keywords) as k from reference_papers)) where k <> '' union all select 'institutions', count(distinct lower(institution)) from openalex_authors union all select 'papers', count(distinct id) from reference_papers union all select 'links', count(*) from l",
    "screening_progress": "with e as (select count(distinct article_id) filter (source = 'ai') as by_ai, count(distinct article_id) filter (source = 'user') as by_user from audit_entries where action = 'screened'), n as (select count(distinct id) as n from articles) select n, by_ai, by_user, round(100 * by_ai / n)::bigint as ai_pct, round(100 * by_user / n)::bigint as user_pct from e, n",
    "journal_match": f"with {JM} select * from jm",
    "journals_relinked": f"with {JM} select tier, count(*) as n from jm where id in (select id from reference_papers where match_status = 'unmatched') group by 1",
    "journal_search": f"with {J}, k as (select title, case when lower(trim(title)) = 'review' then 2 when contains(lower(title), 'review') then 3 end as tier from j) select * from k where tier = (select min(tier) from k) order by length(title), title limit 25",
    "batch_zip": f"with {A}, w as (select id, floor((sequence_id - 1) / 10) as batch, row_number() over (partition by floor((sequence_id - 1) / 10) order by sequence_id, id, import_source) as place from a where status = 'working') select id, item_id from w join eval_items e on floor((e.item_id - 1) / 10) = batch and (e.item_id - 1) % 10 + 1 = place",
    "batch_files": f"with p as (select distinct {DOI} as d from (select {BARE} as d from reference_papers)), n as (select regexp_replace(d, '/', '_', 'g') || case when length(d) % 2 = 0 then '_references.ris' else '_citations.ris' end as file, case when length(d) % 2 = 0 then 'references' else 'citations' end as kind, regexp_replace(regexp_replace(d, '/', '_', 'g'), '^([^_]+)_', '\\1/') as doi from p where d is not null), o as (select {DOI} as doi, min(id) as id from (select id, {BARE} as d from articles) where {DOI} is not null group by 1) select file, id, kind from n join o using (doi)",
    "terms_to_articles": f"with {T}, w(term, form) as (values ('Systematic-Review', 'systematic review'), ('sleep', 'sleep'), ('remote costs', 'remote costs')), x as (select article_id, {FORM.format('tag')} as form from t union select id, unnest({WORDS.format('title')}) from articles) select distinct term, article_id from w join x using (form)",
    "authors_to_articles": f"with {AU}, t as (select author from au group by 1 order by count(distinct id) desc, author limit 20) select id, num_cited, publication_year from (select distinct id, num_cited, publication_year from au where author in (select author from t)) order by coalesce(num_cited, -1) desc, coalesce(publication_year, -1) desc, id limit 40",
    "paper_identity": f"""with b as (select 'p' as s, id, doi, title, authors, publication_year from reference_papers union select 'r', link_id, doi, title, authors, publication_year from raw_references),
      k as (select s, id, {DOI} as d, case when trim(title) <> '' then lower(title) || chr(1) || coalesce(to_json(authors)::varchar || chr(1), '') || coalesce(publication_year::varchar, '') end as t from (select *, {BARE} as d from b)),
      kd as (select d, min(id) as h from k where s = 'p' and d is not null group by 1), kt as (select t, min(id) as h from k where s = 'p' and t is not null group by 1),
      r as (select k.id, k.d, k.t, coalesce(kd.h, kt.h) as hit from k left join kd using (d) left join kt on kt.t = k.t where s = 'r' and (k.d is not null or k.t is not null))
      select id as link_id, coalesce(hit, min(id) filter (hit is null) over (partition by coalesce('d' || d, 't' || t))) as id, hit is not null as found from r""",
    "authors_upserted": f"with n as (select s, author, case when contains(t, ',') or len(q) < 2 then t else q[-1] || ', ' || array_to_string(q[:-2], ' ') end as display from (select *, trim(raw_name) as t, regexp_split_to_array(trim(raw_name), '\\s+') as q from ({NK.format('select 1 as s, unnest(authors) as raw_name from articles union all select 2, unnest(authors) from reference_papers')}) where author <> '')) select author, coalesce(max(display) filter (s = 2), min(display) filter (s = 1)) as display from n group by 1",
    "sequence_numbers": "select id, (select max(sequence_id) from articles) + row_number() over (order by created_at nulls first, id) as sequence_id from (select distinct id, created_at from reference_papers)",
    "duplicates_rechecked": MATCHING["dedup_pairs"].replace("select distinct * from articles", "select distinct * from articles where status in ('duplicate', 'working')"),
    "duplicates_merged": f"with f as (select id, max({FIELDS}) as n from articles group by 1 having not bool_or(duplicate_of is not null)), {DP} select case when x.n >= y.n then a else b end as survivor, case when x.n >= y.n then b else a end as duplicate from dp join f x on x.id = a join f y on y.id = b where kind = 'exact'",
    "fuzzy_resolved": f"with {DP} select a, b, case when score >= 0.8 then 'first' else 'both' end as kept, case when score >= 0.8 then a end as duplicate_of from dp where kind = 'fuzzy'",
    "author_bridge_built": f"with {A}, i as (select author as k, max(institution) as i from ({NK.format('select display_name as raw_name, institution from openalex_authors where institution is not null')}) group by 1), b as (select distinct id, place, author from ({NK.format('select id, unnest(authors) as raw_name, generate_subscripts(authors, 1) - 1 as place from a where status = ' + chr(39) + 'included' + chr(39))}) where author <> '') select id as article_id, place, author, i as affiliation from b left join i on k = author",
    "affiliations_dealt": "select distinct id, place, case sequence_id % 3 when 0 then 'Inst ' || place when 1 then 'Inst all' else case when len(authors) = 2 then ['a', 'b'][place + 1] end end as affiliation from (select id, sequence_id, authors, unnest(generate_series(0, len(authors) - 1)) as place from (select distinct id, sequence_id, authors from articles where len(authors) > 0))",
    "term_bridge": f"with {TB} select * from tb",
    "term_totals": f"with {TB} select term, kind, sum(frequency) as frequency, count(*) as n_articles from tb group by all",
    "institutions_built": r"with o as (select distinct author_id, lower(regexp_replace(trim(institution), '\s+', ' ', 'g')) as institution, country from openalex_authors where institution is not null) select institution, first(country order by author_id nulls first, country) filter (country is not null) as country, count(distinct author_id) as n_authors from o group by 1",
    "institutions_by_author": "with o as (select author_id, institution, max(coalesce(year(updated_at), 0)) as y from openalex_authors where institution is not null and author_id is not null group by all) select author_id, institution, row_number() over (partition by author_id order by y desc, institution) as place from o",
    "first_author_counts": f"select author, count(*) as n, count(*) filter (place = 0) as n_first from (select distinct id, place, author from ({NK.format('select id, unnest(authors) as raw_name, generate_subscripts(authors, 1) - 1 as place from articles')}) where author <> '') group by 1",
    "author_detail": f"with {AU}, r as (select author, array_to_string(list(id order by r), ' ') as top from (select *, row_number() over (partition by author order by coalesce(num_cited, -1) desc, id) as r from au) where r <= 5 group by 1), y as (select author, array_to_string(list(publication_year || ':' || n order by publication_year), ' ') as by_year from (select author, publication_year, count(*) as n from au where publication_year is not null group by all) group by 1) select author, top, by_year from r left join y using (author)",
    "author_themes": f"with {AU}, {T}, n as (select author, tag, count(*) as n from (select distinct author, id from au) x join t on article_id = id group by all) select * from (select *, row_number() over (partition by author order by n desc, tag) as r from n) where r <= 3",
    "canonical_names": "with n as (select trim(journal) as name, regexp_replace(regexp_replace(lower(trim(journal)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug, count(*) as n from reference_papers where trim(journal) <> '' group by all) select name, first_value(name) over (partition by slug order by n desc, length(name) desc, name desc) as canonical from n where slug <> ''",
}

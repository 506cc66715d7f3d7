"""Search and retrieval: tokens, BM25, containment, Jaccard, cosine recall, chunks, work lists."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions.stemming import stem
from citeloom.functions.text import STOP_WORDS, strip_html, tokenize, tokenize_for_match
from citeloom.operators import segments
from citeloom.operators.sets import similar_sets
from citeloom.operators.vectors import dot, nearest, pooled
from citeloom.tables import table

QUERY = "sleep quality and blood pressure in rural clinics"
# Fixed values of the ranking function.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents with text; doc_id is unique by the table's contract, so that nothing is shuffled to find repeats."""
    return table(spark, folder, "documents").where("text is not null").select("doc_id", "text", "article_id")


def _postings(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, token, tf, size): the inverted index."""
    t = documents(spark, folder).select("doc_id", tokenize("text").alias("t")).where(F.size("t") > 0)
    return t.select("doc_id", F.size("t").alias("size"), F.explode("t").alias("token")).groupBy("doc_id", "size", "token").agg(F.count("*").alias("tf"))


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _postings(spark, folder).groupBy("token").agg(F.sum("tf").alias("n"), F.count("*").alias("n_docs"))


def bm25_search(spark: SparkSession, folder: str) -> DataFrame:
    """The thirty best documents for a query: its words without stop words, any of which may match."""
    words = [w for w in QUERY.split() if w not in STOP_WORDS]
    p = _postings(spark, folder)
    # one pass for the collection's figures; the query's postings alone are joined with them
    stats = documents(spark, folder).select(F.size(tokenize("text")).alias("n")).where("n > 0").agg(F.count("*").alias("docs"), F.avg("n").alias("avg_size"))
    hit = p.where(F.col("token").isin(words))
    df = hit.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("avg_size")))
    scored = hit.join(F.broadcast(df), "token").crossJoin(F.broadcast(stats)).groupBy("doc_id").agg(F.round(F.sum(score), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(30)


def stem_words(words: DataFrame) -> DataFrame:
    """(token, stem) of distinct words: each word is stemmed once, whatever its frequency."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"token": batch["token"], "stem": [stem(w) for w in batch["token"]]})

    return words.select("token").distinct().mapInPandas(work, "token string, stem string")


def stem_counts(spark: SparkSession, folder: str) -> DataFrame:
    p = _postings(spark, folder)
    return p.join(stem_words(p), "token").groupBy("stem").agg(F.sum("tf").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def containment_best(spark: SparkSession, folder: str) -> DataFrame:
    """For each held-out item the document that contains most of its words, 0.3 or more; repeated words count in the denominator only."""
    q = table(spark, folder, "eval_items").select("item_id", tokenize_for_match("text").alias("t"))
    size = q.select("item_id", F.size("t").alias("n"))
    d = documents(spark, folder).select("doc_id", F.explode(F.array_distinct(tokenize("text"))).alias("token"))
    shared = d.join(q.select("item_id", F.explode(F.array_distinct("t")).alias("token")), "token").groupBy("item_id", "doc_id").agg(F.count("*").alias("k"))
    best = shared.groupBy("item_id").agg(F.max(F.struct("k", (-F.col("doc_id")).alias("d"))).alias("m"))
    return best.join(size, "item_id").select("item_id", (-F.col("m.d")).alias("doc_id"), F.round(F.col("m.k") / F.col("n"), 6).alias("score")).where("score >= 0.3")


def title_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of distinct titles whose word sets are 0.8 alike, between the smallest articles of equal sets; title_sets has the others."""
    t = _title_sets(spark, folder).groupBy("key").agg(F.min("id").alias("id"))
    return similar_sets(t.select("id", F.split("key", " ").alias("s")), "id", "s", 0.8)


def title_sets(spark: SparkSession, folder: str) -> DataFrame:
    """The class of each article by its title's word set: the smallest article with the same."""
    t = _title_sets(spark, folder)
    return t.join(t.groupBy("key").agg(F.min("id").alias("class_id")), "key").select("id", "class_id").distinct()


def _title_sets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "articles").select("id", F.array_join(F.array_sort(F.array_distinct(tokenize("title"))), " ").alias("key")).where("key <> ''").distinct()


def _queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").where("vec_id % 100 = 0")


def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The thirty vectors nearest to each of the queries, which are the vectors whose id is divisible by 100."""
    return nearest(table(spark, folder, "embeddings"), _queries(spark, folder), "vec_id", "embedding", 30).select("query", F.col("key").alias("vec_id"), "score")


def max_pool_recall(spark: SparkSession, folder: str) -> DataFrame:
    """For each query the best vector of each group, and its score."""
    return nearest(table(spark, folder, "embeddings"), _queries(spark, folder), "vec_id", "embedding", 1, "label").select("query", F.col("group").cast("int").alias("label"), "score", F.col("key").alias("vec_id"))


def mean_pool(spark: SparkSession, folder: str) -> DataFrame:
    """The mean vector of each group, at length 1."""
    p = pooled(table(spark, folder, "embeddings"), ["label"], "embedding", F.lit(1))
    length = F.sqrt(dot("vector", "vector"))
    return p.select("label", F.posexplode(F.transform("vector", lambda x: F.try_divide(x, length))).alias("pos", "value")).select("label", "pos", F.round("value", 6).alias("value"))


def stale_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """The work list: tasks without an embedding of their text's hash; (article, chunk) once each."""
    want = table(spark, folder, "embed_tasks").where(r"text is not null and text rlike '\\S'").select("article_id", "chunk_index", F.sha2("text", 256).alias("hash")).distinct()
    have = table(spark, folder, "article_embeddings").select("article_id", "chunk_index", F.col("input_hash").alias("hash"))
    return want.join(have, ["article_id", "chunk_index", "hash"], "left_anti").select("article_id", "chunk_index").distinct()


def embedding_coverage(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "article_embeddings").where("embedding is not null and size(embedding) = dimensions")
    return e.groupBy("model_name", "dimensions").agg(F.countDistinct("article_id").alias("n_articles"), F.countDistinct("article_id", "chunk_index").alias("n_vectors"))


def expected_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The row of title and abstract that each article should have: chunk -1, with the hash of its text."""
    text = F.concat_ws("\n\n", F.trim("title"), F.when(F.trim("abstract_text") != "", F.trim("abstract_text")))
    return table(spark, folder, "articles").select(F.col("id").alias("article_id"), F.lit(-1).alias("chunk_index"), F.sha2(text, 256).alias("input_hash")).distinct()


def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    return segments.chunk_documents(table(spark, folder, "documents"), "doc_id", "text")


def criteria_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Of each article the two documents of at most 600 words in which the query's words are densest."""
    words = {w: QUERY.split().count(w) for w in QUERY.split() if w not in STOP_WORDS}
    t = documents(spark, folder).where("article_id is not null").select("doc_id", "article_id", tokenize("text").alias("t")).where(F.size("t").between(1, 600))
    count = lambda w: F.size(F.filter("t", lambda x: x == w))
    score = sum((F.lit(n) * count(w) for w, n in words.items()), F.lit(0)) / F.size("t")
    w = Window.partitionBy("article_id").orderBy(F.desc("score"), "doc_id")
    return t.select("article_id", "doc_id", F.round(score, 6).alias("score")).where("score > 0").withColumn("r", F.row_number().over(w)).where("r <= 2")


def criteria_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Of each article the two chunks of at most 600 words in which the query's words are densest, those of Methods ahead by a quarter, within 2,400 words together."""
    words = {w: QUERY.split().count(w) for w in QUERY.split() if w not in STOP_WORDS}
    d = table(spark, folder, "documents").where("article_id is not null and text is not null").select("doc_id", "article_id")
    c = segments.chunk_documents(table(spark, folder, "documents").where("article_id is not null"), "doc_id", "text").where("word_count <= 600").join(d, F.col("id") == F.col("doc_id"))
    c = c.select("article_id", "doc_id", "chunk_index", "section", "word_count", tokenize("chunk").alias("t"))
    count = lambda w: F.size(F.filter("t", lambda x: x == w))
    hits = sum((F.lit(n) * count(w) for w, n in words.items()), F.lit(0))
    score = hits / F.col("word_count") + F.when(F.col("section") == "Methods", 0.25).otherwise(0.0)
    w = Window.partitionBy("article_id").orderBy(F.desc("score"), "doc_id", "chunk_index")
    top = c.where(hits > 0).withColumn("score", F.round(score, 6)).withColumn("r", F.row_number().over(w)).where("r <= 2")
    used = F.sum("word_count").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("used", used).where("used <= 2400 or r = 1").select("article_id", "doc_id", "chunk_index", "score", "r")


def context_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Of each article the documents, in order, that fit 3,000 characters together: a running sum."""
    d = documents(spark, folder).where("article_id is not null").withColumn("n", F.length("text"))
    w = Window.partitionBy("article_id").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("used", F.sum("n").over(w)).where("used <= 3000").select("article_id", "doc_id", "used")


def html_to_text(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).where("text rlike '</?[A-Za-z]'").select("doc_id", strip_html("text").alias("plain"))


QUERIES = {
    f.__name__: f
    for f in (token_counts, bm25_search, stem_counts, containment_best, title_jaccard, title_sets, criteria_chunks, cosine_topk, max_pool_recall, mean_pool, stale_embeddings, embedding_coverage, expected_rows, chunk_documents, criteria_rank, context_budget, html_to_text)
}

SPLIT = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: w <> '')"
STOP = ", ".join(repr(w) for w in STOP_WORDS)
WORDS = ", ".join(repr(w) for w in QUERY.split() if w not in STOP_WORDS)
D = f"d as (select distinct doc_id, text, article_id from documents where text is not null), tk as (select doc_id, article_id, {SPLIT.format('text')} as t from d), po as (select doc_id, len(t) as size, token, count(*) as tf from (select doc_id, t, unnest(t) as token from tk) group by doc_id, len(t), token)"
SC = "s as (select q.vec_id as query, e.vec_id, e.label, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 4) as score from embeddings e, embeddings q where q.vec_id % 100 = 0)"
HTML = r"regexp_replace(regexp_replace(text, '(?i)</?(?:p|div|br|h[1-6]|li|tr|table)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"
for _entity, _plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&amp;", "&")):
    HTML = f"replace({HTML}, '{_entity}', '{_plain}')"
HTML = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({HTML}, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
SQL = {
    "html_to_text": f"with {D} select doc_id, {HTML} as plain from d where regexp_matches(text, '</?[A-Za-z]')",
    "token_counts": f"with {D} select token, sum(tf) as n, count(*) as n_docs from po group by 1",
    "bm25_search": f"with {D}, st as (select count(*) as docs, avg(len(t)) as av from tk where len(t) > 0), h as (select * from po where token in ({WORDS})), f as (select token, count(*) as df from h group by 1) select doc_id, round(sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), 0.000001) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / av))), 6) as score from h join f using (token), st group by 1 order by 2 desc, 1 limit 30",
    "containment_best": f"""with {D}, q as (select item_id, case when len(m) = 0 then r else m end as t from (select item_id, r, list_filter(r, lambda w: w not in ({STOP})) as m from (select item_id, {SPLIT.format('text')} as r from eval_items))),
      u as (select distinct item_id, unnest(t) as token from q), x as (select item_id, doc_id, count(*) as k from u join po using (token) group by all), b as (select item_id, first(doc_id order by k desc, doc_id) as doc_id, max(k) as k from x group by 1)
      select item_id, doc_id, round(k / len(t), 6) as score from b join q using (item_id) where k / len(t) >= 0.3""",
    "title_jaccard": f"with k as (select array_to_string(list_sort(list_distinct({SPLIT.format('title')})), ' ') as key, min(id) as id from articles group by 1), s as (select id, string_split(key, ' ') as s from k where key <> ''), p as (select x.id as a, y.id as b, round(len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))), 6) as jaccard from s x join s y on x.id < y.id) select * from p where jaccard >= 0.8",
    "cosine_topk": f"with {SC} select query, vec_id, score from (select *, row_number() over (partition by query order by score desc, vec_id) as r from s) where r <= 30",
    "max_pool_recall": f"with {SC} select query, label, max(score) as score, first(vec_id order by score desc, vec_id) as vec_id from s group by query, label",
    "title_sets": f"with t as (select distinct id, array_to_string(list_sort(list_distinct({SPLIT.format('title')})), ' ') as key from articles) select distinct id, min(id) over (partition by key) as class_id from t where key <> ''",
    "mean_pool": "with m as (select label, pos, avg(x) as m from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings) group by all) select label, pos, round(m / sqrt(sum(m * m) over (partition by label)), 6) as value from m",
    "stale_embeddings": r"select distinct article_id, chunk_index from embed_tasks t where regexp_matches(text, '\S') and not exists (select 1 from article_embeddings e where e.article_id = t.article_id and e.chunk_index = t.chunk_index and e.input_hash = sha256(t.text))",
    "embedding_coverage": "select model_name, dimensions, count(distinct article_id) as n_articles, count(distinct article_id || '#' || chunk_index) as n_vectors from article_embeddings where embedding is not null and len(embedding) = dimensions group by 1, 2",
    "expected_rows": "select distinct id as article_id, -1 as chunk_index, sha256(concat_ws(chr(10) || chr(10), trim(title), case when trim(abstract_text) <> '' then trim(abstract_text) end)) as input_hash from articles",
    "criteria_rank": f"with {D}, s as (select article_id, doc_id, round({' + '.join(f'''len(list_filter(t, lambda x: x = '{w}'))''' for w in QUERY.split() if w not in STOP_WORDS)}::double, 12) / len(t) as sc from tk where article_id is not null and len(t) between 1 and 600), r as (select article_id, doc_id, round(sc, 6) as score from s) select * from (select *, row_number() over (partition by article_id order by score desc, doc_id) as r from r where score > 0) where r <= 2",
    "context_budget": f"with {D} select article_id, doc_id, used from (select article_id, doc_id, sum(length(text)) over (partition by article_id order by doc_id rows unbounded preceding) as used from d where article_id is not null) where used <= 3000",
}

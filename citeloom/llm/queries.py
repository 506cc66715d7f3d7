"""The pN_ queries over the tables of a data folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.encodings import restore_encodings
from citeloom.llm.groups import work_groups
from citeloom.llm.keys import DOI_PREFIX
from citeloom.llm.language import wrong_labels
from citeloom.llm.leakage import leaked_items
from citeloom.llm.mixing import mixture, shares
from citeloom.llm.names import linked_names
from citeloom.llm.neighbours import similar_pairs, similar_vectors, usable_vectors
from citeloom.llm.pairs import basket_items, cooccurrence
from citeloom.llm.splitting import split_texts
from citeloom.llm.survivors import paper_survivors, surviving_links
from citeloom.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return work_groups(table(spark, folder, "reference_papers"), table(spark, folder, "articles"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar_pairs(table(spark, folder, "article_embeddings"))


def p2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five vectors most similar to each usable vector, nearest first."""
    return similar_vectors(usable_vectors(table(spark, folder, "article_embeddings"))).select("model", "key", F.posexplode("neighbours").alias("rank", "x")).select("model", "key", "rank", F.col("x.key").alias("near_key"), F.round("x.sim", 4).alias("similarity"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return surviving_links(table(spark, folder, "raw_references"), table(spark, folder, "source_trust"))


def p3_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """One surviving record for each paper, with the delivery that each field comes from."""
    found = paper_survivors(table(spark, folder, "raw_references"), table(spark, folder, "source_trust"))
    fields = ["abstract_text", "citation_count", "import_source"]
    return found.select("paper_id", *(F.col(f"{f}.value").alias(f) for f in fields), *(F.col(f"{f}.id").alias(f"{f}_link") for f in fields))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return cooccurrence(basket_items(table(spark, folder, "raw_references"))).select("field_name", "item_a", "item_b")


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs with their counts and lift."""
    return cooccurrence(basket_items(table(spark, folder, "raw_references"))).withColumn("lift", F.round("lift", 6))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return wrong_labels(table(spark, folder, "raw_references"), table(spark, folder, "lang_samples")).select("link_id", "lang")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return linked_names(table(spark, folder, "raw_references"), table(spark, folder, "openalex_authors"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_pieces(spark, folder).select("article_id", "chunk_index").distinct()


def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of the oversized tasks."""
    return split_texts(table(spark, folder, "embed_tasks"), ["article_id", "chunk_index"], "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leaked_items(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"))
    return found.where("n_windows > 0").select(F.col("id").alias("doc_id"), "item_id")


def p8_near(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a window of the size of an item, word by word or nearly, and how alike it is."""
    found = leaked_items(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"))
    return found.where("similarity > 0").select(F.col("id").alias("doc_id"), "item_id", "n_windows", F.round("containment", 6).alias("containment"), F.round("similarity", 6).alias("similarity"))


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(table(spark, folder, "documents"), table(spark, folder, "source_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares of the mixture that are reached."""
    documents, targets = table(spark, folder, "documents"), table(spark, folder, "source_targets")
    return shares(mixture(documents, targets), documents, targets)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return restore_encodings(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "lang_samples")).where("misread").select(F.col("id").alias("doc_id")).distinct()


def p10_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The misread documents with their text as it was written, as far as it can be had."""
    return restore_encodings(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "lang_samples")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p2_found, p2_neighbours, p3_found, p3_survivors, p4_found, p4_pairs, p5_found, p6_found, p7_found, p7_pieces, p8_found, p8_near, p9_mixture, p9_shares, p10_found, p10_restored)}

_BASKETS = """
with items as (
  select distinct 'keywords' as field_name, paper_id, lower(trim(item)) as item from (select paper_id, unnest(keywords) as item from raw_references)
  union select distinct 'authors', paper_id, lower(trim(item)) from (select paper_id, unnest(authors) as item from raw_references)),
entries as (select * from items where item is not null and paper_id is not null and item not in ('', 'et al.', 'et al')),
totals as (select field_name, count(distinct paper_id) as n_baskets from entries group by all),
counts as (select field_name, item, count(*) as n from entries group by all),
pairs as (
  select a.field_name, a.item as item_a, b.item as item_b, count(*) as n_together
  from entries a join entries b on a.field_name = b.field_name and a.paper_id = b.paper_id and a.item < b.item group by all having count(*) >= 5),
lifted as (
  select p.field_name, p.item_a, p.item_b, p.n_together, a.n as n_a, b.n as n_b, t.n_baskets, round(p.n_together * t.n_baskets / (a.n * b.n)::double, 6) as lift
  from pairs p join totals t using (field_name) join counts a on a.field_name = p.field_name and a.item = p.item_a join counts b on b.field_name = p.field_name and b.item = p.item_b
  where p.n_together * t.n_baskets >= 3 * a.n * b.n)
"""

_SURVIVORS = r"""
with trust as (select lower(trim(import_source)) as src, min(trust_rank) as trust_rank from source_trust where trim(import_source) <> '' group by all),
cleaned as (
  select distinct paper_id, link_id, citation_count, import_source, created_at,
    regexp_replace(trim(regexp_replace(regexp_replace(abstract_text, '</?[A-Za-z][^<>]*>|<!--.*?-->', ' ', 'g'), '[\s\x{00A0}\x{200B}\x{FEFF}]+', ' ', 'g')), '(?i)\s*(?:\[?\(?\s*truncated\s*[\])]|…|\.\.\.+)\s*$', '') as own, abstract_text
  from raw_references where paper_id is not null),
r as (
  select c.*, nullif(lower(trim(import_source)), '') as src, coalesce(t.trust_rank, 2147483647) as rnk, coalesce(created_at, timestamp '0001-01-01') as made,
    case when lower(regexp_replace(own, '^[\[(\s]+|[\])\s.!]+$', '', 'g')) in ('', '-', '--', 'n/a', 'na', 'none', 'null', 'nan', 'unknown', 'no abstract', 'no abstract available', 'abstract not available', 'abstract missing', 'abstract unavailable', 'not available', 'missing', 'tbd') then null else length(own) end as own_len
  from cleaned c left join trust t on t.src = nullif(lower(trim(import_source)), '')),
many as (select paper_id from r group by 1 having count(distinct link_id) > 1),
ranked as (
  select paper_id, 'abstract_text' as field_name, link_id, row_number() over (partition by paper_id order by own_len desc, rnk, made desc, link_id) as k from r where own_len > 0
  union all select paper_id, 'citation_count', link_id, row_number() over (partition by paper_id order by made desc, rnk, link_id) from r where citation_count >= 0
  union all select paper_id, 'import_source', link_id, row_number() over (partition by paper_id order by rnk, made desc, link_id) from r where src is not null)
"""

_VECTORS = """
with l as (
  select model_name as model, article_id || '#' || chunk_index as key, last(embedding order by written_at nulls first, input_hash nulls first) as v, last(dimensions order by written_at nulls first, input_hash nulls first) as d, last(embedding is null order by written_at nulls first, input_hash nulls first) as gone
  from article_embeddings where article_id is not null and chunk_index is not null and model_name is not null group by all),
u as (select model, key, v::double[] as v from l where not gone and len(v) = d and len(list_filter(v, lambda x: x <> 0)) > 0 and len(list_filter(v, lambda x: x is null or isnan(x))) = 0),
s as (select a.model, a.key, b.key as near_key, list_cosine_similarity(a.v, b.v) as similarity from u a join u b on a.model = b.model and a.key <> b.key),
r as (select *, row_number() over (partition by model, key order by round(similarity, 9) desc, near_key) as k from s)
"""

_PREFIX = DOI_PREFIX.replace("'", "''")
_GROUPS = rf"""
with recursive b as (select id, doi, title, true as paper from reference_papers union select id, doi, null, false from articles),
d as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url_decode(url_decode(doi)), '[\s\x{{00A0}}\x{{00AD}}\x{{200B}}-\x{{200D}}\x{{2060}}\x{{FEFF}}]+', '', 'g'), '^[<\[(\"''{{]+', ''), '{_PREFIX}', ''), '[.,;:\]\"''}}>/]+$', '') as t from b),
e as (select *, lower(case when contains(t, '(') then t else regexp_replace(t, '[)\].,;:\"''}}>/]+$', '') end) as k, regexp_replace(lower(title), '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g') as n from d),
x as (select distinct id, 'd' || k as key from e where regexp_matches(k, '^10\.\d{{2,9}}(?:\.\d+)*/\S+$') union select id, 't' || n from e where paper and strlen(n) >= 10),
h as (select id, min(id) over (partition by key) as hub from x), y as (select id as a, hub as b from h where id <> hub union select hub, id from h where id <> hub),
r(id, seen) as (select distinct a, a from y union select r.id, y.b from r join y on r.seen = y.a)
"""

SQL: dict[str, str] = {
    "p1_found": _GROUPS + "select id as record_id, min(seen) as group_id from r group by 1",
    "p2_found": _VECTORS + "select distinct least(key, near_key) as key_a, greatest(key, near_key) as key_b from r where k <= 5",
    "p2_neighbours": _VECTORS + "select model, key, k - 1 as rank, near_key, round(similarity, 4) as similarity from r where k <= 5",
    "p3_survivors": _SURVIVORS + """, v as (select r.paper_id, field_name, r.link_id, any_value(abstract_text) as own, any_value(citation_count)::varchar as citation_count, any_value(import_source) as import_source from ranked k join r on r.paper_id = k.paper_id and r.link_id = k.link_id where k = 1 group by all)
      select m.paper_id, max(own) filter (field_name = 'abstract_text') as abstract_text, max(citation_count) filter (field_name = 'citation_count') as citation_count, max(import_source) filter (field_name = 'import_source') as import_source,
      max(link_id) filter (field_name = 'abstract_text') as abstract_text_link, max(link_id) filter (field_name = 'citation_count') as citation_count_link, max(link_id) filter (field_name = 'import_source') as import_source_link from (select distinct paper_id from r) m left join v using (paper_id) group by 1""",
    "p3_found": _SURVIVORS + "select paper_id, field_name, link_id from ranked join many using (paper_id) where k = 1",
    "p7_found": "select distinct article_id, chunk_index from embed_tasks where length(text) > 4000",
    "p4_found": _BASKETS + "select field_name, item_a, item_b from lifted",
    "p4_pairs": _BASKETS + "select * from lifted",
}

"""Single fields of the library's records in all their forms: lists in one string, tags, cuts, languages, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import fields
from citeloom.functions.text import normalize_issn
from citeloom.operators.terms import deduplicated, keyed
from citeloom.tables import table

TODAY = "2025-06-30"
#: Names of the countries that the author table has codes of.
COUNTRY_NAMES = {"BR": "Brazil", "CN": "China", "DE": "Germany", "ES": "Spain", "FR": "France", "GB": "England", "IT": "Italy", "JP": "Japan", "KR": "South Korea", "PL": "Poland", "SE": "Sweden", "TR": "Turkey", "US": "USA"}


def _articles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "articles")


def authors_split(spark: SparkSession, folder: str) -> DataFrame:
    """Author lists written in one string in four ways, and read again."""
    n = F.col("sequence_id") % 4
    text = F.when(n == 0, F.to_json("authors")).when(n == 1, F.array_join("authors", "; ")).when(n == 2, F.array_join("authors", " and ")).otherwise(F.array_join("authors", "\n"))
    return _articles(spark, folder).where("size(authors) > 0").select("id", fields.split_authors(text).alias("names")).select("id", F.size("names").alias("n_names"), F.array_join("names", "|").alias("names")).distinct()


def authors_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """The names of all author strings with their display forms and keys."""
    text = F.array_join("authors", "; ")
    return _articles(spark, folder).select(F.explode(fields.parse_authors(text)).alias("x")).select("x.raw", "x.display", "x.key").distinct()


def keywords_split(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword lists written in one string, as JSON or with semicolons, and read again, counted."""
    text = F.when(F.length("id") % 2 == 0, F.to_json("keywords")).otherwise(F.array_join("keywords", "; "))
    p = table(spark, folder, "reference_papers").where("size(keywords) > 0").select("id", F.explode(fields.split_keywords(text)).alias("keyword"))
    return p.groupBy("keyword").agg(F.countDistinct("id").alias("n_papers"))


def term_forms(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "reference_papers").select(F.explode("keywords").alias("raw")).select("raw", fields.term_form("raw").alias("form")).where("raw is not null").distinct()


def term_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords by their stemmed key: how many spellings and papers each has."""
    k = table(spark, folder, "reference_papers").select("id", F.explode("keywords").alias("term"))
    return keyed(k, "term").groupBy("key").agg(F.countDistinct("term").alias("n_forms"), F.countDistinct("id").alias("n_papers"))


def terms_deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    """The keywords of each paper, the first of those with one key, in order."""
    p = table(spark, folder, "reference_papers").select("id", "keywords").distinct()
    return deduplicated(p, "id", "keywords")


def tags_sanitized(spark: SparkSession, folder: str) -> DataFrame:
    """Titles and keywords as tags, as reference managers' tags, and the tags' display names."""
    raw = table(spark, folder, "reference_papers").select(F.explode(F.concat(F.coalesce("keywords", F.array().cast("array<string>")), F.array("title"))).alias("raw")).where("raw is not null").distinct()
    raw = raw.select("raw", F.concat(F.lit("Inclusion: "), "raw").alias("marked"))
    return raw.select("raw", fields.sanitize_tag("marked").alias("tag"), fields.sanitize_item_tag("marked").alias("item_tag"), fields.tag_name(fields.sanitize_item_tag("raw")).alias("name"))


def cuts(spark: SparkSession, folder: str) -> DataFrame:
    """Abstracts cut at blanks and at words."""
    return _articles(spark, folder).where("abstract_text is not null").select("id", fields.cut_at_blank("abstract_text", 120).alias("at_blank"), fields.cut_at_word("abstract_text", 80).alias("at_word")).distinct()


def abstract_language(spark: SparkSession, folder: str) -> DataFrame:
    """Which documents are English by their stop words."""
    return table(spark, folder, "documents").where("text is not null").select("doc_id", fields.english_abstract("text").alias("english"))


def json_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """Events wrapped as programs wrap arrays, the array found again, and its values summed."""
    n = F.col("event_id") % 4
    one = F.concat(F.lit("["), "props", F.lit("]"))
    text = F.when(n == 0, one).when(n == 1, F.concat(F.lit('{"results": '), one, F.lit("}"))).when(n == 2, F.concat(F.lit('{"0": '), "props", F.lit("}"))).otherwise(F.concat(F.lit('{"other": 1, "rows": '), one, F.lit("}")))
    found = table(spark, folder, "events").select("event_type", F.from_json(fields.array_in_json(text), "array<struct<k: bigint>>").alias("a"))
    return found.groupBy("event_type").agg(F.count_if(F.size("a") == 1).alias("n_found"), F.sum(F.get("a", F.lit(0))["k"]).alias("total"))


def json_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Events whose JSON is cut off, fenced or in prose, repaired."""
    n = F.col("event_id") % 3
    text = F.when(n == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(n == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" as asked."))).otherwise(F.concat(F.lit('[{"k": 1}, '), "props", F.lit(', {"k": 5')))
    fixed = table(spark, folder, "events").where("props is not null").select("event_id", fields.repaired_json(text).alias("j"))
    return fixed.select("event_id", F.coalesce(F.get_json_object("j", "$.k"), F.get_json_object("j", "$[1].k")).cast("long").alias("k"))


def claim_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_items").select("item_id", fields.claim_key("text").alias("key"))


def year_colours(spark: SparkSession, folder: str) -> DataFrame:
    years = _articles(spark, folder).agg(F.min("publication_year").alias("first"), F.max("publication_year").alias("last"))
    return _articles(spark, folder).select("publication_year").distinct().crossJoin(F.broadcast(years)).select("publication_year", fields.year_colour(F.col("publication_year"), F.col("first"), F.col("last")).alias("colour"))  # years is one row


def record_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Type labels of raw references' types, and their authors in short."""
    r = table(spark, folder, "raw_references").select("reference_type", "authors")
    code = F.when(F.col("reference_type") == "citation", " jour").otherwise(F.upper("reference_type"))
    return r.select(fields.type_label(code).alias("label"), fields.short_authors(F.col("authors")).alias("authors")).distinct()


def term_pace(spark: SparkSession, folder: str) -> DataFrame:
    """Papers a year of each keyword over the years from its first to its last one."""
    k = table(spark, folder, "reference_papers").where("publication_year is not null").select("id", "publication_year", F.explode("keywords").alias("term")).where("term is not null").distinct()
    y = F.col("publication_year")
    return k.groupBy("term").agg(F.round(F.count("*") / (F.max(y) - F.min(y) + 1), 6).alias("per_year"))


def highlights(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the words of a search marked."""
    return table(spark, folder, "documents").where("text is not null").select("doc_id", fields.highlighted("text", "sleep quality a pressure").alias("marked")).where("marked like '%<mark>%'").select("doc_id", (F.size(F.split("marked", "<mark>")) - 1).alias("n_marks"))


def research_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """For each keyword the range of dates in which to look for its trend."""
    k = table(spark, folder, "reference_papers").where("publication_year is not null").select("id", F.col("publication_year").alias("y"), F.explode("keywords").alias("raw")).distinct()
    k = k.select("y", fields.trend_keyword("raw").alias("term")).where("term <> ''").groupBy("term", "y").agg(F.count("*").alias("n"))
    r = k.groupBy("term").agg(F.min("y").alias("first"), F.max("y").alias("last"), F.max(F.struct("n", (-F.col("y")).alias("y"))).alias("m"))
    found = fields.research_range(F.col("first"), F.col("last"), -F.col("m.y"), TODAY)
    return r.select("term", found.alias("r")).select("term", F.col("r.start").cast("string").alias("start"), F.col("r.end").cast("string").alias("end"))


def doi_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Which DOI fields are a DOI when they are searched for."""
    return table(spark, folder, "reference_papers").where("doi is not null").select("doi", fields.doi_query("doi").alias("query")).distinct()


def issn_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """ISSNs as catalogues write them, made from the digits of the papers' hashes, in one form; '' where they are none."""
    digits = F.translate(F.substring(F.md5("id"), 1, 8), "abcdef", "012345")
    n = F.ascii(F.substring("id", -1, 1)) % 3
    raw = F.when(n == 0, digits).when(n == 1, F.concat(F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 3), F.lit("x (print)"))).otherwise(F.substring(digits, 1, 6))
    return table(spark, folder, "reference_papers").select("id", normalize_issn(raw).alias("issn")).distinct()


def affiliations_parsed(spark: SparkSession, folder: str) -> DataFrame:
    """Institution, city and country of affiliation lines; each line is parsed once."""
    names = F.create_map(*(F.lit(x) for pair in COUNTRY_NAMES.items() for x in pair))
    line = F.concat_ws(", ", F.lit("Dept. of Methods"), "institution", F.lit("Springfield 12345"), names[F.col("country")])
    lines = table(spark, folder, "openalex_authors").where("institution is not null").select(line.alias("line")).distinct()
    return lines.select("line", fields.parsed_affiliation("line").alias("a")).select("line", "a.institution", "a.city", "a.country")


def queries_truncated(spark: SparkSession, folder: str) -> DataFrame:
    """Boolean queries of held-out texts within 120 bytes."""
    text = F.concat(F.lit('("'), F.array_join(F.slice(F.split("text", r"\s+"), 1, 30), '" AND "'), F.lit('")'))
    return table(spark, folder, "eval_items").where("text is not null").select("item_id", fields.truncated_query(text, 120).alias("query")).select("item_id", "query", (F.octet_length("query") <= 120).alias("fits"), (F.length(F.regexp_replace("query", '[^"]', "")) % 2 == 0).alias("quoted"))


def vectors_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors written as bytes and read again."""
    e = table(spark, folder, "embeddings").select("vec_id", "embedding", fields.vector_bytes("embedding").alias("b"))
    return e.select("vec_id", F.octet_length("b").alias("n_bytes"), (fields.bytes_vector("b") == F.col("embedding")).alias("same"))


def weighted_pool(spark: SparkSession, folder: str) -> DataFrame:
    """The mean vector of each group weighted by the vectors' place in it, at length 1; a group of one as it is."""
    from citeloom.operators.vectors import pooled

    w = F.pmod("vec_id", F.lit(7)) + 1
    return pooled(table(spark, folder, "embeddings").where("label is not null"), ["label"], "embedding", w).select("label", F.posexplode("vector").alias("pos", "value")).select("label", "pos", F.round("value", 5).alias("value"))


QUERIES = {
    f.__name__: f
    for f in (
        authors_split, authors_parsed, keywords_split, term_forms, term_keys, terms_deduplicated, tags_sanitized, cuts, abstract_language, json_arrays, json_repaired, claim_keys, year_colours, record_labels,
        term_pace, highlights, research_ranges, doi_queries, issn_normalize, affiliations_parsed, queries_truncated, vectors_packed, weighted_pool,
    )
}

from citeloom.plans.bibliometrics import KEY, PARTS  # noqa: E402
from citeloom.plans.matching import BARE, DOI  # noqa: E402

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
LABEL_CASE = " ".join(f"when '{k}' then '{v}'" for k, v in fields.TYPE_LABELS.items())
COUNTRY_CASE = " ".join(f"when '{k}' then '{v}'" for k, v in COUNTRY_NAMES.items())
CLEAN_TAG = r"regexp_replace(regexp_replace(regexp_replace(lower('inclusion: ' || raw), '^inclusion:\s*', ''), '[\s_]', '-', 'g'), '-{2,}', '-', 'g')"
ITEM_TAG = r"regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g')"
CUT = r"case when length(t) <= 35 then t else regexp_replace(left(t, 35), '-[^-]*$', '') end"
TREND = r"trim(regexp_replace(trim(regexp_replace(trim(raw), '[.,;:!?]+$', '')), '\s*[(\[][^)]*?[)\]]', '', 'g'))"
SQL = {
    "authors_split": f"""with s as (select distinct id, case when sequence_id % 4 = 0 then authors when sequence_id % 4 = 1 then string_split(array_to_string(authors, '; '), ';') when sequence_id % 4 = 2 then
      case when contains(array_to_string(authors, ' and '), ';') then string_split(array_to_string(authors, ' and '), ';') when contains(lower(array_to_string(authors, ' and ')), ' and ') then regexp_split_to_array(array_to_string(authors, ' and '), '(?i) and ') else [authors[1]] end
      else string_split(array_to_string(authors, chr(10)), chr(10)) end as n from articles where len(authors) > 0),
      t as (select id, list_filter(list_transform(n, lambda x: {STRIP.format("x")}), lambda x: x <> '') as n from s) select id, len(n) as n_names, array_to_string(n, '|') as names from t""",
    "authors_parsed": rf"with e as (select distinct {STRIP.format('raw_name')} as raw_name from (select unnest(string_split(array_to_string(authors, '; '), ';')) as raw_name from articles)), b as (select *, {KEY} as key, trim(raw_name) as t, regexp_split_to_array(trim(raw_name), '\s+') as q from (select *, {PARTS} as p from e where raw_name <> '')) select distinct raw_name as raw, case when contains(t, ',') or len(q) < 2 then t else q[-1] || ', ' || array_to_string(q[:-2], ' ') end as display, key from b",
    "keywords_split": f"with k as (select id, case when length(id) % 2 = 0 then keywords else regexp_split_to_array(array_to_string(keywords, '; '), '[;,]') end as k from reference_papers where len(keywords) > 0), u as (select id, {STRIP.format('k')} as keyword from (select id, unnest(k) as k from k)) select keyword, count(distinct id) as n_papers from u where keyword <> '' group by 1",
    "term_forms": rf"""select distinct raw, {STRIP.format(r"regexp_replace(regexp_replace(translate(regexp_replace(lower(raw), '^[\s,.;:\[\]]+|[\s,.;:\[\]]+$', '', 'g'), '-_', '  '), '[\[\]\"'']', '', 'g'), '\s+', ' ', 'g')")} as form from (select unnest(keywords) as raw from reference_papers) where raw is not null""",
    "tags_sanitized": rf"""with r as (select distinct raw from (select unnest(keywords) as raw from reference_papers union all select title from reference_papers) where raw is not null),
      t as (select raw, regexp_replace({CLEAN_TAG}, '^-+|-+$', '', 'g') as a, {ITEM_TAG.format('raw')} as b from r), u as (select raw, {CUT.replace('t)', 'a)').replace('then t', 'then a').replace('(t,', '(a,')} as tag, nullif(regexp_replace({CUT.replace('t)', 'b)').replace('then t', 'then b').replace('(t,', '(b,')}, '^-+|-+$', '', 'g'), '') as item_tag from t)
      select raw, tag, item_tag, array_to_string(list_transform(list_filter(regexp_split_to_array(item_tag, '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda w: w <> ''), lambda w: translate(left(w, 1), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || w[2:]), ' ') as name from u""",
    "cuts": rf"""with a as (select distinct id, abstract_text as t, {STRIP.format("abstract_text")} as s from articles where abstract_text is not null),
      b as (select *, regexp_extract(left(t, 120), '(?s)^(.*\s)', 1) as w, regexp_extract(left(s, 80), '(?s)^(.*\s)', 1) as v from a)
      select id, case when length(t) <= 120 then t else regexp_replace(case when w = '' then left(t, 120) else w end, '\s+$', '') || '...' end as at_blank,
      case when length(s) <= 80 then s when regexp_matches(s[81:81], '\s') then regexp_replace(left(s, 80), '\s+$', '') || '...' else regexp_replace(case when v = '' then left(s, 80) else v end, '\s+$', '') || '...' end as at_word from b""",
    "abstract_language": rf"""with d as (select doc_id, text, regexp_replace(text, '\s', '', 'g') as s, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') as w from documents where text is not null)
      select doc_id, length(s) > 0 and length(regexp_replace(s, '[\x{{0000}}-\x{{00FF}}]', '', 'g')) <= 0.9 * length(s) and len(list_filter(w, lambda x: regexp_replace(lower(x), '^[^\p{{L}}\p{{M}}\p{{N}}]+|[^\p{{L}}\p{{M}}\p{{N}}]+$', '', 'g') in ({', '.join(repr(w) for w in fields.ENGLISH)}))) >= 0.08 * len(w) as english from d""",
    "json_arrays": "select event_type, count(*) as n_found, sum((props->>'$.k')::bigint) as total from events group by 1",
    "json_repaired": "select event_id, (props->>'$.k')::bigint as k from events where props is not null",
    "claim_keys": rf"select item_id, lower(regexp_replace({STRIP.format('text')}, '\s+', ' ', 'g')) as key from eval_items",
    "year_colours": "with y as (select min(publication_year) as f, max(publication_year) as l from articles), s as (select distinct publication_year, (publication_year - f) / (l - f)::double as r from articles, y) select publication_year, case when publication_year is null then '#cbd5e1' else '#' || lpad(lower(hex(floor(86 + r * 144 + 0.5)::bigint)), 2, '0') || lpad(lower(hex(floor(180 - r * 21 + 0.5)::bigint)), 2, '0') || lpad(lower(hex(floor(233 - r * 233 + 0.5)::bigint)), 2, '0') end as colour from s",
    "record_labels": f"select distinct case upper(trim(case when reference_type = 'citation' then ' jour' else upper(reference_type) end)) {LABEL_CASE} else 'Publication' end as label, case when coalesce(len(authors), 0) = 0 then '' when len(authors) <= 3 then array_to_string(list_filter(authors, lambda x: x is not null), ', ') else authors[1] || ' et al.' end as authors from raw_references",
    "term_pace": "select term, round(count(*) / (max(y) - min(y) + 1), 6) as per_year from (select distinct id, publication_year as y, unnest(keywords) as term from reference_papers where publication_year is not null) where term is not null group by 1",
    "highlights": r"select * from (select doc_id, len(regexp_extract_all(regexp_replace(text, '<[^<>]*>', '', 'g'), '(?i)sleep|quality|pressure')) as n_marks from documents where text is not null) where n_marks > 0",
    "research_ranges": f"""with k as (select term, y, count(*) as n from (select y, {TREND} as term from (select distinct id, publication_year as y, unnest(keywords) as raw from reference_papers where publication_year is not null)) where term <> '' group by all),
      r as (select term, min(y) as f, max(y) as l, first(y order by n desc, y) as b from k group by 1)
      select term, case when f > 2001 then f || '-01-01' when b > 2001 then (case when (case when b < 2004 then 2006 else b + 2 end) > 2025 then greatest(2002, 2021) when b < 2004 then 2002 else b - 2 end) || '-01-01' else '2020-06-30' end as start,
      case when f > 2001 then least(least(2025, l) || '-12-31', '2025-06-30') when b > 2001 then least(least(case when b < 2004 then 2006 else b + 2 end, 2025) || '-12-31', '2025-06-30') else '2025-06-30' end as "end" from r""",
    "doi_queries": rf"select distinct doi, case when regexp_matches(n, '^10\.[^/\s]+/\S+$') then n end as query from (select doi, {DOI} as n from (select doi, {BARE} as d from reference_papers where doi is not null))",
    "issn_normalize": "with d as (select distinct id, translate(left(md5(id), 8), 'abcdef', '012345') as d, ascii(right(id, 1)) % 3 as n from reference_papers) select id, case n when 0 then left(d, 4) || '-' || right(d, 4) when 1 then left(d, 4) || '-' || d[5:7] || 'X' else '' end as issn from d",
    "affiliations_parsed": f"with a as (select distinct institution, case country {COUNTRY_CASE} end as c from openalex_authors where institution is not null) select concat_ws(', ', 'Dept. of Methods', institution, 'Springfield 12345', c) as line, trim(institution, ' .') as institution, 'Springfield' as city, case c when 'England' then 'United Kingdom' when 'USA' then 'United States' else c end as country from a",
    "vectors_packed": "select vec_id, 4 * len(embedding) as n_bytes, true as same from embeddings",
    "weighted_pool": "with e as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as pos, vec_id % 7 + 1 as w from embeddings where label is not null), m as (select label, pos, sum(w * x) / sum(w) as m, count(*) as n from e group by all) select label, pos, round(case when n = 1 then m else m / sqrt(sum(m * m) over (partition by label)) end, 5) as value from m",
}

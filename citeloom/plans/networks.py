"""Co-authorship, co-citation, keyword and citation networks, and what is computed on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions.fields import term_form
from citeloom.functions.text import sanitize_term, significant_words
from citeloom.operators import graph
from citeloom.operators.library import numbered
from citeloom.operators.views import article_tags, author_bridge, links
from citeloom.tables import table


def coauthor_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of authors by list position: shared articles, fractional weight 1 / pairs, the longest author list."""
    b = author_bridge(table(spark, folder, "articles")).select("article_id", "author_order", "author").distinct()
    n = b.groupBy("article_id").agg(F.count("*").alias("n")).where("n > 1")
    b = b.join(n, "article_id")
    x, y = b.toDF("article_id", "i", "x", "n"), b.select("article_id", F.col("author_order").alias("j"), F.col("author").alias("y"))
    pairs = x.join(y, "article_id").where("i < j").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "n")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight"), F.round(F.sum(2 / (F.col("n") * (F.col("n") - 1))), 3).alias("fractional"), F.max("n").alias("most_authors"))


def _cited(spark: SparkSession, folder: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(parent, paper, c) of the references of library articles whose paper has least articles or more, filtered before any pair is made; (n) articles in scope."""
    scope = table(spark, folder, "articles").where("status in ('included', 'working', 'rejected')").select(F.col("id").alias("parent")).distinct()
    refs = links(spark, folder).where("type = 1").select("parent", "paper").join(scope, "parent", "left_semi")
    counts = refs.groupBy("paper").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    return refs.join(counts, "paper"), refs.agg(F.countDistinct("parent").alias("n"))


def cocitation(spark: SparkSession, folder: str, least_citations: int = 2, least_together: int = 2) -> DataFrame:
    """(a, b, raw, cosine, jaccard, pearson) of papers that the same articles cite."""
    refs, total = _cited(spark, folder, least_citations)
    y = refs.select("parent", F.col("paper").alias("b"), F.col("c").alias("cb"))
    pairs = refs.select("parent", F.col("paper").alias("a"), F.col("c").alias("ca")).join(y, "parent").where("a < b")
    e = pairs.groupBy("a", "b").agg(F.count("*").alias("raw"), F.first("ca").alias("ca"), F.first("cb").alias("cb")).where(F.col("raw") >= least_together).crossJoin(F.broadcast(total))  # total is one row
    denominator = F.sqrt(F.col("ca").cast("double") * F.col("cb") * (F.col("n") - F.col("ca")) * (F.col("n") - F.col("cb")))
    pearson = F.when(denominator > 0, (F.col("n") * F.col("raw") - F.col("ca") * F.col("cb")) / denominator).otherwise(0.0)
    return e.select("a", "b", "raw", F.round(F.col("raw") / F.sqrt(F.col("ca").cast("double") * F.col("cb")), 3).alias("cosine"), F.round(F.col("raw") / (F.col("ca") + F.col("cb") - F.col("raw")), 3).alias("jaccard"), F.round(pearson, 3).alias("pearson"))


def cocitation_network(spark: SparkSession, folder: str) -> DataFrame:
    return cocitation(spark, folder)


def cocitation_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The ends of co-citation edges with their citations and degree."""
    e = cocitation(spark, folder)
    ends = e.select(F.col("a").alias("paper"), "raw").union(e.select("b", "raw")).groupBy("paper").agg(F.count("*").alias("degree"), F.sum("raw").alias("strength"))
    refs, _ = _cited(spark, folder, 2)
    return ends.join(refs.select("paper", "c").distinct(), "paper").select("paper", "degree", "strength", F.col("c").alias("citations"))


def cocitation_heatmap(spark: SparkSession, folder: str) -> DataFrame:
    """The symmetric matrix of the twenty most cited nodes: twenty times twenty cells by definition."""
    nodes = cocitation_nodes(spark, folder).orderBy(F.desc("citations"), "paper").limit(20).select("paper")
    e = cocitation(spark, folder).select("a", "b", "raw")
    both = e.union(e.select("b", "a", "raw")).toDF("x", "y", "raw")
    grid = nodes.toDF("x").crossJoin(F.broadcast(nodes.toDF("y")))
    return grid.join(both, ["x", "y"], "left").select("x", "y", F.coalesce("raw", F.lit(0)).alias("raw"))


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    k = table(spark, folder, "reference_papers").select("id", "publication_year", F.explode("keywords").alias("raw")).where("raw is not null")
    return k.withColumn("term", F.lower(sanitize_term("raw"))).where("term <> ''").select("id", "publication_year", "term").distinct()


def keyword_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder).groupBy("term").agg(F.countDistinct("id").alias("weight"), F.round(F.avg("publication_year"), 6).alias("avg_year"), F.min("publication_year").alias("first_year"), F.max("publication_year").alias("last_year")).where("weight >= 5")


def keyword_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of five papers or more that stand on two papers or more together."""
    t = _terms(spark, folder).select("id", "term").distinct()
    t = t.join(t.groupBy("term").agg(F.count("*").alias("n")).where("n >= 5").select("term"), "term", "left_semi")
    return t.toDF("a", "id").select("id", "a").join(t.select("id", F.col("term").alias("b")), "id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight")).where("weight >= 2")


def _citations(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst): src cites dst, both library articles; a matched paper stands for its article."""
    own = table(spark, folder, "articles").select("id").distinct()
    match = table(spark, folder, "reference_papers").where("matched_article_id is not null").select(F.col("id").alias("paper"), F.col("matched_article_id").alias("other")).distinct()
    e = links(spark, folder).join(match, "paper").select(F.when(F.col("type") == 1, F.col("parent")).otherwise(F.col("other")).alias("src"), F.when(F.col("type") == 1, F.col("other")).otherwise(F.col("parent")).alias("dst")).where("src <> dst").distinct()
    return e.join(own.toDF("src"), "src", "left_semi").join(own.toDF("dst"), "dst", "left_semi").select("src", "dst")


def citation_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _citations(spark, folder)


def _years(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "articles").groupBy("id").agg(F.max("publication_year").alias("year"))


def back_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Citations of an article that is newer than the citing one."""
    y = _years(spark, folder)
    return _citations(spark, folder).join(y.toDF("src", "sy"), "src").join(y.toDF("dst", "dy"), "dst").where("dy > sy").select("src", "dst")


def _acyclic(spark: SparkSession, folder: str) -> DataFrame:
    """The citations whose cited article is older, or of the same year with a smaller id: no cycle is left."""
    y = _years(spark, folder).where("year is not null")
    return _citations(spark, folder).join(y.toDF("src", "sy"), "src").join(y.toDF("dst", "dy"), "dst").where("dy < sy or (dy = sy and dst < src)").select("src", "dst")


def ancestry(spark: SparkSession, folder: str) -> DataFrame:
    """All that the latest article cites, directly or through others."""
    e = _acyclic(spark, folder)
    start = e.select(F.max("src").alias("start")).where("start is not null").select("start", F.col("start").alias("node"))
    return graph.closure(e, start).select("start", "node")


def progeny(spark: SparkSession, folder: str) -> DataFrame:
    """All that cite the most cited article, directly or through others."""
    e = _acyclic(spark, folder)
    top = e.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(1).select(F.col("dst").alias("start"), F.col("dst").alias("node"))
    return graph.closure(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), top).select("start", "node")


def citation_levels(spark: SparkSession, folder: str) -> DataFrame:
    return graph.levels(_acyclic(spark, folder))


def spc_weights(spark: SparkSession, folder: str) -> DataFrame:
    return graph.path_counts(_acyclic(spark, folder))


def main_path(spark: SparkSession, folder: str) -> DataFrame:
    return graph.main_path(graph.path_counts(_acyclic(spark, folder)))


def keyword_communities(spark: SparkSession, folder: str) -> DataFrame:
    e = keyword_edges(spark, folder).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("weight").cast("double").alias("weight"))
    return graph.communities(e)


def citation_network(spark: SparkSession, folder: str) -> DataFrame:
    """The edges among included articles, and faint ones to papers that no article stands for."""
    own = table(spark, folder, "articles").where("status = 'included'").select("id").distinct()
    inner = _citations(spark, folder).join(own.toDF("src"), "src", "left_semi").join(own.toDF("dst"), "dst", "left_semi").select("src", "dst", F.lit(1.0).alias("weight"), F.lit(False).alias("unmatched"))
    loose = table(spark, folder, "reference_papers").where("matched_article_id is null").select(F.col("id").alias("paper"))
    outer = links(spark, folder).join(own.toDF("parent"), "parent", "left_semi").join(loose, "paper", "left_semi")
    ends = F.when(F.col("type") == 0, F.col("paper")).otherwise(F.col("parent")).alias("src"), F.when(F.col("type") == 0, F.col("parent")).otherwise(F.col("paper")).alias("dst")
    return inner.unionByName(outer.select(*ends, F.lit(0.1).alias("weight"), F.lit(True).alias("unmatched")).distinct())


def citation_network_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """All included articles, and each paper without an article that is linked to one of them, once; a paper's counts stand for each other."""
    a = table(spark, folder, "articles").where("status = 'included'").groupBy("id").agg(F.max("publication_year").alias("year"), F.max(F.coalesce("num_cited", F.lit(0))).alias("cited")).withColumn("unmatched", F.lit(False))
    own = a.select(F.col("id").alias("parent"))
    linked = links(spark, folder).join(own, "parent", "left_semi").select(F.col("paper").alias("id"))
    p = table(spark, folder, "reference_papers").where("matched_article_id is null").groupBy("id").agg(F.max("publication_year").alias("year"), F.max(F.coalesce("reference_count", F.lit(0))).alias("cited")).join(linked, "id", "left_semi").withColumn("unmatched", F.lit(True))
    return a.unionByName(p)


def induced_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The citations between articles of a range of years and those without a year."""
    nodes = _years(spark, folder).where("year is null or year between 2005 and 2015").select("id")
    return _citations(spark, folder).join(nodes.toDF("src"), "src", "left_semi").join(nodes.toDF("dst"), "dst", "left_semi").select("src", "dst")


def keyword_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of keywords, tags and titles together: articles and papers of each, its most frequent spelling and source, its mean year by occurrence."""
    p = table(spark, folder, "reference_papers").select("id", "publication_year", F.explode("keywords").alias("raw")).withColumn("source", F.lit("metadata"))
    a = table(spark, folder, "articles").select("id", "publication_year", "title").distinct()
    tags = article_tags(spark, folder).join(a.select(F.col("id").alias("article_id"), "publication_year"), "article_id").select(F.col("article_id").alias("id"), "publication_year", F.col("tag").alias("raw"), F.lit("tags").alias("source"))
    words = a.select("id", "publication_year", F.explode(significant_words("title")).alias("raw"), F.lit("title").alias("source"))
    rows = p.unionByName(tags).unionByName(words).where("raw is not null").distinct().withColumn("term", term_form("raw")).where("term <> ''")
    spelled = rows.groupBy("term", "raw", "source").agg(F.count("*").alias("n"), F.sum("publication_year").alias("y"), F.count("publication_year").alias("ny"))
    labels = spelled.groupBy("term", "raw").agg(F.sum("n").alias("n")).groupBy("term").agg(F.min(F.struct((-F.col("n")).alias("n"), "raw"))["raw"].alias("label"))
    modes = spelled.groupBy("term", "source").agg(F.sum("n").alias("n")).groupBy("term").agg(F.min(F.struct((-F.col("n")).alias("n"), "source"))["source"].alias("source"))
    years = spelled.groupBy("term").agg(F.round(F.try_divide(F.sum("y"), F.sum("ny")), 6).alias("avg_year"))
    weight = rows.select("term", "id").distinct().groupBy("term").agg(F.count("*").alias("weight")).where("weight >= 5")
    return weight.join(labels, "term").join(modes, "term").join(years, "term")


def term_years(spark: SparkSession, folder: str) -> DataFrame:
    """How many papers carry the network's terms in each year, and whether it is the busiest."""
    t = _terms(spark, folder).where("publication_year is not null")
    shown = t.groupBy("term").agg(F.countDistinct("id").alias("n")).where("n >= 5").select("term")
    years = t.join(shown, "term", "left_semi").groupBy("publication_year").agg(F.count("*").alias("n"))
    top = years.agg(F.max(F.struct("n", (-F.col("publication_year")).alias("y"))).alias("m"))  # one row
    return years.crossJoin(F.broadcast(top)).select("publication_year", "n", (F.col("publication_year") == -F.col("m.y")).alias("busiest"))


def community_articles(spark: SparkSession, folder: str) -> DataFrame:
    """The forty most cited papers of the largest keyword community."""
    c = keyword_communities(spark, folder)
    top = c.groupBy("community").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "community").limit(1).select("community")
    terms = c.join(F.broadcast(top), "community", "left_semi").select(F.col("node").alias("term"))  # one row
    ids = _terms(spark, folder).join(terms, "term", "left_semi").select("id").distinct()
    p = table(spark, folder, "reference_papers").groupBy("id").agg(F.max("citation_count").alias("cited"), F.max("publication_year").alias("year"))
    return p.join(ids, "id", "left_semi").orderBy(F.coalesce("cited", F.lit(-1)).desc(), F.coalesce("year", F.lit(-1)).desc(), "id").limit(40)


def top_collaborators(spark: SparkSession, folder: str) -> DataFrame:
    """Each author's five collaborators with most shared articles."""
    e = coauthor_edges(spark, folder).where("a <> b")
    both = e.select("a", "b", "weight").union(e.select("b", "a", "weight")).toDF("author", "other", "weight")
    w = Window.partitionBy("author").orderBy(F.desc("weight"), "other")
    return both.withColumn("r", F.row_number().over(w)).where("r <= 5").select("author", "other", "weight", "r")


def circular_layout(spark: SparkSession, folder: str) -> DataFrame:
    """Keyword nodes on a circle, by their rank in name order."""
    n = keyword_nodes(spark, folder).select("term")
    total = n.agg(F.count("*").alias("n"))
    angle = 2 * F.pi() * F.col("place") / F.col("n")
    return numbered(n, [F.col("term").asc()], -1, "place").crossJoin(F.broadcast(total)).select("term", F.round(100 * F.cos(angle), 4).alias("x"), F.round(100 * F.sin(angle), 4).alias("y"))


QUERIES = {
    f.__name__: f
    for f in (coauthor_edges, cocitation_network, cocitation_nodes, cocitation_heatmap, keyword_nodes, keyword_edges, citation_edges, back_edges, ancestry, progeny, citation_levels, spc_weights, main_path, keyword_communities, top_collaborators, circular_layout, citation_network, citation_network_nodes, induced_edges, keyword_sources, term_years, community_articles)
}

from citeloom.plans.bibliometrics import A, B, L  # noqa: E402

CO = f"""{B}, u as (select distinct article_id, author_order, author from b), n as (select article_id, count(*) as n from u group by 1 having count(*) > 1),
co as (select least(x.author, y.author) as a, greatest(x.author, y.author) as b, count(*) as weight, round(sum(2.0 / (n * (n - 1))), 3) as fractional, max(n) as most_authors from u x join u y on x.article_id = y.article_id and x.author_order < y.author_order join n on n.article_id = x.article_id group by 1, 2)"""
CC = f"""{A}, {L}, refs as (select parent, paper from l where type = 1 and parent in (select id from a where status in ('included', 'working', 'rejected'))), c as (select paper, count(*) as c from refs group by 1 having count(*) >= 2),
t as (select count(distinct parent) as n from refs), cr as (select * from refs join c using (paper)),
cc as (select a, b, raw, round(raw / sqrt(ca::double * cb), 3) as cosine, round(raw / (ca + cb - raw), 3) as jaccard, round(case when sqrt(ca::double * cb * (n - ca) * (n - cb)) > 0 then (n * raw - ca * cb) / sqrt(ca::double * cb * (n - ca) * (n - cb)) else 0 end, 3) as pearson
from (select x.paper as a, y.paper as b, count(*) as raw, any_value(x.c) as ca, any_value(y.c) as cb from cr x join cr y on x.parent = y.parent and x.paper < y.paper group by 1, 2 having count(*) >= 2), t),
nodes as (select paper, degree, strength, c as citations from (select paper, count(*) as degree, sum(raw) as strength from (select a as paper, raw from cc union all select b, raw from cc) group by 1) join c using (paper))"""
T = r"""p as (select distinct * from reference_papers), t as (select distinct id, publication_year, term from (select id, publication_year, lower(regexp_replace(regexp_replace(regexp_replace(raw, '[\[\]\"'']', '', 'g'), '^[\s,.;:]+|[\s,.;:]+$', '', 'g'), '\s+', ' ', 'g')) as term from (select id, publication_year, unnest(keywords) as raw from p) where raw is not null) where term <> ''),
kn as (select term, count(distinct id) as weight, round(avg(publication_year), 6) as avg_year, min(publication_year) as first_year, max(publication_year) as last_year from t group by 1 having count(distinct id) >= 5),
d as (select distinct id, term from t where term in (select term from t group by 1 having count(distinct id) >= 5))"""
CE = f"""{A}, {L}, mt as (select distinct id as paper, matched_article_id as other from reference_papers where matched_article_id is not null),
ce as (select distinct src, dst from (select case when type = 1 then parent else other end as src, case when type = 1 then other else parent end as dst from l join mt using (paper)) where src <> dst and src in (select id from a) and dst in (select id from a)),
y as (select id, max(publication_year) as year from a group by 1), dag as (select src, dst from ce join y s on s.id = src join y d on d.id = dst where d.year < s.year or (d.year = s.year and dst < src))"""
SQL = {
    "coauthor_edges": f"with {CO} select * from co",
    "top_collaborators": f"with {CO}, ee as (select a as author, b as other, weight from co where a <> b union all select b, a, weight from co where a <> b) select * from (select *, row_number() over (partition by author order by weight desc, other) as r from ee) where r <= 5",
    "cocitation_network": f"with {CC} select * from cc",
    "cocitation_nodes": f"with {CC} select * from nodes",
    "cocitation_heatmap": f"with {CC}, k as (select paper from nodes order by citations desc, paper limit 20), s as (select a as x, b as y, raw from cc union all select b, a, raw from cc) select k1.paper as x, k2.paper as y, coalesce(raw, 0) as raw from k k1 cross join k k2 left join s on s.x = k1.paper and s.y = k2.paper",
    "keyword_nodes": f"with {T} select * from kn",
    "keyword_edges": f"with {T} select x.term as a, y.term as b, count(*) as weight from d x join d y on x.id = y.id and x.term < y.term group by 1, 2 having count(*) >= 2",
    "circular_layout": f"with {T} select term, round(100 * cos(2 * pi() * (row_number() over (order by term) - 1) / count(*) over ()), 4) as x, round(100 * sin(2 * pi() * (row_number() over (order by term) - 1) / count(*) over ()), 4) as y from kn",
    "citation_edges": f"with {CE} select * from ce",
    "back_edges": f"with {CE} select src, dst from ce join y s on s.id = src join y d on d.id = dst where d.year > s.year",
    "ancestry": f"with recursive {CE}, s as (select max(src) as start from dag), r as (select start, start as node from s where start is not null union select r.start, dag.dst from r join dag on dag.src = r.node) select start, node from r where node <> start",
    "progeny": f"with recursive {CE}, s as (select dst as start from dag group by 1 order by count(*) desc, 1 limit 1), r as (select start, start as node from s union select r.start, dag.src from r join dag on dag.dst = r.node) select start, node from r where node <> start",
    "citation_levels": f"with recursive {CE}, r as (select node, 0 as level from (select src as node from dag union select dst from dag) where node not in (select dst from dag) union select dag.dst, level + 1 from r join dag on dag.src = r.node) select node, max(level) as level from r group by 1",
    "spc_weights": f"""with recursive {CE}, dn as (select node, 1 as k, 0 as level from (select src as node from dag union select dst from dag) where node not in (select dst from dag) union all select dag.dst, dn.k, dn.level + 1 from dn join dag on dag.src = dn.node),
      up as (select node, 1 as k, 0 as level from (select src as node from dag union select dst from dag) where node not in (select src from dag) union all select dag.src, up.k, up.level + 1 from up join dag on dag.dst = up.node)
      select src, dst, (ns.n * nt.n)::double as weight from dag join (select node, count(*) as n from dn group by 1) ns on ns.node = src join (select node, count(*) as n from up group by 1) nt on nt.node = dst""",
}

from citeloom.functions.text import SIGNIFICANT_STOP_WORDS  # noqa: E402

FORM = r"regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(lower({}), '^[\s,.;:\[\]]+|[\s,.;:\[\]]+$', '', 'g'), '-_', '  '), '[\[\]\"'']', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
OWN = "own as (select distinct id from articles where status = 'included')"
SQL |= {
    "citation_network": f"with ce as ({SQL['citation_edges']}), {OWN} select src, dst, 1.0::double as weight, false as unmatched from ce where src in (select id from own) and dst in (select id from own) union all select distinct case when type = 0 then paper else parent end, case when type = 0 then parent else paper end, 0.1::double, true from article_links where parent in (select id from own) and paper in (select id from reference_papers where matched_article_id is null)",
    "citation_network_nodes": f"with {OWN} select id, max(publication_year) as year, max(coalesce(num_cited, 0)) as cited, false as unmatched from articles where status = 'included' group by 1 union all select id, max(publication_year), max(coalesce(reference_count, 0)), true from reference_papers where matched_article_id is null and id in (select paper from article_links where parent in (select id from own)) group by 1",
    "induced_edges": f"with ce as ({SQL['citation_edges']}), n as (select id from articles group by id having max(publication_year) is null or max(publication_year) between 2005 and 2015) select * from ce where src in (select id from n) and dst in (select id from n)",
    "keyword_sources": rf"""with t as (select distinct article_id, tag from (select matched_article_id as article_id, lower(trim(unnest(keywords))) as tag from reference_papers where matched_article_id is not null) where tag <> ''), a as (select distinct id, publication_year, title from articles),
      r as (select id, publication_year, unnest(keywords) as raw, 'metadata' as source from reference_papers union select article_id, publication_year, tag, 'tags' from t join a on a.id = article_id
        union select id, publication_year, unnest(list_filter(regexp_split_to_array(lower(title), '[^\p{{L}}\p{{N}}]+'), lambda w: strlen(w) >= 4 and w not in ({', '.join(repr(x) for x in SIGNIFICANT_STOP_WORDS)}))), 'title' from a),
      k as (select *, {FORM.format('raw')} as term from r where raw is not null), s as (select * from k where term <> ''),
      l as (select term, first(raw order by n desc, raw) as label from (select term, raw, count(*) as n from s group by all) group by 1), m as (select term, first(source order by n desc, source) as source from (select term, source, count(*) as n from s group by all) group by 1)
      select term, count(distinct id) as weight, any_value(label) as label, any_value(m.source) as source, round(avg(publication_year), 6) as avg_year from s join l using (term) join m using (term) group by 1 having count(distinct id) >= 5""",
    "term_years": r"""with k as (select distinct id, publication_year, lower(regexp_replace(regexp_replace(regexp_replace(raw, '[\[\]\"'']', '', 'g'), '^[\s,.;:]+|[\s,.;:]+$', '', 'g'), '\s+', ' ', 'g')) as term from (select id, publication_year, unnest(keywords) as raw from reference_papers) where raw is not null), t as (select * from k where term <> '' and publication_year is not null),
      y as (select publication_year, count(*) as n from t where term in (select term from t group by 1 having count(distinct id) >= 5) group by 1) select publication_year, n, publication_year = (select publication_year from y order by n desc, publication_year limit 1) as busiest from y""",
}
SQL["main_path"] = f"with recursive w as ({SQL['spc_weights']}), b as (select src, dst, weight from (select *, row_number() over (partition by src order by weight desc, dst) as r from w where weight > 0) where r = 1), m(src, dst, weight) as (select src, dst, weight from b where src not in (select dst from w) union select b.src, b.dst, b.weight from m join b on b.src = m.dst) select * from m"

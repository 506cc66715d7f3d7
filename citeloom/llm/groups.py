"""Pairwise matches joined into groups: minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.keys import doi_key, title_key
from citeloom.session import cut, is_empty

#: Pointer jumps in a round: each doubles the length of the chains that a round shortens.
JUMPS = 2


def key_links(records: DataFrame, record: str, key: Column | str) -> DataFrame:
    """Links (a, b), b < a, from each record to the smallest record of its key: as many links as records, never all pairs of a key.

    The smallest record is a partial aggregate, so a key that holds a third of all rows costs no task more than its share; the join back
    on such a key is split by adaptive execution. Null keys link nothing.
    """
    keyed = records.select(F.col(record).alias("a"), (F.col(key) if isinstance(key, str) else key).alias("k")).where("a is not null and k is not null").withColumn("k", F.unhex(F.md5("k")))
    least = keyed.groupBy("k").agg(F.min("a").alias("b"), F.max("a").alias("z")).where("b < z").drop("z")
    return keyed.join(least, "k").where("b < a").select("a", "b")


def connected_groups(links: DataFrame) -> DataFrame:
    """(record, group) for every record of links(a, b), group the smallest record joined with it directly or by a chain.

    In each round every record takes the smallest label among itself and its neighbours, labels are followed JUMPS times, and the links
    are rewritten between labels; links within a label vanish. Records and links are checkpointed each round, until no link is left, so
    that a chain of any length needs logarithmically many rounds. Null ends, loops and repeated links change nothing; an empty table
    gives an empty one; ids of any orderable type.
    """
    both = links.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a is not null and b is not null and a <> b")
    links = cut(both.distinct())
    found = None
    while not is_empty(links):
        ends = links.select(F.col("a").alias("v"), F.col("b").alias("u")).union(links.select(F.col("b").alias("v"), F.col("b").alias("u")))
        label = cut(ends.groupBy("v").agg(F.min("u").alias("l")))  # the smaller end of a link never takes the larger one's label
        for _ in range(JUMPS):
            label = label.alias("x").join(label.select(F.col("v").alias("l"), F.col("l").alias("ll")).alias("y"), "l", "left").select("v", F.coalesce("ll", "l").alias("l"))
        label = cut(label)
        found = label if found is None else cut(found.join(label.select(F.col("v").alias("l"), F.col("l").alias("n")), "l", "left").select("v", F.coalesce("n", "l").alias("l")).union(label.join(found, "v", "left_anti").select("v", "l")))
        to = lambda side, name: label.select(F.col("v").alias(side), F.col("l").alias(name))  # noqa: E731, B023
        moved = links.join(to("a", "x"), "a").join(to("b", "y"), "b")
        links = cut(moved.where("x <> y").select(F.least("x", "y").alias("b"), F.greatest("x", "y").alias("a")).distinct())
    if found is None:
        found = links.select(F.col("a").alias("v"), F.col("b").alias("l"))
    return found.select(F.col("v").alias("record"), F.col("l").alias("group"))


def work_groups(papers: DataFrame, articles: DataFrame) -> DataFrame:
    """(record_id, group_id) of reference papers and articles of one work: equal DOI keys, or equal title keys among papers.

    Only groups of two or more records come out. Null or placeholder DOIs and titles under ten bytes match nothing; a null id is no record.
    """
    p = papers.select(F.col("id"), doi_key("doi").alias("doi"), title_key("title").alias("title"))
    a = articles.select(F.col("id"), doi_key("doi").alias("doi"))
    links = key_links(p.select("id", "doi").union(a), "id", "doi").union(key_links(p, "id", "title"))
    return connected_groups(links).select(F.col("record").alias("record_id"), F.col("group").alias("group_id"))

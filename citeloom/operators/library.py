"""Operators on the library's tables: keys matched by tiers, identities kept on insert, numbers in order, rankings united, sets changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import normalize_issn, normalize_journal
from citeloom.session import cut

#: Ways in which a journal is matched, the surest first: which number of the record meets which of the index, then the name.
JOURNAL_TIERS = (("issn", "issn"), ("issn", "eissn"), ("eissn", "eissn"), ("eissn", "issn"), ("name", "name"))


def match_journals(records: DataFrame, index: DataFrame) -> DataFrame:
    """(id, tier, journal_id) of records(id, issn, eissn, journal): the first tier at which index(journal_id, title, issn, eissn) has a match, the smallest journal_id there.

    One equi-join for all tiers; the index has one row a key before it.
    """
    forms = {"issn": normalize_issn("issn"), "eissn": normalize_issn("eissn")}
    keys = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in {**forms, "name": normalize_journal("title")}.items()))
    known = index.select("journal_id", F.explode(keys).alias("x")).select("journal_id", "x.kind", "x.value").where("value <> ''").groupBy("kind", "value").agg(F.min("journal_id").alias("journal_id"))
    own = {**forms, "name": normalize_journal("journal")}
    asked = F.array(*(F.struct(F.lit(i).alias("tier"), F.lit(kind).alias("kind"), own[mine].alias("value")) for i, (mine, kind) in enumerate(JOURNAL_TIERS, 1)))
    wanted = records.select("id", F.explode(asked).alias("x")).select("id", "x.tier", "x.kind", "x.value").where("value <> ''")
    return wanted.join(known, ["kind", "value"]).groupBy("id").agg(F.min(F.struct("tier", "journal_id")).alias("m")).select("id", "m.tier", "m.journal_id")


def search_journals(index: DataFrame, query: str, most: int = 25) -> DataFrame:
    """The journals that a search finds: by number, else by whole title, else by part of it from four characters on; the shortest titles first."""
    text = query.strip()
    number = normalize_issn(F.lit(text))
    tier = F.when((number != "") & ((F.col("issn") == number) | (F.col("eissn") == number)), 1).when(F.lower(F.trim("title")) == text.lower(), 2)
    if len(text) >= 4:
        tier = tier.when(F.lower("title").contains(text.lower()), 3)
    found = index.withColumn("tier", tier).where("tier is not null")
    best = found.agg(F.min("tier").alias("tier"))  # one row
    return found.join(F.broadcast(best), "tier", "left_semi").orderBy(F.length("title"), "title").limit(most)


def identify(existing: DataFrame, incoming: DataFrame, keys: Sequence[Column], new_id: str) -> DataFrame:
    """(new_id, id, found): the existing record of each incoming one by the first of keys that names one, else the smallest incoming record of the same first key, which is new.

    keys are expressions on the columns that both have; a null key names nothing.
    """
    kinds = F.array(*(F.struct(F.lit(i).alias("k"), key.alias("v")) for i, key in enumerate(keys)))
    known = existing.select("id", F.explode(kinds).alias("x")).select("id", "x.k", "x.v").where("v is not null").groupBy("k", "v").agg(F.min("id").alias("id"))
    asked = incoming.select(new_id, F.explode(kinds).alias("x")).select(new_id, "x.k", "x.v").where("v is not null").distinct()
    hits = asked.join(known, ["k", "v"]).groupBy(new_id).agg(F.min(F.struct("k", "id")).alias("m")).select(new_id, F.col("m.id").alias("hit"))
    first = asked.groupBy(new_id).agg(F.min(F.struct("k", "v")).alias("f"))
    home = first.join(hits, new_id, "left_anti").groupBy("f").agg(F.min(new_id).alias("home"))
    return first.join(hits, new_id, "left").join(home, "f", "left").select(new_id, F.coalesce("hit", "home").alias("id"), F.col("hit").isNotNull().alias("found"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """existing with the incoming rows put in: a row of a known key replaces it, the last by order of several; others are added. Both have the same columns."""
    rest = [c for c in existing.columns if c not in keys]
    last = incoming.groupBy(*keys).agg(F.max(F.struct(order, *(c for c in rest if c != order))).alias("m")).select(*keys, *(F.col(f"m.`{c}`").alias(c) for c in rest))
    return existing.join(last.select(*keys), list(keys), "left_anti").select(*keys, *rest).unionByName(last)


def numbered(rows: DataFrame, order: Sequence[Column], after: int = 0, name: str = "sequence_id") -> DataFrame:
    """rows with numbers from after + 1 on in an order: sorted by ranges, numbered within them, and raised by the sizes of the ranges before. No task holds more than a range."""
    parts = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    within = parts.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a range
    return within.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, F.col("_before") + F.col("_n") + after).drop("_part", "_n", "_before")


def finalists(first: DataFrame, second: DataFrame, group: str, item: str, score: str, n_first: int = 15, n_second: int = 5, most: int = 20) -> DataFrame:
    """(group, item, rank): of each group the best of one ranking, then those of another that are not among them, most in all; ties to the smaller item."""
    w = Window.partitionBy(group).orderBy(F.desc(score), item)
    top = lambda df, n, o: df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select(group, item, F.struct(F.lit(o).alias("o"), "r").alias("place"))
    both = top(first, n_first, 0).unionByName(top(second, n_second, 1)).groupBy(group, item).agg(F.min("place").alias("place"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("place"))).where(F.col("rank") <= most).select(group, item, "rank")


def merged_tags(links: DataFrame, owner: str, tag: str, old: str, new: str) -> DataFrame:
    """links with one tag merged into another, collisions once."""
    return links.select(owner, F.when(F.col(tag) == old, new).otherwise(F.col(tag)).alias(tag)).distinct()


def fills_capacity(sizes: Column, budget: int) -> Column:
    """Of an array of sizes which items a pass in order takes: each that still fits what is left of a budget."""

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + x <= budget
        return F.struct((s["used"] + F.when(fits, x).otherwise(0)).alias("used"), F.array_append(s["taken"], fits).alias("taken"))

    return F.aggregate(sizes, F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("taken")), step, lambda s: s["taken"])

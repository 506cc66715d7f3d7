"""Matching and deduplication of library records: tiered matches, blocked pair comparison, greedy resolution."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.distance import close_pairs, listed_pairs
from citeloom.functions.identifiers import normalize_doi
from citeloom.functions.text import last_name, normalize_title, short_title
from citeloom.operators.blocks import block_pairs
from citeloom.operators.graph import blocks_of_pairs
from citeloom.session import cut, is_empty, spread

#: Titles of one block; pairs of titles up to which a pair of blocks is compared along with others; pairs of one step.
BLOCK, SMALL, STEP = 4096, 16384, 262144
#: The likeness from which titles of one year are an exact duplicate.
EXACT = 0.95


def prepared(rows: DataFrame) -> DataFrame:
    """(id, several, doi, title, year, author, short) of articles: the keys that pairs are compared on, each once; several where an id has more than one of them."""
    keys = F.struct(normalize_doi("doi").alias("doi"), normalize_title("title").alias("title"), F.col("publication_year").alias("year"), last_name(F.get("authors", F.lit(0))).alias("author"), short_title("title").alias("short"))
    return rows.groupBy("id").agg(F.collect_set(keys).alias("keys")).select("id", (F.size("keys") > 1).alias("several"), F.inline("keys"))


def similarity(a: str, b: str, least: float) -> Column:
    """1 - distance / longer length where that is least or more, else a value below; the distance stops at what least allows."""
    longest = F.greatest(F.length(a), F.length(b))
    most = F.floor((1 - least) * longest + 1e-9).cast("int")
    distance = F.call_function("levenshtein", F.col(a), F.col(b), most)
    return F.when(longest == 0, 1.0).when(distance < 0, 0.0).otherwise(1 - distance / longest)


def members(i: np.ndarray, j: np.ndarray, d: np.ndarray, x: np.ndarray, y: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of rows for pairs of titles, where x and y have the title of each row; with same those of one title too."""
    (ox, nx), (oy, ny) = ((np.argsort(t, kind="stable"), np.bincount(t)) for t in (x, y))
    if same:
        more = np.flatnonzero(nx > 1)
        i, j, d = (np.concatenate(v) for v in ((i, more), (j, more), (d, np.zeros(len(more), d.dtype))))
    bx, by = np.cumsum(nx) - nx, np.cumsum(ny) - ny
    n = nx[i] * ny[j]
    ends = np.cumsum(n)
    start = 0
    while start < len(i):
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + STEP, "right")))
        k = np.repeat(np.arange(start, stop), n[start:stop])
        off = np.arange(len(k)) - (ends[k] - n[k] - done)
        p, q = bx[i[k]] + off // ny[j[k]], by[j[k]] + off % ny[j[k]]
        once = (i[k] != j[k]) | (p < q) if same else np.ones(len(k), bool)
        yield ox[p[once]], oy[q[once]], d[k[once]]
        start = stop


def alike(rows: DataFrame, part: str, least: float, apart: Sequence[str] = ()) -> DataFrame:
    """(a, b, score), a < b: the rows(id, title) of one part whose titles are least alike or more, but those that are equal in one of the columns apart.

    Blocks of titles meet in pairs, each title once; small blocks are compared many at a time. Distances over a band are left to Spark.
    """
    schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("longest", pa.int32()), ("distance", pa.int32()), ("title_a", pa.string()), ("title_b", pa.string())])

    def table(sides: list[dict[str, pa.Array]], i: np.ndarray, j: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = [pa.array(i), pa.array(j)]
        for column in apart:
            values = [s[column].take(k) for s, k in zip(sides, at, strict=True)]
            differ = pc.or_(pc.equal(values[0], ""), pc.not_equal(*values)).to_numpy(zero_copy_only=False)
            at, d = [k.filter(pa.array(differ)) for k in at], d[differ]
        open_ = pa.array(d < 0)
        titles = [s["title"].take(k) for s, k in zip(sides, at, strict=True)]
        longest = pc.max_element_wise(*(pc.utf8_length(t) for t in titles))
        ids = [s["id"].take(k) for s, k in zip(sides, at, strict=True)]
        yield from pa.Table.from_arrays([*ids, longest, pa.array(d.astype("int32")), *(pc.if_else(open_, t, None) for t in titles)], schema=schema).to_batches(65536)

    def listed(pool: list[tuple[list[dict[str, pa.Array]], bool]]) -> Iterator[pa.RecordBatch]:
        sides = [{c: pa.concat_arrays([p[0][k][c] for p in pool]) for c in ("id", "title", *apart)} for k in (0, 1)]
        i, j, x, y = [], [], 0, 0
        for (left, right), same in pool:
            n, m = len(left["id"]), len(right["id"])
            a, b = np.triu_indices(n, 1) if same else np.divmod(np.arange(n * m), m)
            i.append(a + x)
            j.append(b + y)
            x, y = x + n, y + m
        yield from table(sides, *listed_pairs(*(s["title"].to_pylist() for s in sides), np.concatenate(i), np.concatenate(j), least))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pool, pairs = [], 0
            for row in range(batch.num_rows):
                sides = [{c: batch.column(f"{side}_{c}")[row].values for c in ("id", "title", *apart)} for side in "xy"]
                same, size = batch.column("same")[row].as_py(), len(sides[0]["id"]) * len(sides[1]["id"])
                if size <= SMALL:
                    pool.append((sides, same))
                    pairs += size
                    if pairs > STEP:
                        yield from listed(pool)
                        pool, pairs = [], 0
                    continue
                x, y = (s["title"].dictionary_encode() for s in sides)
                of = [t.indices.to_numpy() for t in (x, y)]
                for found in close_pairs(x.dictionary.to_pylist(), y.dictionary.to_pylist(), least, same):
                    for some in members(*found, *of, False):
                        yield from table(sides, *some)
                if same:
                    none = np.zeros(0, np.int64)
                    for some in members(none, none, none, *of, True):
                        yield from table(sides, *some)
            if pool:
                yield from listed(pool)

    # equal titles stand in one block; lists hold no nulls, so that what is missing is empty
    known = (F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(c) for c in apart)
    met = block_pairs(rows.where(F.col(part).isNotNull()).select("id", "title", F.col(part).alias("part"), *known), ["part"], F.col("title"), BLOCK, ["id", "title", *apart])
    found = met.mapInArrow(work, "a string, b string, longest int, distance int, title_a string, title_b string")
    score = F.when(F.col("distance") < 0, similarity("title_a", "title_b", least)).when(F.col("longest") == 0, 1.0).otherwise(1 - F.col("distance") / F.col("longest"))
    return found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), score.alias("score")).where(F.col("score") >= least)


def doi_pairs(keys: DataFrame) -> DataFrame:
    """(a, b), a < b: the prepared records of one DOI."""
    x, y = (keys.select(*(F.col(c).alias(f"{c}_{side}") for c in ("id", "doi"))) for side in "xy")
    return x.join(y, (F.col("doi_x") == F.col("doi_y")) & (F.col("id_x") < F.col("id_y"))).select(F.col("id_x").alias("a"), F.col("id_y").alias("b"))


def duplicate_pairs(rows: DataFrame) -> DataFrame:
    """(a, b, kind, score), a < b: equal DOIs; else titles of one year EXACT alike (exact) or 0.7 alike (fuzzy); else of one first author 0.8 alike (fuzzy).

    No pair outside a DOI, year or author is compared. A pair comes from the first of these alone, so that pairs are shuffled only
    where an id has several rows of keys.
    """
    r = cut(prepared(rows))
    by_doi = doi_pairs(r).select("a", "b", F.lit(1).alias("tier"), F.lit(1.0).alias("score"))
    long = r.where("not short")
    by_year = alike(long, "year", 0.7, ["doi"]).select("a", "b", F.when(F.col("score") >= EXACT, 2).otherwise(3).alias("tier"), "score")
    by_author = alike(long.where("author <> ''"), "author", 0.8, ["doi", "year"]).select("a", "b", F.lit(4).alias("tier"), "score")
    best = by_doi.union(by_year).union(by_author)
    if not is_empty(r.where("several")):
        best = best.groupBy("a", "b").agg(F.min(F.struct("tier", "score")).alias("m")).select("a", "b", "m.*")
    return best.select("a", "b", F.when(F.col("tier") <= 2, "exact").otherwise("fuzzy").alias("kind"), F.round("score", 6).alias("score"))


def exact_pairs(rows: DataFrame) -> DataFrame:
    """(a, b) of the exact ones among duplicate_pairs: titles need no comparison below EXACT, nor within an author."""
    r = cut(prepared(rows))
    pairs = doi_pairs(r).union(alike(r.where("not short"), "year", EXACT, ["doi"]).select("a", "b"))
    return pairs if is_empty(r.where("several")) else pairs.distinct()


def open_pairs(pairs: DataFrame) -> DataFrame:
    """Of pairs(a, b, kind, score) those that the greedy pass may look at, solid where b cannot leave: a record's partners up to the first solid one, which it takes at the latest."""
    leaving = pairs.where("kind = 'exact'").select("b").distinct().withColumn("_leaves", F.lit(True))
    p = pairs.join(leaving, "b", "left").withColumn("solid", F.col("_leaves").isNull())
    w = Window.partitionBy("a").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    return p.withColumn("_before", F.coalesce(F.max("solid").over(w), F.lit(False))).where("not _before").select("a", "b", "kind", "score", "solid")


def kept_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs(a, b, kind, score), a < b, that a pass in id order keeps, replayed among the records that pairs with a partner that may leave connect; other records take their first partner.

    No record stands in two such blocks, so that one pass over all blocks of a partition keeps what a pass over each would.
    """
    p = cut(open_pairs(cut(pairs)))
    blocks = blocks_of_pairs(p.where("not solid")).withColumnRenamed("node", "a")
    columns = ["a", "b", "kind", "score"]
    open_ = spread(p.join(blocks, "a").select("block", *columns), "block").sortWithinPartitions("a", "b").select(*columns)
    return open_.mapInPandas(greedy_pass, "a string, b string, kind string, score double").unionByName(p.join(blocks, "a", "left_anti").select(*columns))


def greedy_pass(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs, in the order of a and b, that a pass keeps: each record takes its first partner that is left; an exact partner leaves."""
    gone: set[str] = set()
    done = None
    for pairs in parts:
        kept = []
        for row, (a, b, kind) in enumerate(zip(pairs["a"], pairs["b"], pairs["kind"], strict=True)):
            if a == done or a in gone or b in gone:
                continue
            kept.append(row)
            done = a
            if kind == "exact":
                gone.add(b)
        yield pairs.iloc[kept]


def greedy_groups(pairs: pd.DataFrame) -> pd.DataFrame:
    """The pairs that a pass over all of these keeps, in any order."""
    return next(greedy_pass(iter([pairs[["a", "b", "kind", "score"]].sort_values(["a", "b"])]))).reset_index(drop=True)


def tiered_match(papers: DataFrame, articles: DataFrame) -> DataFrame:
    """(id, article_id, tier) of papers: by DOI, else by the one title tier that their journal and year allow; the smallest article wins.

    Each tier is one equi-join with an aggregate of the smallest article for a key; no paper is compared with more than two keys.
    """
    key = lambda *c: F.concat_ws("\x01", *c)
    journal = F.lower(F.trim("journal"))
    shape = lambda df: df.select("id", normalize_doi("doi").alias("doi"), normalize_title("title").alias("title"), F.when(journal != "", journal).alias("journal"), F.col("publication_year").cast("string").alias("year"))
    p, a = shape(papers).distinct(), shape(articles).distinct()
    tiers = {"title_journal_year": ("title", "journal", "year"), "title_journal": ("title", "journal"), "title_year": ("title", "year"), "title": ("title",)}
    keys = [F.struct(F.lit("doi").alias("tier"), F.col("doi").alias("key"))] + [F.struct(F.lit(t).alias("tier"), F.when(sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0)) == 0, key(*cols)).alias("key")) for t, cols in tiers.items()]
    index = a.select("id", F.explode(F.array(*keys)).alias("x")).select("id", "x.tier", "x.key").where("key is not null and key <> ''").groupBy("tier", "key").agg(F.min("id").alias("article_id"))
    has_j, has_y = F.col("journal").isNotNull(), F.col("year").isNotNull()
    tier = F.when(has_j & has_y, "title_journal_year").when(has_j, "title_journal").when(has_y, "title_year").otherwise("title")
    cols = F.when(has_j & has_y, key("title", "journal", "year")).when(has_j, key("title", "journal")).when(has_y, key("title", "year")).otherwise(F.col("title"))
    asked = p.select("id", F.explode(F.array(F.struct(F.lit("doi").alias("tier"), F.col("doi").alias("key"), F.lit(0).alias("o")), F.struct(tier.alias("tier"), cols.alias("key"), F.lit(1).alias("o")))).alias("x")).select("id", "x.tier", "x.key", "x.o").where("key is not null and key <> ''")
    hits = asked.join(index, ["tier", "key"]).groupBy("id").agg(F.min(F.struct("o", "tier", "article_id")).alias("m"))
    return hits.select("id", "m.article_id", "m.tier")

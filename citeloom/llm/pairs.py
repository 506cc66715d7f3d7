"""Items that stand in the same baskets: heavy-light counting of pairs, with lift."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.cleaning import trimmed_lower
from citeloom.session import cut

#: Items of the dense bit matrix: the most frequent ones. A matrix of a batch of BATCH baskets takes HEAVY * BATCH / 8 bytes.
HEAVY, BATCH = 1024, 8192


def count_pairs(baskets: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From baskets, arrays of distinct item numbers with the heavy ones below HEAVY, counts (a, b, n) with a < b, combined for each batch.

    Pairs of two heavy items: popcounts of the AND of their rows of a bit matrix. Heavy with light: the light item's list of baskets is
    probed in that matrix. Two light items: hash-counted.
    """
    for batch in baskets:
        lists = [np.asarray(x, dtype=np.int64) for x in batch["items"]]
        if not lists:
            continue
        size = np.fromiter((len(x) for x in lists), np.int64, len(lists))
        where, item = np.repeat(np.arange(len(lists)), size), np.concatenate(lists)
        heavy = item < HEAVY
        found = []
        used, column = np.unique(item[heavy], return_inverse=True)
        dense = np.zeros((len(used), len(lists)), dtype=np.uint8)
        dense[column, where[heavy]] = 1
        bits = np.packbits(dense, axis=1)
        for i in range(len(used) - 1):
            n = np.bitwise_count(bits[i + 1 :] & bits[i]).sum(axis=1, dtype=np.int64)
            j = np.flatnonzero(n)
            found.append((np.full(len(j), used[i]), used[i + 1 :][j], n[j]))
        light, at = item[~heavy], where[~heavy]
        for lo in range(0, len(light), 4096):
            row, mate = np.nonzero(dense[:, at[lo : lo + 4096]].T)
            found.append((used[mate], light[lo : lo + 4096][row], np.ones(len(row), np.int64)))
        order = np.lexsort((light, at))
        light, at = light[order], at[order]
        step = 1
        while step < len(light):
            same = at[step:] == at[:-step]
            if not same.any():
                break
            found.append((light[:-step][same], light[step:][same], np.ones(int(same.sum()), np.int64)))
            step += 1
        if found:
            a, b, n = (np.concatenate(x) for x in zip(*found, strict=True))
            key, back = np.unique(np.stack([a, b], axis=1), axis=0, return_inverse=True) if len(a) else (np.zeros((0, 2), np.int64), a)
            yield pd.DataFrame({"a": key[:, 0], "b": key[:, 1], "n": np.bincount(back.ravel(), n, len(key)).astype(np.int64)})


def cooccurrence(items: DataFrame, min_together: int = 5, min_lift: float = 3.0) -> DataFrame:
    """(field_name, item_a, item_b, n_together, n_a, n_b, n_baskets, lift), item_a < item_b, of items(field_name, basket, item).

    Pairs in at least min_together baskets and at least min_lift times as many as their frequencies make expect among the field's
    baskets. A basket is a set: repeats count once; a row with a null counts nothing. Items rarer than min_together can be in no such
    pair and leave before pairs are made, which loses nothing.
    """
    entries = cut(items.select("field_name", "basket", "item").where("field_name is not null and basket is not null and item is not null").distinct())
    totals = entries.groupBy("field_name").agg(F.countDistinct("basket").alias("n_baskets"))
    counts = entries.groupBy("field_name", "item").agg(F.count("*").alias("n")).where(F.col("n") >= min_together)
    heaviest = counts.orderBy(F.desc("n"), "field_name", "item").limit(HEAVY)
    numbered = heaviest.selectExpr("field_name", "item", "n", "cast(row_number() over (order by n desc, field_name, item) - 1 as bigint) as id")
    light = counts.join(heaviest, ["field_name", "item"], "left_anti").select("field_name", "item", "n", (F.monotonically_increasing_id() + HEAVY).alias("id"))
    numbers = cut(numbered.union(light))
    baskets = entries.join(numbers.select("field_name", "item", "id"), ["field_name", "item"]).groupBy("field_name", "basket").agg(F.collect_list("id").alias("items")).where(F.size("items") > 1)
    pairs = baskets.select("items").mapInPandas(count_pairs, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n_together")).where(F.col("n_together") >= min_together)
    side = lambda x: numbers.select(F.col("id").alias(x), F.col("field_name").alias(f"f_{x}"), F.col("item").alias(f"item_{x}"), F.col("n").alias(f"n_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("field_name", F.col("f_a")).join(F.broadcast(totals), "field_name")
    lift = F.col("n_together") * F.col("n_baskets") / (F.col("n_a") * F.col("n_b"))
    flip = F.col("item_a") > F.col("item_b")
    pick = lambda yes, no: F.when(flip, F.col(yes)).otherwise(F.col(no))
    kept = joined.where(F.col("n_together") * F.col("n_baskets") >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
    return kept.select("field_name", F.least("item_a", "item_b").alias("item_a"), F.greatest("item_a", "item_b").alias("item_b"), "n_together", pick("n_b", "n_a").alias("n_a"), pick("n_a", "n_b").alias("n_b"), "n_baskets", lift.alias("lift"))


def basket_items(references: DataFrame) -> DataFrame:
    """(field_name, basket, item) of raw references: keywords and authors, in lower case without outer blanks; 'et al.' and blanks are none."""
    both = F.explode(F.array(F.struct(F.lit("keywords").alias("field_name"), F.col("keywords").alias("list")), F.struct(F.lit("authors").alias("field_name"), F.col("authors").alias("list"))))
    split = references.select(F.col("paper_id").alias("basket"), both.alias("x")).select("basket", "x.field_name", F.explode("x.list").alias("raw"))
    return split.select("field_name", "basket", trimmed_lower("raw").alias("item")).where("item is not null and item not in ('et al.', 'et al')")

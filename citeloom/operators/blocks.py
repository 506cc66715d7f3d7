"""Rows that meet in pairs of blocks: for comparisons of all with all in a part, where a matrix product tells most pairs apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.session import spread


def block_pairs(rows: DataFrame, part: list[str], place: Column, size: int, columns: list[str], most: int | None = None, largest: int = 131072) -> DataFrame:
    """(part, same, x_<column>, y_<column> arrays) of all pairs of blocks of each part, a block with itself once (same).

    Blocks are dealt out by the hash of place, so that equal places stand in one block; a block has about size rows,
    more (to largest) where a part would have over most blocks. Rows are sent
    once for each block of their part, never once for each pair of rows.
    """
    r = rows.select(*part, *columns, F.xxhash64(place).alias("_place"))
    count = F.ceil(F.count("*") / size)
    count = F.greatest(F.least(count, F.lit(most)), F.ceil(F.count("*") / largest)) if most else count
    n = r.groupBy(*part).agg(count.cast("int").alias("_n"), F.count("*").alias("_rows")).where("_rows > 1").drop("_rows")
    r = r.join(n, part).withColumn("_no", F.pmod(F.xxhash64("_place"), F.col("_n")).cast("int"))
    blocks = r.groupBy(*part, "_no").agg(F.max("_n").alias("_n"), *(F.collect_list(c).alias(c) for c in columns))
    side = lambda name, i, j, to: blocks.select(*part, F.col("_no").alias(i), F.explode(to).alias(j), *(F.col(c).alias(f"{name}_{c}") for c in columns))
    keys = [*part, "_i", "_j"]
    x = side("x", "_i", "_j", F.sequence(F.col("_no"), F.col("_n") - 1))
    y = side("y", "_j", "_i", F.sequence(F.lit(0), F.col("_no")))
    same = F.col("_i") == F.col("_j")
    # both sides are gathered apart, in any order
    right = (F.when(same, F.col(f"x_{c}")).otherwise(F.col(f"y_{c}")).alias(f"y_{c}") for c in columns)
    return spread(x, *keys).join(spread(y, *keys), keys).select(*part, same.alias("same"), *(f"x_{c}" for c in columns), *right)

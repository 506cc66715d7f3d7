"""Vectors pooled and searched."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that are compared as one matrix.
CHUNK = 4096


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def pooled(rows: DataFrame, keys: list[str], vector: str, weight: Column) -> DataFrame:
    """(keys, n, vector): the mean of each key's vectors by weight, at length 1; a single vector as it is, a zero mean as zeros.

    Coordinates are summed by key and place, combined before the shuffle, so that a hot key sends one row a place and task.
    """
    each = rows.where(F.col(vector).isNotNull()).select(*keys, weight.cast("double").alias("_w"), F.posexplode(vector).alias("_pos", "_x"))
    sums = each.groupBy(*keys, "_pos").agg(F.sum(F.col("_w") * F.col("_x")).alias("s"), F.sum("_w").alias("w"), F.count("*").alias("n"))
    whole = sums.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_pos", (F.col("s") / F.col("w")).alias("m")))), lambda x: x["m"]).alias("m"))
    length = F.sqrt(dot("m", "m"))
    return whole.select(*keys, "n", F.when((F.col("n") == 1) | (length == 0), F.col("m")).otherwise(F.transform("m", lambda x: x / length)).alias("vector"))


def packed(rows: DataFrame, key: str, vector: str, group: str | None = None) -> DataFrame:
    """(keys, groups, matrix, dims): the vectors of rows in matrices of at most CHUNK, at length 1; null, empty and zero vectors are left out."""
    columns = [F.col(key).cast("long").alias("k"), F.col(vector).alias("v"), (F.col(group).cast("long") if group else F.lit(0).cast("long")).alias("g")]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dims, part in frame.groupby(frame["v"].map(len)):
                for lo in range(0, len(part), CHUNK):
                    piece = part.iloc[lo : lo + CHUNK]
                    m = np.stack(piece["v"].to_numpy()).astype(np.float64)
                    length = np.linalg.norm(m, axis=1)
                    ok = length > 0
                    m = m[ok] / length[ok, None]
                    yield pd.DataFrame({"keys": [piece["k"].to_numpy()[ok]], "groups": [piece["g"].to_numpy()[ok]], "matrix": [m.tobytes()], "dims": [int(dims)]})

    kept = rows.select(*columns).where("k is not null and g is not null and size(v) > 0")
    return kept.mapInPandas(work, "keys array<bigint>, groups array<bigint>, matrix binary, dims int")


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, group: str | None = None, places: int = 4) -> DataFrame:
    """(query, key, score, group): the k rows of greatest cosine with each query, or the best row of each group, ties to the smaller key, scores rounded first.

    A stated set of queries meets all rows in blocks: matrices of both sides are paired, each pair gives its best k of each query, and
    these meet by query.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for ids, groups, m, dims, q_ids, q in zip(frame["keys"], frame["groups"], frame["matrix"], frame["dims"], frame["q_keys"], frame["q_matrix"], strict=True):
                score = np.round(np.frombuffer(q).reshape(-1, dims) @ np.frombuffer(m).reshape(-1, dims).T, places)
                out = []
                for i, q_id in enumerate(q_ids):
                    order = np.lexsort((ids, -score[i]))
                    if group:
                        order = order[np.sort(np.unique(groups[order], return_index=True)[1])]
                    else:
                        order = order[:k]
                    out.append(pd.DataFrame({"query": q_id, "key": ids[order], "group": groups[order], "score": score[i][order]}))
                yield pd.concat(out, ignore_index=True)

    blocks = packed(queries, key, vector).select(F.col("keys").alias("q_keys"), F.col("matrix").alias("q_matrix"), "dims")
    found = packed(rows, key, vector, group).join(blocks, "dims").mapInPandas(work, "query bigint, key bigint, group bigint, score double")
    over = Window.partitionBy("query", *(["group"] if group else [])).orderBy(F.desc("score"), "key")
    return found.withColumn("r", F.row_number().over(over)).where(F.col("r") <= (1 if group else k)).drop("r")

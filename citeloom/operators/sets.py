"""Pairs of sets that are alike, without a pair ever being shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.blocks import block_pairs
from citeloom.session import cut

#: Items of so many sets are heavy, but no more than MOST items, of the most sets; rows and number of blocks; sets of one group; groups of one matrix; pairs of one batch.
HEAVY, MOST, BLOCK, BLOCKS, GROUP, SLAB, STEP = 256, 16384, 8192, 7, 1024, 1024, 262144
SLACK = 1e-9


def grouped(sizes: np.ndarray, items: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(rows in order of their groups, where each group begins, items of each group, size of each group): sets of one size and equal heavy items, GROUP at most."""
    flat, offsets = items.values.to_numpy(zero_copy_only=False).astype(np.int32), items.offsets.to_numpy()
    seen: dict[tuple[bytes, int, int], int] = {}
    count: dict[tuple[bytes, int], int] = {}
    of, first = np.empty(len(items), np.int64), []
    for row, n in enumerate(sizes.tolist()):
        key = (flat[offsets[row] : offsets[row + 1]].tobytes(), n)
        k = count[key] = count.get(key, -1) + 1
        of[row] = g = seen.setdefault((*key, k // GROUP), len(seen))
        if g == len(first):
            first.append(row)
    order = np.argsort(of, kind="stable")
    return order, np.searchsorted(of[order], np.arange(len(first) + 1)), [flat[offsets[r] : offsets[r + 1]] for r in first], sizes[first]


def shared_light(x: pa.ListArray, y: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row of x * rows of y + row of y, number of shared items), in order, of the rows that share any."""
    code = pa.chunked_array([x.values, y.values]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    cx, cy = code[: len(x.values)], code[len(x.values) :]
    rx, ry = (np.repeat(np.arange(len(s)), np.diff(s.offsets.to_numpy())) for s in (x, y))
    order = np.argsort(cy, kind="stable")
    lo, hi = np.searchsorted(cy[order], cx, "left"), np.searchsorted(cy[order], cx, "right")
    n = hi - lo
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return np.unique(np.repeat(rx, n) * len(y) + ry[order[at]], return_counts=True)


def alike_blocks(x: dict, y: dict, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of x, row of y, shared items, items of both) of the sets whose heavy items alone make them alike."""
    sizes = [s["n"].to_numpy() for s in (x, y)]
    gx = grouped(sizes[0], x["h"])
    gy = gx if same else grouped(sizes[1], y["h"])
    code, times = shared_light(x["l"], y["l"])
    words = np.intersect1d(np.unique(np.concatenate(gx[2])), np.unique(np.concatenate(gy[2])))

    def matrix(sets: list[np.ndarray]) -> np.ndarray:
        m, row, flat = np.zeros((len(sets), len(words)), np.float32), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.searchsorted(words, flat)
        hit = at < len(words)
        hit[hit] = words[at[hit]] == flat[hit]
        m[row[hit], at[hit]] = 1
        return m

    for lo in range(0, len(gx[2]), SLAB):
        left, nl = matrix(gx[2][lo : lo + SLAB]), gx[3][lo : lo + SLAB]
        for at in range(lo if same else 0, len(gy[2]), SLAB):
            shared = left @ matrix(gy[2][at : at + SLAB]).T
            sum_ = (nl[:, None] + gy[3][at : at + SLAB][None]).astype(np.float32)
            a, b = np.nonzero(shared * (1 + least) >= least * sum_ - 0.5)
            h = shared[a, b].astype(np.int64)
            a, b = a + lo, b + at
            fit = h / (gx[3][a] + gy[3][b] - h) >= least - SLACK
            if same:
                fit &= a <= b
            a, b, h = a[fit], b[fit], h[fit]
            nb = gy[1][b + 1] - gy[1][b]
            n = (gx[1][a + 1] - gx[1][a]) * nb
            ends = np.cumsum(n)
            start = 0
            while start < len(a):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + STEP, "right")))
                k = np.repeat(np.arange(start, stop), n[start:stop])
                off = np.arange(len(k)) - (ends[k] - n[k] - (ends[start - 1] if start else 0))
                i, j = gx[0][gx[1][a[k]] + off // nb[k]], gy[0][gy[1][b[k]] + off % nb[k]]
                inner = h[k]
                if same:
                    once = (a[k] != b[k]) | (i < j)
                    i, j, inner = i[once], j[once], inner[once]
                if len(code):
                    key = i * len(sizes[1]) + j
                    place = np.minimum(np.searchsorted(code, key), len(code) - 1)
                    inner = inner + np.where(code[place] == key, times[place], 0)
                yield i, j, inner, sizes[0][i] + sizes[1][j] - inner
                start = stop


def similar_sets(rows: DataFrame, key: str, items: str, least: float, heavy: int = HEAVY) -> DataFrame:
    """(a, b, jaccard), a < b, of rows(key, items: strings without repeats) whose sets are least alike or more, each pair once.

    Sets whose heavy items alone make them alike are found by matrix products over groups of equal heavy items, in pairs of blocks;
    the others share a light item among their first, light ones before heavy ones, and are compared where the smallest shared one
    meets. Neither way shuffles a pair. The driver sees at most MOST items.
    """
    kind = dict(rows.dtypes)[key]
    r = rows.select(F.col(key).alias("k"), F.col(items).alias("s")).where(F.size(items) > 0)
    common = r.select(F.explode("s").alias("w")).groupBy("w").agg(F.count("*").alias("df")).where(F.col("df") >= heavy).orderBy(F.desc("df"), "w").limit(MOST)
    words = [w for w, _ in common.collect()]

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(words, pa.string())
        for batch in batches:
            s = batch.column("s")
            flat, n = s.flatten(), pc.list_value_length(s).to_numpy()
            place = pc.index_in(flat, value_set=known)
            light = place.is_null().to_numpy(zero_copy_only=False)
            begin = np.concatenate([[0], np.cumsum(n)])
            before = np.concatenate([[0], np.cumsum(light)])[begin]
            lists = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), v) for o, v in ((before, flat.filter(pa.array(light))), (begin - before, place.filter(pa.array(~light))))]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(n.astype(np.int32)), *lists], names=["k", "n", "l", "h"])

    t = cut(r.mapInArrow(parted, f"k {kind}, n int, l array<string>, h array<int>").select("k", "n", F.array_sort("l").alias("l"), F.array_sort("h").alias("h")))
    first = F.col("n") - F.ceil(F.lit(least) * F.col("n") - SLACK).cast("int") + 1
    each = t.select("k", "n", "l", "h", F.explode(F.slice("l", 1, first)).alias("w"))
    x, y = (each.select("w", *(F.col(c).alias(f"{c}_{s}") for c in ("k", "n", "l", "h"))) for s in "xy")
    met = x.join(y, "w").where((F.col("k_x") < F.col("k_y")) & (F.least("n_x", "n_y") >= least * F.greatest("n_x", "n_y") - SLACK))
    met = met.withColumn("li", F.array_intersect("l_x", "l_y")).withColumn("hi", F.size(F.array_intersect("h_x", "h_y"))).where(F.element_at("li", 1) == F.col("w"))
    met = met.where(F.col("hi") / (F.col("n_x") + F.col("n_y") - F.col("hi")) < least - SLACK).withColumn("i", F.col("hi") + F.size("li"))
    out = met.select(F.col("k_x").alias("a"), F.col("k_y").alias("b"), F.round(F.col("i") / (F.col("n_x") + F.col("n_y") - F.col("i")), 6).alias("jaccard")).where(F.col("jaccard") >= least)
    if not words:
        return out

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sides = [{c: batch.column(f"{side}_{c}")[row].values for c in ("k", "n", "l", "h")} for side in "xy"]
                sides = [{c: plain(v) for c, v in s.items()} for s in sides]
                for i, j, inner, union in alike_blocks(*sides, batch.column("same")[row].as_py(), least):
                    yield pa.RecordBatch.from_arrays([sides[0]["k"].take(pa.array(i)), sides[1]["k"].take(pa.array(j)), pa.array(inner.astype(np.int32)), pa.array(union.astype(np.int32))], names=["x", "y", "i", "u"])

    able = t.where(F.size("h") >= least * F.col("n") - 1e-6).withColumn("part", F.lit(0))
    able = able.withColumn("c", F.count("*").over(Window.partitionBy("h", "n")))
    place = F.struct("h", "n", F.pmod(F.xxhash64("k"), F.ceil(F.col("c") / GROUP)))
    found = block_pairs(able, ["part"], place, BLOCK, ["k", "n", "l", "h"], BLOCKS).mapInArrow(compared, f"x {kind}, y {kind}, i int, u int")
    return out.unionByName(found.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round(F.col("i") / F.col("u"), 6).alias("jaccard")).where(F.col("jaccard") >= least))


def plain(a: pa.Array) -> pa.Array:
    """An array that begins at the start of its buffers, lists of lists too."""
    if not pa.types.is_list(a.type):
        return a
    begin, n = a.offsets.to_numpy(), pc.list_value_length(a).to_numpy()
    return pa.ListArray.from_arrays(pa.array((begin - begin[0]).astype(np.int32)), a.values.slice(int(begin[0]), int(n.sum())))

"""Graph operators on edge tables: closure, levels, path counts, main path, communities, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.session import cut, is_empty


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(start, node) of all nodes that start(start, node) reaches along edges(src, dst), the start itself left out; a frontier join until nothing new comes."""
    found = cut(start.select("start", F.col("node")).distinct())
    frontier = found
    hop = edges.select(F.col("src").alias("node"), "dst").distinct()
    while not is_empty(frontier):
        new = frontier.join(hop, "node").select("start", F.col("dst").alias("node")).distinct()
        frontier = cut(new.join(found, ["start", "node"], "left_anti"))
        found = cut(found.unionByName(frontier))
    return found.join(start.select("start", "node"), ["start", "node"], "left_anti")


def levels(edges: DataFrame) -> DataFrame:
    """(node, level) in topological order, sources at level 0; nodes on cycles, and behind them, have none."""
    hop = cut(edges.select("src", "dst").where("src <> dst").distinct())
    nodes = hop.select(F.col("src").alias("node")).union(hop.select("dst")).distinct()
    left, out, level = cut(nodes), None, 0
    while True:
        blocked = hop.join(left.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        free = cut(left.join(blocked, "node", "left_anti").withColumn("level", F.lit(level)))
        if is_empty(free):
            break
        out = free if out is None else out.unionByName(free)
        left, level = cut(left.join(free, "node", "left_anti")), level + 1
    return out if out is not None else nodes.withColumn("level", F.lit(0)).limit(0)


def path_counts(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): search path counts, the number of source-to-sink paths through each edge between nodes that have levels; level by level, as doubles."""
    level = cut(levels(edges))
    hop = edges.select("src", "dst").where("src <> dst").distinct()
    hop = hop.join(level.select(F.col("node").alias("src"), F.col("level").alias("ls")), "src").join(level.select(F.col("node").alias("dst"), F.col("level").alias("ld")), "dst")
    hop = cut(hop)
    top = hop.agg(F.max("ld")).first()[0] or 0

    def walk(a: str, b: str, la: str, order: range) -> DataFrame:
        ends = level.join(hop.select(F.col(b).alias("node")).distinct(), "node", "left_anti").select("node", F.lit(1.0).alias("n"))
        known = cut(ends)
        for k in order:
            step = hop.where(F.col("ld" if b == "dst" else "ls") == k).join(known.withColumnRenamed("node", a), a).groupBy(F.col(b).alias("node")).agg(F.sum("n").alias("n"))
            known = cut(known.unionByName(step))
        return known

    down = walk("src", "dst", "ls", range(1, top + 1))
    up = walk("dst", "src", "ld", range(top - 1, -1, -1))
    return hop.join(down.withColumnRenamed("node", "src").withColumnRenamed("n", "ns"), "src").join(up.withColumnRenamed("node", "dst").withColumnRenamed("n", "nt"), "dst").select("src", "dst", (F.col("ns") * F.col("nt")).alias("weight"))


def main_path(weights: DataFrame) -> DataFrame:
    """(src, dst, weight) of the edges walked from every source along the heaviest edge out of each node, ties by the smaller target."""
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    best = cut(weights.where("weight > 0").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r"))
    frontier = cut(best.join(weights.select(F.col("dst").alias("src")).distinct(), "src", "left_anti"))
    found = frontier
    while not is_empty(frontier):
        nxt = best.join(frontier.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        frontier = cut(nxt.join(found, ["src", "dst"], "left_anti").select("src", "dst", "weight"))
        found = cut(found.unionByName(frontier))
    return found


def blocks_of_pairs(pairs: DataFrame) -> DataFrame:
    """(node, block) of the ends of pairs(a, b): block is the smallest node that pairs connect with it.

    Each round every node takes the least label about it, labels jump to their labels' labels, and pairs are drawn between labels, so
    that chains shorten by half; it ends when no pair of different labels is left.
    """
    edges = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    label = cut(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("block", F.col("node")))
    while not is_empty(edges):
        both = edges.union(edges.select("b", "a")).toDF("x", "y")
        least = cut(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("to")))
        jumped = cut(least.join(least.toDF("to", "far"), "to", "left").select("x", F.least("to", F.coalesce("far", "to")).alias("to")))
        label = cut(label.join(jumped.withColumnRenamed("x", "block"), "block", "left").select("node", F.coalesce("to", "block").alias("block")))
        at = lambda c: F.coalesce(f"{c}_to", c)
        moved = edges.join(jumped.toDF("a", "a_to"), "a", "left").join(jumped.toDF("b", "b_to"), "b", "left").select(F.least(at("a"), at("b")).alias("a"), F.greatest(at("a"), at("b")).alias("b"))
        edges = cut(moved.where("a <> b").distinct())
    return label


def modularity(both: DataFrame, label: DataFrame) -> float:
    """The modularity at resolution 1 of label(u, k, c) on edges both(u, v, w) in both directions, loops once with double weight; one figure."""
    total = label.agg(F.sum("k")).first()[0] or 1.0
    inside = both.join(label.select("u", "c"), "u").join(label.select(F.col("u").alias("v"), F.col("c").alias("d")), "v").where("c = d").agg(F.sum("w")).first()[0] or 0.0
    squares = label.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0] or 0.0
    return inside / total - squares / (total * total)


def moved_locally(both: DataFrame) -> tuple[DataFrame, float]:
    """(u, k, c), modularity: nodes moved between the communities about them until no round gains.

    In a round one half of the nodes, chosen by a hash that changes, and then the other move to the neighbouring community of the
    greatest gain, ties to the smaller; two rounds without a better modularity end it, and the best state is kept.
    """
    degree = cut(both.groupBy("u").agg(F.sum("w").alias("k")))
    total = degree.agg(F.sum("k")).first()[0] or 1.0
    label = cut(degree.select("u", "k", F.col("u").alias("c")))
    best, most, idle, r = label, modularity(both, label), 0, 0
    links = both.where("u <> v")
    while idle < 2:
        size = label.groupBy("c").agg(F.sum("k").alias("tot"))
        own = label.select("u", "k", F.col("c").alias("old"))
        to = links.join(label.select(F.col("u").alias("v"), "c"), "v").groupBy("u", "c").agg(F.sum("w").alias("inside"))
        to = to.unionByName(own.select("u", F.col("old").alias("c"), F.lit(0.0).alias("inside"))).groupBy("u", "c").agg(F.sum("inside").alias("inside"))
        gain = to.join(size, "c").join(own, "u").withColumn("gain", F.col("inside") - F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("old"), F.col("k")).otherwise(0.0)) / F.lit(total))
        stay = F.when(F.col("c") == F.col("old"), 0).otherwise(1)
        target = gain.groupBy("u").agg(F.min(F.struct((-F.round("gain", 9)).alias("g"), stay.alias("s"), "c")).alias("m")).select("u", F.col("m.c").alias("to"))
        turn = F.pmod(F.xxhash64("u", F.lit(r // 2)), F.lit(2)) == r % 2
        label = cut(label.join(target, "u").select("u", "k", F.when(turn, F.col("to")).otherwise(F.col("c")).alias("c")))
        r += 1
        if r % 2 == 0:
            now = modularity(both, label)
            best, most, idle = (label, now, 0) if now > most + 1e-9 else (best, most, idle + 1)
    return best, most


def communities(edges: DataFrame) -> DataFrame:
    """(node, community): Louvain at resolution 1 on edges(src, dst, weight): local moves until none gains, communities contracted to nodes, and again until contraction gains nothing.

    Communities carry their smallest member's name.
    """
    e = edges.where("src <> dst")
    both = cut(e.select("src", "dst", "weight").union(e.select(F.col("dst"), F.col("src"), "weight")).toDF("u", "v", "w").groupBy("u", "v").agg(F.sum("w").alias("w")))
    names, most = None, None
    while True:
        label, now = moved_locally(both)
        if most is not None and now <= most + 1e-9:
            break
        most = now
        small = label.groupBy("c").agg(F.min("u").alias("community"))
        to = cut(label.join(small, "c").select("u", "community"))
        names = to.toDF("node", "community") if names is None else cut(names.join(to.toDF("community", "up"), "community").select("node", F.col("up").alias("community")))
        both = cut(both.join(to, "u").withColumnRenamed("community", "cu").join(to.toDF("v", "cv"), "v").groupBy("cu", "cv").agg(F.sum("w").alias("w")).toDF("u", "v", "w"))
    return names

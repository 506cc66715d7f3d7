"""The most similar vectors of every vector: learned balanced partitions of a neighbour graph, queries routed by a small classifier, candidates ranked exactly."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.session import cut

#: Vectors of a model, or of a part of it, by the order of their hash, on which its partitioning is fitted; every vector is indexed.
SAMPLE = 8192
#: Vectors that a part should hold, and most parts that one classifier tells apart; larger models have a second classifier in each part.
PART, MOST_PARTS = 2048, 256
#: A query goes to the likeliest parts until they hold this much of its probability, to LEAST_PROBES at least.
MASS, LEAST_PROBES = 0.985, 3
#: Vectors of a block on either side; parts of any size are held against each other block by block.
BLOCK = 4096
NEIGHBOURS = 16


@dataclass(frozen=True)
class Router:
    """A classifier with one hidden layer: from a unit vector to the probability of each part."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), dtype=np.int32)
    for lo in range(0, len(x), 1024):
        s = x[lo : lo + 1024] @ x.T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -2
        out[lo : lo + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """Parts of nearly equal size with few graph edges between them: halves along the main axis, then moves to the part of most neighbours while there is room."""
    label = np.zeros(len(x), dtype=np.int64)
    count = 1
    while count < parts:
        for p in range(count):
            at = np.flatnonzero(label == p)
            y = x[at] - x[at].mean(axis=0)
            axis = np.ones(x.shape[1]) / np.sqrt(x.shape[1])
            for _ in range(12):
                axis = y.T @ (y @ axis)
                axis /= max(np.linalg.norm(axis), 1e-12)
            order = np.argsort(y @ axis, kind="stable")
            label[at[order[len(at) // 2 :]]] = p + count
        count *= 2
    room = int(np.ceil(1.08 * len(x) / parts))
    size = np.bincount(label, minlength=parts)
    for _ in range(8):
        votes = np.zeros((len(x), parts), dtype=np.int16)
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1)
        gain = votes.max(axis=1) - votes[np.arange(len(x)), label]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            to = int(votes[i].argmax())
            if size[to] < room:
                size[label[i]] -= 1
                size[to] += 1
                label[i] = to
                moved += 1
        if moved < 0.002 * len(x):
            break
    return label


def fit(x: np.ndarray, parts: int, seed: int = 7) -> Router:
    """Partition of the neighbour graph of x, and the classifier that learns where a vector and its neighbours lie."""
    rng = np.random.default_rng(seed)
    graph = neighbour_graph(x, min(NEIGHBOURS, len(x) - 1))
    label = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts), dtype=np.float32)
    np.add.at(target, (np.arange(len(x)), label), 2)
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1)
    target /= target.sum(axis=1, keepdims=True)
    hidden = 128
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)) * 2, np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, parts)), np.zeros(parts)]
    p = [a.astype(np.float32) for a in p]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(24):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 256):
            at = order[lo : lo + 256]
            h = np.maximum(x[at] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = (z / z.sum(axis=1, keepdims=True) - target[at]) / len(at)
            dh = (d @ p[2].T) * (h > 0)
            step += 1
            for i, g in enumerate((x[at].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*p)


def usable_vectors(rows: DataFrame) -> DataFrame:
    """(model, key, vector): the last written row of each article_id, chunk_index and model_name, if its vector is usable.

    Not usable: null, all zero, with null or NaN elements, or not of the stated dimensions. A row with a null article_id, chunk_index or
    model_name is none; of rows written at the same time the one with the greater hash and vector counts.
    """
    last = rows.where("article_id is not null and chunk_index is not null and model_name is not null").groupBy("article_id", "chunk_index", "model_name").agg(F.max(F.struct("written_at", "input_hash", "embedding", "dimensions")).alias("m"))
    v = last.select(F.col("model_name").alias("model"), F.concat("article_id", F.lit("#"), F.col("chunk_index").cast("string")).alias("key"), F.col("m.embedding").alias("vector"), F.col("m.dimensions").alias("dimensions"))
    sound = F.expr("forall(vector, x -> x is not null and not isnan(x) and abs(x) < 1e30)") & F.expr("exists(vector, x -> x <> 0)")
    return v.where(F.col("vector").isNotNull() & (F.size("vector") == F.col("dimensions")) & sound).select("model", "key", "vector")


@dataclass(frozen=True)
class Tree:
    """The classifiers of a model: one for its parts, and one in each part where there are more than MOST_PARTS; none for a model of one part."""

    root: Router | None
    inner: dict[int, Router]

    def home_parts(self, x: np.ndarray) -> np.ndarray:
        return self.root.probabilities(x).argmax(axis=1)

    def routes(self, x: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """The part that each vector is indexed in, and those in which its neighbours are looked for, the likeliest first."""
        if self.root is None:
            return np.zeros(len(x), np.int64), [[0]] * len(x)
        p = self.root.probabilities(x)
        order, take = likeliest(p)
        if not self.inner:
            return order[:, 0], [o[:n].tolist() for o, n in zip(order, take, strict=True)]
        width = MOST_PARTS
        at = [[] for _ in range(p.shape[1])]
        for i, (o, n) in enumerate(zip(order, take, strict=True)):
            for part in o[:n]:
                at[part].append(i)
        found: list[list[tuple[float, int]]] = [[] for _ in range(len(x))]
        for part, rows in enumerate(at):
            if rows:
                inner = self.inner.get(part)
                q = inner.probabilities(x[rows]) if inner is not None else np.ones((len(rows), 1))
                deep, need = likeliest(q)
                for r, i in enumerate(rows):
                    found[i] += [(-float(p[i, part] * q[r, k]), part * width + int(k)) for k in deep[r, : need[r]]]
        probes, home = [], np.zeros(len(x), np.int64)
        for i, f in enumerate(found):
            # at home in the likeliest part of the likeliest part, where the index is split as it was fitted
            top = order[i, 0]
            home[i] = next(part for _, part in sorted(f) if part // width == top)
            f.sort()
            total = np.cumsum([-a for a, _ in f])
            n = int((total < MASS * total[-1]).sum()) + 1
            probes.append([part for _, part in f[: max(n, LEAST_PROBES)]])
        return home, probes


def likeliest(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts by probability, and how many of them hold MASS, LEAST_PROBES at least."""
    order = np.argsort(-p, axis=1, kind="stable")
    need = (np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) < MASS).sum(axis=1) + 1
    return order, np.minimum(np.maximum(need, LEAST_PROBES), p.shape[1])


def route(batches: Iterator[pd.DataFrame], trees: dict[str, Tree]) -> Iterator[pd.DataFrame]:
    """From (model, rep, vector) the parts of each vector: home is where it is indexed, probes where its neighbours are looked for."""
    for batch in batches:
        for model, part in batch.groupby("model", sort=False):
            x = unit(np.stack(part["vector"].to_numpy()))
            home, probes = trees[model].routes(x)
            yield pd.DataFrame({"model": model, "rep": part["rep"].to_numpy(), "vector": list(x), "home": home, "probes": probes})


def planted(reps: DataFrame) -> dict[str, Tree]:
    """The trees of all models, fitted on bounded samples: roots on the driver, inner classifiers by the executors, one task a part."""
    trees: dict[str, Tree] = {}
    wide: dict[str, int] = {}
    for model, n in sorted(reps.groupBy("model").count().collect()):
        parts = 1
        while n / parts > PART:
            parts *= 2
        root = None
        if parts > 1:
            sample = reps.where(F.col("model") == model).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vector").toPandas()
            root = fit(unit(np.stack(sample["vector"].to_numpy())), min(parts, MOST_PARTS))
        trees[model] = Tree(root, {})
        if parts > MOST_PARTS:
            wide[model] = min(parts // MOST_PARTS, MOST_PARTS)
    if not wide:
        return trees

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for model, part in batch.groupby("model", sort=False):
                yield pd.DataFrame({"model": model, "part": trees[model].home_parts(unit(np.stack(part["vector"].to_numpy()))), "rep": part["rep"].to_numpy(), "vector": part["vector"].to_numpy()})

    def grow(sample: pd.DataFrame) -> pd.DataFrame:
        model, part = sample["model"].iloc[0], int(sample["part"].iloc[0])
        x = unit(np.stack(sample.sort_values("rep")["vector"].to_numpy()))
        parts = wide[model]
        while parts > 1 and len(x) < 4 * parts:
            parts //= 2
        return pd.DataFrame({"model": [model], "part": [part], "router": [pickle.dumps(fit(x, parts) if parts > 1 else None)]})

    part = reps.where(F.col("model").isin(list(wide))).mapInPandas(homes, "model string, part int, rep string, vector array<float>")
    w = Window.partitionBy("model", "part").orderBy(F.xxhash64("rep"), "rep")
    samples = part.withColumn("r", F.row_number().over(w)).where(F.col("r") <= SAMPLE).drop("r")
    for r in samples.groupBy("model", "part").applyInPandas(grow, "model string, part int, router binary").toLocalIterator():
        router = pickle.loads(bytes(r["router"]))
        if router is not None:
            trees[r["model"]].inner[r["part"]] = router
    return trees


def rank_blocks(k: int):
    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Of a block of queries and a block of indexed vectors: each query's k most similar ones, ties by key."""
        if not len(left) or not len(right):
            return pd.DataFrame({"model": [], "rep": [], "other": [], "sim": []})
        right = right.sort_values("b_rep", kind="stable")
        q, b = np.stack(left["vector"].to_numpy()), np.stack(right["b_vector"].to_numpy())
        names, keys = right["b_rep"].to_numpy(), left["rep"].to_numpy()
        rows, cols, sims = [], [], []
        for lo in range(0, len(q), 1024):
            s = q[lo : lo + 1024] @ b.T
            s[keys[lo : lo + 1024][:, None] == names[None, :]] = -2
            n = min(k, s.shape[1])
            top = np.argpartition(-s, n - 1, axis=1)[:, :n]
            rows.append(np.repeat(np.arange(lo, lo + len(s)), n))
            cols.append(top.ravel())
            sims.append(np.take_along_axis(s, top, axis=1).ravel())
        i, j = np.concatenate(rows), np.concatenate(cols)
        sim = np.einsum("ij,ij->i", q[i].astype(np.float64), b[j].astype(np.float64))
        keep = np.concatenate(sims) > -1.5
        return pd.DataFrame({"model": left["model"].iloc[0], "rep": keys[i][keep], "other": names[j][keep], "sim": sim[keep]})

    return rank


def similar_vectors(vectors: DataFrame, k: int = 5) -> DataFrame:
    """(model, key, neighbours) of each of vectors(model, key, vector): neighbours are the k most similar ones of the model, [(key, sim)], nearest first, ties by key.

    Equal vectors are one class: they are indexed and queried once, and a class of any size gives each of its vectors the smallest other
    keys of the class. Models are partitioned separately; one of few vectors is one part, and its search exact. Empty tables give none.
    """
    rows = cut(vectors.withColumn("class", F.md5(F.to_json(F.struct("model", "vector")))))
    w = Window.partitionBy("class").orderBy("key")
    first = rows.select("class", "model", "key").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    reps = rows.join(first.where("r = 1").select("class", "key"), ["class", "key"]).select("model", F.col("class").alias("rep"), "vector")
    reps = cut(reps)
    trees = planted(reps)
    routed = cut(reps.mapInPandas(lambda b: route(b, trees), "model string, rep string, vector array<float>, home long, probes array<long>"))
    base = routed.select("model", F.col("home").alias("part"), "rep", "vector")
    asked = routed.select("model", F.explode("probes").alias("part"), "rep", "vector")
    # one row for each part of each model: at most the square of MOST_PARTS a model
    blocks = lambda df, name: df.groupBy("model", "part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    counts = F.broadcast(cut(blocks(base, "nb").join(blocks(asked.select("model", "part"), "nq"), ["model", "part"])))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    b = base.join(counts, ["model", "part"]).select("model", "part", own("nb").alias("x"), spread("nq").alias("y"), "rep", "vector").toDF("b_model", "b_part", "b_x", "b_y", "b_rep", "b_vector")
    q = asked.join(counts, ["model", "part"]).select("model", "part", spread("nb").alias("x"), own("nq").alias("y"), "rep", "vector")
    keys = ["model", "part", "x", "y"]
    near = q.groupBy(*keys).cogroup(b.groupBy(*(f"b_{c}" for c in keys))).applyInPandas(rank_blocks(k), "model string, rep string, other string, sim double")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("sim"), "other"))).where(F.col("r") <= k).select("rep", "other", "sim")
    members = first.select(F.col("class").alias("other"), F.col("key").alias("near_key"), "r")
    found = best.join(members.where(F.col("r") <= k), "other").select("rep", "near_key", "sim")
    found = found.union(first.select(F.col("class").alias("rep"), F.col("key").alias("near_key"), F.lit(1.0).alias("sim")))
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("sim"), "near_key"))).where(F.col("r") <= k + 1)
    lists = top.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("far"), F.col("near_key").alias("key")))).alias("top"))
    out = rows.select("model", "key", F.col("class").alias("rep")).join(lists, "rep")
    return out.select("model", "key", F.expr(f"transform(slice(filter(top, x -> x.key <> key), 1, {k}), x -> struct(x.key as key, -x.far as sim))").alias("neighbours"))


def similar_pairs(rows: DataFrame, k: int = 5) -> DataFrame:
    """(key_a, key_b), smaller first, of vectors of one model of which one is among the other's k most similar."""
    near = similar_vectors(usable_vectors(rows), k).select("key", F.explode("neighbours").alias("x")).select("key", F.col("x.key").alias("other"))
    return near.select(F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b")).distinct()

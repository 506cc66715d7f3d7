"""Sources mixed to target shares of tokens: balanced sampling by the cube method."""

from __future__ import annotations

import base64
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.cleaning import trimmed_lower
from citeloom.session import cut, widened

#: Where the vocabulary files of the public tokenizers lie.
TOKENIZERS = os.environ.get("CITELOOM_TOKENIZERS", "/opt/tokenizers")
# Fixed value: how the byte-level BPE of the vocabulary file parts a text.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents that are balanced in one task.
BLOCK = 4096


def count_tokens(batches: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "tokens": [len(encoding.encode_ordinary(t)) for t in batch["text"]]})


def flight(pi: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Moves the fractional probabilities through the null space of the two balance constraints (documents, tokens) until at most two are left."""
    pi = pi.astype(np.float64).copy()
    open_units: list[int] = []
    for i in range(len(pi)):
        if 1e-9 < pi[i] < 1 - 1e-9:
            open_units.append(i)
        if len(open_units) < 3:
            continue
        a, b, c = open_units
        t = tokens[open_units].astype(np.float64)
        u = np.array([t[1] - t[2], t[2] - t[0], t[0] - t[1]])  # orthogonal to (1, 1, 1) and to the tokens
        if not u.any():
            u = np.array([1.0, -1.0, 0.0])
        p = pi[open_units]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - p) / u, np.where(u < 0, -p / u, np.inf)).min()
            down = np.where(u > 0, p / u, np.where(u < 0, (p - 1) / u, np.inf)).min()
        # a fair choice between both ends would be random; here the units' places decide, so that a run can be repeated
        coin = ((a * 2654435761 + b * 40503 + c * 97) >> 7) % 10_000 / 10_000
        p = p + u * up if coin < down / (up + down) else p - u * down
        p[np.abs(p) < 1e-9], p[np.abs(p - 1) < 1e-9] = 0, 1
        pi[open_units] = p
        open_units = [k for k in open_units if 1e-9 < pi[k] < 1 - 1e-9]
    return pi


def land(pi: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The few fractional probabilities that are left rounded so that tokens, then documents, stay nearest to their totals."""
    left = np.flatnonzero((pi > 1e-9) & (pi < 1 - 1e-9))
    best = min(itertools.product((0, 1), repeat=len(left)), key=lambda c: (abs(((np.array(c) - pi[left]) * tokens[left]).sum()), abs((np.array(c) - pi[left]).sum())), default=())
    pi = pi.copy()
    pi[left] = best
    return pi


def balance(last: bool):
    def work(units: pd.DataFrame) -> pd.DataFrame:
        units = units.sort_values(["rank", "doc_id"], kind="stable")
        pi, tokens = units["pi"].to_numpy(), units["tokens"].to_numpy()
        pi = flight(pi, tokens)
        return units.assign(pi=land(pi, tokens) if last else pi)

    return work


def tokenized(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of documents with text: source in lower case without outer blanks. Null and blank texts and null ids are left out; repeated rows stay, texts are not shuffled."""
    file = path or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    rows = widened(documents.select("doc_id", trimmed_lower("source").alias("source"), "text").where(r"doc_id is not null and text rlike '\\S'"))
    return rows.mapInPandas(lambda b: count_tokens(b, file), f"doc_id {dict(rows.dtypes)['doc_id']}, source string, tokens long")


def mixture(documents: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens, copies): the largest mixture in which each source has its target_share of the tokens and no document more than max_repeats copies.

    Every document of a source has the same expected number of copies; the whole part goes to each, the fraction is drawn by the cube
    method, balanced on the source's documents and tokens, in blocks whose few undecided documents meet again until one block is left.
    Sources without target or without tokens take no part; the other targets keep their proportions. targets is a fixed table of sources.
    """
    counted = cut(tokenized(documents, path).groupBy("doc_id", "source").agg(F.max("tokens").alias("tokens")).where("tokens > 0"))
    wanted = targets.select(trimmed_lower("source").alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats > 0").dropDuplicates(["source"])
    totals = counted.groupBy("source").agg(F.sum("tokens").alias("w")).join(wanted, "source").collect()
    size = min((r["max_repeats"] * r["w"] / r["target_share"] for r in totals), default=0.0)
    rates = [(r["source"], min(float(r["max_repeats"]), r["target_share"] * size / r["w"])) for r in totals]
    rate = documents.sparkSession.createDataFrame(rates, "source string, rate double")
    units = counted.join(F.broadcast(rate), "source").withColumn("whole", F.floor(F.col("rate") + 1e-9)).withColumn("pi", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))).withColumn("rank", F.xxhash64("doc_id")).drop("rate")
    units = units.withColumn("pi", F.when(F.col("pi") < 1e-9, 0.0).otherwise(F.col("pi")))
    done = units.where("pi = 0")
    pending = cut(units.where("pi > 0"))
    kept = [done]
    while True:
        largest = pending.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        blocks = max(1, -(-largest // BLOCK))
        last = blocks == 1
        pending = cut(pending.withColumn("block", F.pmod(F.xxhash64("rank", F.lit(len(kept))), F.lit(blocks))).groupBy("source", "block").applyInPandas(balance(last), pending_schema(units)))
        kept.append(pending.where("pi <= 1e-9 or pi >= 1 - 1e-9"))
        if last:
            break
        pending = pending.where("pi > 1e-9 and pi < 1 - 1e-9")
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more.select(out.columns))
    return out.select("doc_id", "source", "tokens", (F.col("whole") + F.round("pi")).cast("int").alias("copies")).where("copies > 0")


def pending_schema(units: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in units.dtypes) + ", block long"


def shares(mixed: DataFrame, documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_documents, n_copies, most_copies, tokens, actual_share) of each target source: what mixed holds of it."""
    wanted = targets.select(trimmed_lower("source").alias("source"), "target_share", "max_repeats").dropDuplicates(["source"])
    sums = mixed.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    whole = sums.agg(F.sum("tokens").alias("whole"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return wanted.join(sums, "source", "left").crossJoin(F.broadcast(whole)).select("source", "target_share", "max_repeats", zero("n_documents"), zero("n_copies"), zero("most_copies"), zero("tokens"), (F.coalesce("tokens", F.lit(0)) / F.col("whole")).alias("actual_share"))

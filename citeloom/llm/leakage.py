"""Passages of held-out items inside a corpus: SimHash windows, multi-index Hamming blocks, then exact verification."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.session import widened

#: Words of a passage's window, bits in which two of its fingerprints may differ, blocks of the 64 bits. Fewer bits than blocks: two fingerprints within the radius agree on a block.
WINDOW, RADIUS, BLOCKS = 13, 3, 4
#: The same for windows of the size of items. An item has those of the largest size of this row that it holds: SMALLEST, twice that, and so on;
#: one begins at each SPACING-th part of the size, and one ends with the item. In a text a window begins at every word.
SMALLEST, ITEM_RADIUS, ITEM_BLOCKS, SPACING = 24, 7, 8, 8
#: Words of a shingle, and the share of two windows' weight that must be common.
SHINGLE, LEAST = 5, 0.8
#: Windows of items that are held against the corpus in one pass, and bytes of items that the driver takes at once; more items take more passes.
PASS_WINDOWS, ITEM_BYTES = 200_000, 64_000_000
#: Words of texts that are worked on at once, windows whose candidates are listed at once, and pairs that are compared at once.
SLICE, STEP, PAIRS = 200_000, 50_000, 4_000
INLINE = re.compile(r"</?(?:[a-z]+:)?(?:b|i|u|em|strong|sub|sup|span|a|italic|bold|small|mark|font)(?:\s[^<>]*)?>", re.I)
TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
HIDDEN = re.compile("[\xad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits; case, punctuation, layout, markup and invisible characters left aside."""
    if "<" in text:
        text = TAG.sub(" ", INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", HIDDEN.sub("", text))
    return WORD.findall(text.casefold())


def word_hashes(tokens: list[str], known: dict[str, int]) -> np.ndarray:
    out = np.empty(len(tokens), dtype=np.uint64)
    for i, w in enumerate(tokens):
        h = known.get(w)
        if h is None:
            if len(known) > 500_000:
                known.clear()
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        out[i] = h
    return out


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the words before each place have each bit."""
    total = np.zeros((len(hashes) + 1, 64), dtype=np.int32)
    np.cumsum(np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, out=total[1:])
    return total


def fingerprints(hashes: np.ndarray, window: int = WINDOW, sums: np.ndarray | None = None) -> np.ndarray:
    """SimHash of each window of words: a bit is set where most of the words have it."""
    if len(hashes) < window:
        return np.zeros(0, dtype=np.uint64)
    total = bit_sums(hashes) if sums is None else sums
    most = (total[window:] - total[:-window]) > window // 2
    return np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()


def shingles(hashes: np.ndarray) -> np.ndarray:
    """A number for each run of SHINGLE words; of a matrix, down its columns."""
    out = np.zeros((max(0, len(hashes) - SHINGLE + 1), *hashes.shape[1:]), dtype=np.uint64)
    for k in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)]
    return out


@dataclass(frozen=True)
class Weights:
    """A shingle weighs less the more items have it; one that none or one has weighs 1. keys are sorted."""

    keys: np.ndarray
    values: np.ndarray

    def of(self, found: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.ones(found.shape)
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        return np.where(self.keys[at] == found, self.values[at], 1.0)


@dataclass(frozen=True)
class Items:
    """Windows of one size of the held-out items: fingerprints, whose, words, block tables; where a window begins in its item; the weights of all shingles of an item."""

    prints: np.ndarray
    owner: np.ndarray
    hashes: np.ndarray
    order: tuple[np.ndarray, ...]
    starts: tuple[np.ndarray, ...]
    begin: np.ndarray
    spans: dict[int, np.ndarray]
    window: int = WINDOW
    radius: int = RADIUS


def blocks(prints: np.ndarray, parts: int = BLOCKS) -> list[np.ndarray]:
    bits = 64 // parts
    return [((prints >> np.uint64(bits * b)) & np.uint64((1 << bits) - 1)).astype(np.int64) for b in range(parts)]


def item_window(n_words: int) -> int | None:
    """The largest of the windows' sizes that an item holds; none for one under SMALLEST words."""
    return SMALLEST << ((n_words // SMALLEST).bit_length() - 1) if n_words >= SMALLEST else None


def index_items(items: list[tuple[int, str]], weights: Weights | None = None) -> list[Items]:
    """Tables of at most PASS_WINDOWS windows (more only for an item that has more): of passages, and of the size of the items."""
    known: dict[str, int] = {}
    tokens = [(k, word_hashes(words(t), known)) for k, t in items]
    weights = weights or Weights(*item_weights(tokens))
    tables = []
    sizes = {WINDOW: tokens}
    for k, h in tokens:
        if (size := item_window(len(h))) is not None:
            sizes.setdefault(size, []).append((k, h))
    for size, of_size in sizes.items():
        part, count = [], 0
        for k, h in [*of_size, (None, None)]:
            n = 0 if h is None or len(h) < size else len(window_begins(len(h), size))
            if part and (h is None or count + n > PASS_WINDOWS):
                tables.append(index_part(part, weights, size))
                part, count = [], 0
            if n:
                part.append((k, h))
                count += n
    return tables


def item_weights(tokens: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that several items have, sorted, and one by how many."""
    each = [np.unique(shingles(h)) for _, h in tokens]
    keys, n = np.unique(np.concatenate(each) if each else np.zeros(0, np.uint64), return_counts=True)
    return keys[n > 1], 1 / n[n > 1]


def window_begins(n_words: int, window: int) -> np.ndarray:
    """Where the windows of an item begin: at every word for passages, spaced for those of its size."""
    last = n_words - window
    return np.arange(last + 1) if window == WINDOW else np.unique([*range(0, last + 1, window // SPACING), last])


def index_part(part: list[tuple[int, np.ndarray]], weights: Weights, window: int) -> Items:
    begins = [window_begins(len(h), window) for _, h in part]
    prints = np.concatenate([fingerprints(h, window)[b] for (_, h), b in zip(part, begins, strict=True)])
    owner = np.concatenate([np.full(len(b), k, dtype=np.int64) for (k, _), b in zip(part, begins, strict=True)])
    hashes = np.concatenate([np.lib.stride_tricks.sliding_window_view(h, window)[b] for (_, h), b in zip(part, begins, strict=True)])
    begin = np.concatenate(begins)
    parts, radius = (BLOCKS, RADIUS) if window == WINDOW else (ITEM_BLOCKS, ITEM_RADIUS)
    keys = blocks(prints, parts)
    order = tuple(np.argsort(k, kind="stable") for k in keys)
    starts = tuple(np.searchsorted(k[o], np.arange((1 << (64 // parts)) + 1)) for k, o in zip(keys, order, strict=True))
    return Items(prints, owner, hashes, order, starts, begin, {k: weights.of(shingles(h)) for k, h in part}, window, radius)


def candidates(prints: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (corpus window, item window) of fingerprints at most the radius apart: all of them, each once."""
    found = [np.zeros((0, 2), dtype=np.int64)]
    for lo in range(0, len(prints), STEP):
        some = prints[lo : lo + STEP]
        for b, key in enumerate(blocks(some, len(items.order))):
            first, last = items.starts[b][key], items.starts[b][key + 1]
            n = last - first
            i = np.repeat(np.arange(len(some)), n)
            j = items.order[b][np.repeat(last - np.cumsum(n), n) + np.arange(n.sum())]
            near = np.bitwise_count(some[i] ^ items.prints[j]) <= items.radius
            found.append(np.stack([i[near] + lo, j[near]], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], pairs[:, 1]


def similarities(left: np.ndarray, right: np.ndarray, weights: Weights) -> np.ndarray:
    """The weight of the shingles that windows have in common, of all that either has, pair by pair of word windows."""
    out = np.ones(len(left))
    for lo in range(0, len(left), PAIRS):
        a, b = left[lo : lo + PAIRS], right[lo : lo + PAIRS]
        other = np.flatnonzero((a != b).any(axis=1))
        if not len(other):
            continue
        n = a.shape[1] - SHINGLE + 1
        sa, sb = (shingles(x[other].T).T for x in (a, b))
        wa, wb = weights.of(sa), weights.of(sb)
        both = np.zeros(len(other))
        for k in range(n):
            both += wa[:, k] * (sa[:, k : k + 1] == sb).any(axis=1)
        # windows that differ are never wholly alike, though a shingle may be in them twice
        out[lo + other] = np.minimum(both / np.maximum(wa.sum(axis=1) + wb.sum(axis=1) - both, 1e-12), 1 - 1e-9)
    return out


def leaks(batches: Iterator[pd.DataFrame], tables: list[Items], weights: Weights) -> Iterator[pd.DataFrame]:
    """From (id, text) the rows (id, item_id, n_windows, containment, n_near, similarity).

    Candidates come from the fingerprints, and each is verified by its shingles: windows of equal words count as shared, those of LEAST
    or more as near; for windows of the size of the item the greatest similarity is kept. What a text shares is united over its slices.
    """
    known: dict[str, int] = {}
    for batch in batches:
        keys = batch["id"].tolist()
        shared: dict[tuple[int, int], set[int]] = {}
        near: dict[tuple[int, int], set[int]] = {}
        alike: dict[tuple[int, int], float] = {}
        spans: dict[int, np.ndarray] = {}

        def look(parts: list[np.ndarray], rows: list[int], shared=shared, near=near, alike=alike, spans=spans) -> None:
            owner = np.repeat(np.array(rows, dtype=np.int64), [len(p) for p in parts])
            piece = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            h = np.concatenate(parts)
            sums = bit_sums(h)
            prints: dict[int, np.ndarray] = {}
            for items in tables:
                w = items.window
                if w not in prints:
                    prints[w] = fingerprints(h, w, sums)
                # windows across two texts are left out
                at = np.flatnonzero(piece[: len(prints[w])] == piece[w - 1 :]) if len(prints[w]) else np.zeros(0, dtype=np.int64)
                i, j = candidates(prints[w][at], items)
                if not len(i):
                    continue
                view = np.lib.stride_tricks.sliding_window_view(h, w)
                score = similarities(view[at[i]], items.hashes[j], weights)
                kept = score >= LEAST
                for row, jj, x in zip(owner[at[i[kept]]].tolist(), j[kept].tolist(), score[kept].tolist(), strict=True):
                    pair = (row, int(items.owner[jj]))
                    spans[pair[1]] = items.spans[pair[1]]
                    alike[pair] = max(alike.get(pair, 0.0), x if w != WINDOW else 0.0)
                    if w == WINDOW:
                        (shared if x == 1 else near).setdefault(pair, set()).add(int(items.begin[jj]))

        size, parts, rows = 0, [], []
        longest = max([t.window for t in tables], default=WINDOW)
        for row, text in enumerate(batch["text"]):
            h = word_hashes(words(text), known)
            for lo in range(0, max(1, len(h) - WINDOW + 1), SLICE):
                piece = h[lo : lo + SLICE + longest - 1]
                if len(piece) >= WINDOW:
                    parts.append(piece)
                    rows.append(row)
                    size += len(piece)
                if size >= SLICE:
                    look(parts, rows)
                    size, parts, rows = 0, [], []
        if parts:
            look(parts, rows)
        out = []
        for pair, best in alike.items():
            weight = spans[pair[1]]
            covered = np.zeros(len(weight), dtype=bool)
            for b in shared.get(pair, ()):
                covered[b : b + WINDOW - SHINGLE + 1] = True
            out.append((keys[pair[0]], pair[1], len(shared.get(pair, ())), float(weight[covered].sum() / max(weight.sum(), 1e-12)), len(near.get(pair, set()) - shared.get(pair, set())), best))
        yield pd.DataFrame(out, columns=["id", "item_id", "n_windows", "containment", "n_near", "similarity"])


def shingle_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(part, h): the shingles of each item once, with the part that it is in."""
    known: dict[str, int] = {}
    for batch in batches:
        each = [(part, np.unique(shingles(word_hashes(words(text), known)))) for part, text in zip(batch["part"], batch["text"], strict=True)]
        yield pd.DataFrame({"part": np.repeat([p for p, _ in each], [len(s) for _, s in each]).astype("int32"), "h": (np.concatenate([s for _, s in each]) if each else np.zeros(0, np.uint64)).view(np.int64)})


def leaked_items(corpus: DataFrame, key: str, text: str, items: DataFrame) -> DataFrame:
    """(id, item_id, n_windows, containment, n_near, similarity) of each text and each held-out item that it holds passages of.

    n_windows of the item's windows of WINDOW words are in the text word by word; containment is the share of the item's shingle weight
    in them; n_near more are LEAST alike; similarity is the greatest one of a window of the item's size, 0 below LEAST. items(item_id,
    text) are held-out texts, taken in parts of about ITEM_BYTES and held against the corpus in passes of PASS_WINDOWS windows, without
    a shuffle of the corpus; weights count all items. Texts are read whole. Null, empty and short texts have no row; repeated rows count once.
    """
    held = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    n = max(1, -(-(held.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES))
    held = held.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int"))
    each = held.mapInPandas(shingle_rows, "part int, h long")
    common = each.groupBy("h").agg(F.count("*").alias("n"), F.collect_set("part").alias("parts")).where("n > 1")
    rows = corpus.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    schema = f"id {dict(rows.dtypes)['id']}, item_id long, n_windows long, containment double, n_near long, similarity double"
    wide, found = widened(rows), None
    for part in range(n):
        some = sorted((r[0], r[1]) for r in held.where(F.col("part") == part).select("item_id", "text").collect())
        counts = common.where(F.array_contains("parts", part)).select("h", "n").toPandas()
        h = counts["h"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(h)
        weights = Weights(h[order], 1 / counts["n"].to_numpy(dtype=np.float64)[order])
        tables = index_items(some, weights)
        while tables or found is None:
            one_pass, size = [], 0
            while tables and (not one_pass or size + len(tables[0].prints) <= 2 * PASS_WINDOWS):
                size += len(tables[0].prints)
                one_pass.append(tables.pop(0))
            got = wide.mapInPandas(lambda b, one=one_pass, w=weights: leaks(b, one, w), schema)
            found = got if found is None else found.unionByName(got)
    return found.groupBy("id", "item_id").agg(*(F.max(c).alias(c) for c in ("n_windows", "containment", "n_near", "similarity")))

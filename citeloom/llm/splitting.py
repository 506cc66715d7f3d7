"""Oversized items cut into pieces at natural boundaries, range by range: a worker sees a range of an item and a halo on either side, never the whole of it."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.session import cut

#: Pieces of full length that a range holds.
RANGE_PIECES = 32
# Kinds of boundaries, the best first: a piece may end behind each match.
BOUNDARIES = [re.compile(p) for p in (r"(?:\r?\n[ \t]*){2,}", r"\r?\n", r"[.!?…][\"'”’»)\]]*[ \t]+|[。！？؟][”’」』）]*", r"[;:,،、，；][ \t]+|[、，；]", r"[ \t 　]+")]


def joined(text: str, at: int) -> bool:
    """Whether the characters before and after at belong together: a line end of two, a mark on a letter, a joined emoji."""
    if not 0 < at < len(text):
        return False
    a, b = text[at - 1], text[at]
    return (a == "\r" and b == "\n") or bool(unicodedata.combining(b)) or "‍" in (a, b) or "︀" <= b <= "️"


def best_cut(text: str, low: int, high: int) -> int:
    """The last boundary of the best kind in (low, high]; high itself, moved off joined characters, where the text does not pause."""
    for kind in BOUNDARIES:
        found = [m.end() for m in kind.finditer(text, low, min(len(text), high + 64)) if low < m.end() <= high]
        if found:
            return found[-1]
    at = high
    while at > low + 1 and joined(text, at):
        at -= 1
    return at if not joined(text, at) else high


def overlap_start(text: str, end: int, overlap: int, least: int) -> int:
    """Where the next piece begins: overlap characters before end, or the first word that begins after that."""
    at = max(least, end - overlap)
    if overlap <= 0 or at >= end:
        return end
    m = BOUNDARIES[4].search(text, at, end)
    at = m.end() if m and m.end() - at <= overlap // 4 and m.end() < end else at
    while at > least and joined(text, at):
        at -= 1
    return at


def anchor(text: str, at: int, limit: int, size: int, start: int) -> int:
    """Of a range that begins at at, the first cut: the same whichever of the two neighbouring workers looks for it. Offsets are those of the item; text begins at start."""
    return at if at <= 0 else start + best_cut(text[: at + limit // 2 + 64 - start], at - start, min(at + limit // 2, size) - start) if at < size else size


def cut_range(text: str, start: int, low: int, high: int, size: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """The pieces [begin, end) that end within the range [low, high) of an item of size characters, of which text holds the part from start on."""
    first, last = anchor(text, low, limit, size, start), anchor(text, high, limit, size, start)
    pieces, end = [], first
    while end < last:
        begin = start + overlap_start(text, end - start, overlap, 0) if end else 0
        most = min(begin + limit, last)
        if most < last:
            floor = max(end, begin + limit // 2) - start
            most = start + best_cut(text, floor, most - start)
        pieces.append((begin, most))
        end = most
    return pieces


def cut_part(raw: bytes, start: int, low: int, high: int, size: int, limit: int, overlap: int) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Of the byte range [low, high) of an item of size bytes, of which raw are those from start on: its characters, and its pieces.

    A piece is (begin, end) in bytes of the item and (begin, end) in characters from the range's first one. A character belongs to the
    range that its first byte is in. Bytes that are no UTF-8 are characters of their own.
    """
    skip = next((i for i, b in enumerate(raw[:4]) if b & 0xC0 != 0x80), 0) if start else 0
    text = raw[skip:].decode("utf-8", "surrogateescape")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    width = np.where((points >= 0xDC80) & (points <= 0xDCFF), 1, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))
    offset = np.concatenate([[0], np.cumsum(width)]) + start + skip
    whole = start + len(raw) >= size
    first = int(np.searchsorted(offset, low)) if low else 0
    last = int(np.searchsorted(offset, high)) if high < size else len(text)
    pieces = cut_range(text, 0, first, last, len(text) if whole else len(text) + limit, limit, overlap)
    return last - first, [(int(offset[a]), int(offset[b]), a - first, b - first) for a, b in pieces]


BOUNDARY = "item string, range int, k int, begin long, end long, char_begin long, char_end long, n_chars long, n_pieces int"


def boundary_rows(parts: Iterator[tuple], limit: int, overlap: int) -> pd.DataFrame:
    """The boundary table's rows of (item, range, start, low, high, size, raw): one for each piece, and one for the range with k = -1."""
    out = []
    for item, r, start, low, high, size, raw in parts:
        n_chars, pieces = cut_part(bytes(raw), start, low, high, size, limit, overlap)
        out.append((item, r, -1, low, high, 0, 0, n_chars, len(pieces)))
        out += [(item, r, k, *piece, 0, 0) for k, piece in enumerate(pieces)]
    return pd.DataFrame(out, columns=[c.split()[0] for c in BOUNDARY.split(", ")])


def stitched(boundaries: DataFrame) -> DataFrame:
    """(item, range, piece_no, begin, end, char_begin, char_end) of all pieces: numbers from 0 and characters follow on those of the ranges before, prefix sums over one row a range."""
    table = cut(boundaries.distinct())  # equal rows give equal boundaries
    w = Window.partitionBy("item").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = table.where("k = -1").select("item", "range", F.coalesce(F.sum("n_pieces").over(w), F.lit(0)).alias("before"), F.coalesce(F.sum("n_chars").over(w), F.lit(0)).alias("chars"))
    found = table.where("k >= 0").join(before, ["item", "range"])
    return found.select("item", "range", (F.col("before") + F.col("k")).cast("int").alias("piece_no"), "begin", "end", *((F.col("chars") + F.col(c)).alias(c) for c in ("char_begin", "char_end")))


def ranges(texts: DataFrame, item: Column, text: str, limit: int, overlap: int) -> DataFrame:
    """(item, range, start, low, high, size, raw): the byte ranges of each text with their halos; a range's row has its own bytes only, taken by offset."""
    step, halo = RANGE_PIECES * limit, 4 * (overlap + limit)
    sized = texts.select(item.alias("item"), F.encode(text, "UTF-8").alias("raw")).withColumn("size", F.octet_length("raw").cast("long"))

    def of(r: Column) -> Column:
        low, high = r * step, F.least((r + 1) * step, F.col("size"))
        start = F.greatest(low - halo, F.lit(0).cast("long"))
        return F.struct(r.cast("int").alias("range"), start.alias("start"), low.alias("low"), high.alias("high"), F.substring("raw", start.cast("int") + 1, (F.least(high + halo, F.col("size")) - start).cast("int")).alias("raw"))

    whole = F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / step))
    return sized.select("item", "size", F.explode(F.transform(whole, of)).alias("x")).select("item", "x.range", "x.start", "x.low", "x.high", "size", "x.raw")


def split_texts(texts: DataFrame, keys: Sequence[str], text: str, limit: int = 4000, overlap: int = 200) -> DataFrame:
    """(keys, piece_no, begin, end, piece) of each text over limit characters: pieces of at most limit characters, numbered from 0; begin and end in characters.

    Workers find the boundaries in byte ranges with halos, the boundary tables are stitched, and the pieces are taken by offset from the
    text's bytes. Each piece ends where the text pauses best in its second half (blank line, line, sentence, clause, word), and anywhere
    between characters where it does not pause; each but the first begins with about the last overlap characters of the one before. Null
    texts and texts within the limit have no row. Repeated rows count once; keys may be null; several texts under equal keys are split each.
    """
    item = F.to_json(F.struct(*keys, F.md5("text").alias("text_md5")), {"ignoreNullFields": "false"})
    rows = texts.select(*keys, F.col(text).alias("text")).where(F.length("text") > limit).withColumn("item", item)
    found = stitched(ranges(rows, F.col("item"), "text", limit, overlap).mapInPandas(lambda b: (boundary_rows(x[["item", "range", "start", "low", "high", "size", "raw"]].itertuples(index=False), limit, overlap) for x in b), BOUNDARY))
    # one list of offsets a text
    offsets = found.groupBy("item").agg(F.collect_list(F.struct("piece_no", "begin", "end", "char_begin", "char_end")).alias("o"))
    once = rows.groupBy("item").agg(F.max("text").alias("text")).join(offsets, "item").withColumn("raw", F.encode("text", "UTF-8"))
    piece = F.decode(F.substring("raw", F.col("x.begin").cast("int") + 1, (F.col("x.end") - F.col("x.begin")).cast("int")), "UTF-8")
    schema = ", ".join(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys)
    out = once.select("item", "raw", F.explode("o").alias("x")).withColumn("key", F.from_json("item", schema))
    return out.select(*(F.col(f"key.`{k}`").alias(k) for k in keys), "x.piece_no", F.col("x.char_begin").alias("begin"), F.col("x.char_end").alias("end"), piece.alias("piece"))


def file_ranges(spark: SparkSession, paths: Sequence[str], limit: int) -> DataFrame:
    """(item, range, size): the byte ranges of files, made by Spark from the files' sizes and dealt to tasks of about 64 MB."""
    from pyarrow import fs

    sized = []
    for path in paths:
        system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        sized.append((path, system.get_file_info(inner).size or 0))
    step = RANGE_PIECES * limit
    listed = spark.createDataFrame(sized, "item string, size long").where("size > 0")
    each = listed.select("item", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / step).cast("int"))).alias("range"), "size")
    return each.repartition(max(1, min(10_000, sum(n for _, n in sized) // 64_000_000 + 1), spark.sparkContext.defaultParallelism))


def read_bytes(path: str, low: int, high: int) -> bytes:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_input_file(inner) as f:
        f.seek(low)
        return f.read(high - low)


def split_files(spark: SparkSession, paths: Sequence[str], limit: int = 4000, overlap: int = 200) -> DataFrame:
    """(item, piece_no, begin, end, piece) of UTF-8 files of any size; begin and end in bytes. No worker reads more than a byte range and its halos.

    Files are read through pyarrow, by path or URI: once for the boundaries, once by offset for the pieces. Bytes that are no UTF-8 stay
    in their place and are shown as U+FFFD. A file within the limit is one piece; an empty file has none.
    """
    step, halo = RANGE_PIECES * limit, 4 * (overlap + limit)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = ((path, r, max(0, r * step - halo), r * step, min((r + 1) * step, size), size, read_bytes(path, max(0, r * step - halo), min(size, (r + 1) * step + halo))) for path, r, size in zip(batch["item"], batch["range"].tolist(), batch["size"].tolist(), strict=True))
            yield boundary_rows(rows, limit, overlap)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, pieces in zip(batch["item"], batch["o"], strict=True):
                low, high = min(p["begin"] for p in pieces), max(p["end"] for p in pieces)
                raw = read_bytes(path, low, high)
                out += [(path, p["piece_no"], p["begin"], p["end"], raw[p["begin"] - low : p["end"] - low].decode("utf-8", "replace")) for p in pieces]
            yield pd.DataFrame(out, columns=["item", "piece_no", "begin", "end", "piece"])

    found = stitched(file_ranges(spark, paths, limit).mapInPandas(find, BOUNDARY))
    by_range = found.groupBy("item", "range").agg(F.collect_list(F.struct("piece_no", "begin", "end")).alias("o"))  # as many as a range has
    return by_range.mapInPandas(emit, "item string, piece_no int, begin long, end long, piece string")

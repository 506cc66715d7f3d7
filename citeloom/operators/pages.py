"""Wiki pages and full texts: running heads, links and their checks, duplicates, tables, pieces within budgets, quotes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from citeloom.functions.identifiers import as_column
from citeloom.operators.sets import similar_sets
from citeloom.session import cut, widened

#: Columns of two lines may be so many characters apart and still be one; lines of a table without bars.
TOLERANCE, LEAST_LINES = 2, 2
#: Pages decided in a round; of one matrix; in order one by one; pages from which on a stem counts as common.
HEAD, ROWS, TRIED, COMMON = 4096, 512, 16, 32
SEPARATOR = re.compile(r"\s{2,}")
PAGE_MARK = r"<!-- PAGE:([^>]*?) -->"
# Headings that end an abstract, and those that begin a list of references.
AFTER_ABSTRACT = r"(?:1\.|1 |Introduction|INTRODUCTION|Background|BACKGROUND|Main Text|Methods\n|METHODS)"
REFERENCES = r"(?:References[\n ]|REFERENCES[\n ]|Bibliography\n|BIBLIOGRAPHY\n|References and Notes\n|Literature Cited\n)"


def without_running_heads(pages: DataFrame) -> DataFrame:
    """pages(id, page, text) without first and last lines that stand, page numbers aside, on more than half of the pages of an id."""
    form = lambda c: F.trim(F.regexp_replace(c, r"\d+", "#"))
    p = pages.withColumn("lines", F.split("text", "\n")).withColumn("ends", F.array_distinct(F.array(form(F.element_at("lines", 1)), form(F.element_at("lines", -1)))))
    total = pages.groupBy("id").agg(F.count("*").alias("n"))
    heads = p.select("id", F.explode("ends").alias("line")).where("line <> ''").groupBy("id", "line").agg(F.count("*").alias("k")).join(total, "id").where("2 * k > n").groupBy("id").agg(F.collect_set("line").alias("heads"))
    j = p.join(heads, "id", "left").withColumn("heads", F.coalesce("heads", F.array().cast("array<string>")))
    is_head = lambda x: F.array_contains("heads", form(x))
    kept = F.filter("lines", lambda x, i: ~(((i == 0) | (i == F.size("lines") - 1)) & is_head(x)))
    return j.select("id", "page", F.array_join(kept, "\n").alias("text"))


def page_links(pages: DataFrame) -> DataFrame:
    """(slug, target): the links [[target]] and [[target|name]] of pages(slug, body), in small letters, each once."""
    found = pages.select(F.lower("slug").alias("slug"), F.explode(F.regexp_extract_all("body", F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"))).alias("target"))
    return found.select("slug", F.lower(F.trim("target")).alias("target")).where("target <> ''").distinct()


def lint(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """(kind, slug) of what is wrong with pages(slug, title, body, source): no title, a slug twice, a link to nowhere, no link to it, a source that sources(source) lacks."""
    p = pages.withColumn("slug", F.lower("slug"))
    links, slugs = page_links(pages), p.select("slug").distinct()
    issue = lambda df, kind: df.select(F.lit(kind).alias("kind"), "slug").distinct()
    out = issue(p.where("title is null or trim(title) = ''"), "missing_title")
    out = out.unionByName(issue(p.groupBy("slug").agg(F.count("*").alias("n")).where("n > 1"), "duplicate_slug"))
    out = out.unionByName(issue(links.join(slugs.withColumnRenamed("slug", "target"), "target", "left_anti"), "broken_link"))
    out = out.unionByName(issue(slugs.join(links.where("slug <> target").select(F.col("target").alias("slug")), "slug", "left_anti"), "orphan"))
    return out.unionByName(issue(p.where("source is null").select("slug").unionByName(p.where("source is not null").join(sources, "source", "left_anti").select("slug")), "ungrounded"))


def page_duplicates(pages: DataFrame, least: float = 0.5, shared: int = 2) -> DataFrame:
    """(a, b): places a < b of pages(place, slug, kind, stems, sources) of one kind, but authors', with equal slugs, stems alike, or shared sources."""
    p = pages.where("kind <> 'author'")
    s = p.select("place", "kind", F.lower("slug").alias("slug"))
    by_slug = s.toDF("a", "kind", "slug").join(s.toDF("b", "kind", "slug"), ["kind", "slug"]).where("a < b").select("a", "b")
    by_stems = similar_sets(p.select("place", F.transform(F.array_distinct("stems"), lambda w: F.concat("kind", F.lit("\x01"), w)).alias("stems")), "place", "stems", least).select("a", "b")
    k = p.select("place", "kind", F.explode(F.array_distinct("sources")).alias("source")).where("source is not null")
    k = k.join(k.groupBy("kind", "source").agg(F.count("*").alias("n")).where("n > 1").select("kind", "source"), ["kind", "source"])
    by_source = k.toDF("kind", "source", "a").join(k.toDF("kind", "source", "b"), ["kind", "source"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= shared).select("a", "b")
    return by_slug.unionByName(by_stems).unionByName(by_source).distinct()


class Kept:
    """Pages (slug, stems, sources) that stand, in order, indexed to tell the first of which others are duplicates: equal slugs, stems alike, or shared sources."""

    def __init__(self, pages: list[tuple], least: float, shared: int):
        self.least, self.shared, self.n = least, shared, len(pages)
        self.slug: dict[str, int] = {}
        for k, (slug, _, _) in enumerate(pages):
            if slug is not None:
                self.slug.setdefault(slug, k)
        self.size = np.array([len(stems) for _, stems, _ in pages], np.float32)
        self.stems, self.sources = (postings([page[c] for page in pages]) for c in (1, 2))
        common = [w for w, at in self.stems.items() if len(at) > COMMON]
        self.common = {w: k for k, w in enumerate(common)}
        self.matrix = np.zeros((len(common), self.n), np.float32)
        for k, w in enumerate(common):
            self.matrix[k, self.stems.pop(w)] = 1

    def first(self, pages: list[tuple]) -> np.ndarray:
        """Of each page the number of the first one kept that it is a duplicate of; the number of all where there is none."""
        out = np.full(len(pages), self.n)
        if not self.n or not pages:
            return out
        for lo in range(0, len(pages), ROWS):
            some = pages[lo : lo + ROWS]
            shared = self.common_items([p[1] for p in some])
            size = np.array([len(p[1]) for p in some], np.float32)
            alike = shared >= np.maximum(np.float32(self.least / (1 + self.least)) * (size[:, None] + self.size[None]) - np.float32(1e-3), 0.5)
            for row, (slug, _, sources) in enumerate(some):
                if sum(w in self.sources for w in sources) >= self.shared:
                    alike[row] |= np.bincount(np.concatenate([self.sources[w] for w in sources if w in self.sources]), minlength=self.n) >= self.shared
                if slug in self.slug:
                    alike[row, self.slug[slug]] = True
            out[lo : lo + ROWS] = np.where(alike.any(1), alike.argmax(1), self.n)
        return out

    def common_items(self, sets: list[list[str]]) -> np.ndarray:
        """(page, kept page): how many stems both have: common ones by a matrix product, others by lists."""
        has = np.zeros((len(sets), len(self.common)), np.float32)
        rows, at = [], []
        for row, stems in enumerate(sets):
            for w in stems:
                if (k := self.common.get(w)) is not None:
                    has[row, k] = 1
                elif (found := self.stems.get(w)) is not None:
                    rows.append(row)
                    at.append(found)
        out = has @ self.matrix
        if at:
            np.add.at(out.ravel(), np.repeat(rows, [len(x) for x in at]) * self.n + np.concatenate(at), 1)
        return out


def postings(sets: list[list[str]]) -> dict[str, np.ndarray]:
    """Of each item the sets that have it."""
    out: dict[str, list[int]] = {}
    for k, items in enumerate(sets):
        for w in items:
            out.setdefault(w, []).append(k)
    return {w: np.array(at) for w, at in out.items()}


def first_in_order(pages: list[tuple], least: float, shared: int) -> tuple[list[int], list[tuple[int, int]]]:
    """(kept, taken): which of pages(slug, stems, sources) in order stand, and which are duplicates of which of these: each page that is left takes in the later ones that are its duplicates."""
    kept: list[int] = []
    taken: list[tuple[int, int]] = []
    for lo in range(0, len(pages), ROWS):
        some = pages[lo : lo + ROWS]
        before = Kept([pages[k] for k in kept], least, shared).first(some)
        taken += [(lo + row, kept[k]) for row, k in enumerate(before) if k < len(kept)]
        left = [lo + row for row, k in enumerate(before) if k == len(kept)]
        while left:  # the first one that is left stands; a few more are tried at a time
            tried: list[int] = []
            for at in left[:TRIED]:
                k = int(Kept([pages[x] for x in tried], least, shared).first([pages[at]])[0])
                if k < len(tried):
                    taken.append((at, tried[k]))
                else:
                    tried.append(at)
            kept += tried
            rest = left[TRIED:]
            found = Kept([pages[x] for x in tried], least, shared).first([pages[x] for x in rest])
            taken += [(at, tried[k]) for at, k in zip(rest, found, strict=True) if k < len(tried)]
            left = [at for at, k in zip(rest, found, strict=True) if k == len(tried)]
    return kept, taken


def consolidated(pages: DataFrame, least: float = 0.5, shared: int = 2) -> DataFrame:
    """(place, canonical) of pages(place, slug, kind, stems, sources), one a place: which page each duplicate, as in page_duplicates, is merged into: the earliest one that is none itself.

    In rounds the first HEAD pages that are left are decided in order, and those of them that stand take their duplicates from all
    later pages. No pair of pages is kept; the driver holds HEAD pages at a time.
    """
    of_kind = lambda c: F.concat("kind", F.lit("\x01"), c)
    items = lambda c: F.coalesce(F.transform(F.filter(F.array_distinct(c), lambda x: x.isNotNull()), of_kind), F.array().cast("array<string>"))
    left = cut(pages.where("kind <> 'author' and place is not null").select("place", of_kind(F.lower("slug")).alias("slug"), items("stems").alias("stems"), items("sources").alias("sources")))
    kind = dict(left.dtypes)["place"]
    spark, found = pages.sparkSession, []
    while head := left.orderBy("place").limit(HEAD).collect():
        stand, taken = first_in_order([tuple(r)[1:] for r in head], least, shared)
        found.append(spark.createDataFrame([(head[b][0], head[a][0]) for b, a in taken], f"place {kind}, canonical {kind}"))
        if len(head) < HEAD:
            break
        index, places = Kept([tuple(head[k])[1:] for k in stand], least, shared), [head[k][0] for k in stand]

        def work(batches: Iterator[pa.RecordBatch], index: Kept = index, places: list = places) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                first = index.first(list(zip(*(batch.column(c).to_pylist() for c in ("slug", "stems", "sources")), strict=True)))
                column = pa.array([places[k] if k < len(places) else None for k in first.tolist()], batch.schema.field("place").type)
                yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "canonical"])

        rest = widened(left.where(F.col("place") > F.lit(head[-1][0])))
        matched = cut(rest.mapInArrow(work, f"place {kind}, slug string, stems array<string>, sources array<string>, canonical {kind}"))
        found.append(matched.where("canonical is not null").select("place", "canonical"))
        left = matched.where("canonical is null").drop("canonical")
    return reduce(DataFrame.unionByName, found) if found else left.select("place", F.col("place").alias("canonical"))


def last_by_slug(pages: DataFrame) -> DataFrame:
    """pages(place, slug, body): of each slug the last body at the first place."""
    return pages.groupBy("slug").agg(F.min("place").alias("place"), F.max_by("body", "place").alias("body"))


def split_pages(c: Column | str) -> Column:
    """(slug, body) of the pages in one text, each behind its mark; those without slug or body left out."""
    parts = F.split(as_column(c), r"(?=<!-- PAGE:)")
    pages = F.transform(parts, lambda x: F.struct(F.trim(F.regexp_extract(x, PAGE_MARK, 1)).alias("slug"), F.regexp_replace(F.regexp_replace(x, PAGE_MARK, ""), r"^\s+|\s+$", "").alias("body")))
    return F.filter(pages, lambda p: (p["slug"] != "") & (p["body"] != ""))


def without_abstract(c: Column | str) -> Column:
    """A text without what stands from an abstract's heading to the next one."""
    return F.regexp_replace(as_column(c), rf"(?s)^(.*?\n)(?:abstract|Abstract|ABSTRACT)[\n ].*?(?=\n{AFTER_ABSTRACT})", "$1")


def without_references(c: Column | str) -> Column:
    """A text without the references that begin in its second half."""
    text = as_column(c)
    head = F.regexp_extract(text, rf"(?s)^(.*)\n{REFERENCES}", 1)
    return F.when((head != "") & (F.octet_length(head) > F.octet_length(text) / 2), head).otherwise(text)


def first_words(c: Column | str, most: int) -> Column:
    """At most most words of a text, joined by single blanks where it has more."""
    words = F.filter(F.split(as_column(c), r"\s+"), lambda w: w != "")
    return F.when(F.size(words) <= most, as_column(c)).otherwise(F.array_join(F.slice(words, 1, most), " "))


def grounded(quotes: Column, source: Column) -> Column:
    """The quotes that stand in a source, case and blanks aside, each once, in the source's order."""
    form = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+", " "))
    whole = form(source)
    at = F.transform(quotes, lambda q, i: F.struct(F.instr(whole, form(q)).alias("at"), i.alias("i"), F.regexp_replace(q, r"^\s+|\s+$", "").alias("q"), form(q).alias("f")))
    found = F.filter(F.array_sort(at), lambda x: (x["at"] > 0) & (x["f"] != ""))
    return F.transform(F.filter(found, lambda x: ~F.exists(found, lambda y: (y["f"] == x["f"]) & (y["i"] < x["i"]))), lambda x: x["q"])


def gfm_tables(text: str) -> tuple[str, list[str]]:
    """The text with its tables taken out, a numbered mark for each, and the tables as Markdown: lines with bars, or lines whose wide gaps are aligned."""
    lines, out, tables, i = text.splitlines(), [], [], 0
    while i < len(lines):
        n = table_lines(lines, i)
        if not n:
            out.append(lines[i])
            i += 1
            continue
        block = lines[i : i + n]
        barred = "|" in block[0]
        rows = [[c.strip() for c in (line.strip().strip("|").split("|") if barred else SEPARATOR.split(line.strip()))] for line in block]
        width = max(len(r) for r in rows)
        cells = [r + [""] * (width - len(r)) for r in rows]
        tables.append("\n".join("| " + " | ".join(r) + " |" for r in [cells[0], ["---"] * width, *cells[1:]]))
        out.append(f"<!-- TABLE:{len(tables)} -->")
        i += n
    return "\n".join(out), tables


def table_lines(lines: list[str], start: int) -> int:
    """How many lines from start on are one table; 0 for none."""
    if "|" in lines[start]:
        end = start
        while end < len(lines) and "|" in lines[end]:
            end += 1
        return end - start
    places: list[list[int]] = []
    for line in lines[start:]:
        gaps = [m.start() for m in SEPARATOR.finditer(line.rstrip()) if m.start()]
        if len(gaps) < 2:
            break
        places.append(gaps)
    near = lambda a, b: all(any(abs(x - y) <= TOLERANCE for y in b) for x in a)
    return len(places) if len(places) >= LEAST_LINES and all(near(p, places[0]) and near(places[0], p) for p in places[1:]) else 0


def table_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(id, number, table) of the tables in texts, as Markdown."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(k, i, t) for k, text in zip(batch["id"], batch["text"], strict=True) for i, t in enumerate(gfm_tables(text)[1], 1)], columns=["id", "number", "table"])

    kept = rows.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    return kept.mapInPandas(work, f"id {dict(kept.dtypes)['id']}, number int, table string")


def within_budget(text: str, most: int) -> list[str]:
    """Pieces of at most most words: the text, else whole sentences put together, else words."""
    if most <= 0 or len(text.split()) <= most:
        return [text]
    out: list[str] = []
    current: list[str] = []
    count = 0
    for sentence in (s.strip() for s in re.findall(r"[^.!?]*[.!?]|[^.!?]+$", text)):
        words = sentence.split()
        if count + len(words) > most and current:
            out.append(" ".join(current))
            current, count = [], 0
        if len(words) > most:
            out += [" ".join(words[i : i + most]) for i in range(0, len(words), most)]
        elif words:
            current.append(sentence)
            count += len(words)
    return out + ([" ".join(current)] if current else [])


def budget_pieces(rows: DataFrame, keys: list[str], text: str, most: int) -> DataFrame:
    """(keys, piece_no, piece, n_words) of texts cut to at most most words."""
    kept = rows.select(*keys, F.col(text).alias("text")).where(r"text rlike '\\S'")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(*k, i, p, len(p.split())) for *k, t in batch.itertuples(index=False) for i, p in enumerate(within_budget(t, most))]
            yield pd.DataFrame(out, columns=[*keys, "piece_no", "piece", "n_words"])

    schema = ", ".join(f"`{k}` {dict(kept.dtypes)[k]}" for k in keys)
    return kept.mapInPandas(work, f"{schema}, piece_no int, piece string, n_words int")


def batches(rows: DataFrame, size: str, most_items: int, most_size: int) -> DataFrame:
    """rows with a batch each: in the order of each partition as many as fit most_items and most_size; a larger one is alone. Partitions are packed by themselves."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, number, items, used = TaskContext.get().partitionId(), 0, 0, 0
        for frame in frames:
            ids = []
            for n in frame[size]:
                if items and (items >= most_items or used + n > most_size):
                    number, items, used = number + 1, 0, 0
                items, used = items + 1, used + n
                ids.append(f"{part}-{number}")
            yield frame.assign(batch=ids)

    return rows.mapInPandas(work, StructType([*rows.schema.fields, StructField("batch", StringType())]))


def evidence(articles: DataFrame, by_words: DataFrame, by_vector: DataFrame, abstracts: DataFrame) -> DataFrame:
    """(article_id, source, passage) of articles(article_id): the passage that holds the claim's words, else the one whose vector is nearest, else the abstract; each of (article_id, passage)."""
    j = articles.select("article_id")
    for name, df in (("words", by_words), ("vector", by_vector), ("abstract", abstracts)):
        j = j.join(df.select("article_id", F.col("passage").alias(name)), "article_id", "left")
    kind = F.when(F.col("words").isNotNull(), "words").when(F.col("vector").isNotNull(), "vector").when(F.col("abstract").isNotNull(), "abstract")
    return j.select("article_id", kind.alias("source"), F.coalesce("words", "vector", "abstract").alias("passage")).where("source is not null")

"""BibTeX entries: a parser for nested braces, quotes, macros and comments; records; a writer with unique keys."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Kinds of entries and of references, and months.
KINDS = {"article": "JOUR", "book": "BOOK", "booklet": "BOOK", "inbook": "CHAP", "incollection": "CHAP", "inproceedings": "CONF", "conference": "CONF", "proceedings": "CONF", "phdthesis": "THES", "mastersthesis": "THES", "techreport": "RPRT", "online": "ELEC", "electronic": "ELEC", "misc": "GEN", "unpublished": "GEN", "manual": "GEN"}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
SKIPPED = ("comment", "preamble")


class Broken(Exception):
    pass


class Reader:
    """A cursor over a text."""

    def __init__(self, text: str):
        self.text, self.at, self.macros = text, 0, {m: str(i + 1) for i, m in enumerate(MONTHS)}

    def blanks(self) -> None:
        while m := re.compile(r"\s+|%[^\n]*\n?").match(self.text, self.at):
            self.at = m.end()

    def braced(self) -> str:
        depth, start = 0, self.at + 1
        for i in range(self.at, len(self.text)):
            c = self.text[i]
            if c == "\\":
                continue
            if c in "{}" and self.text[i - 1 : i] != "\\":
                depth += 1 if c == "{" else -1
                if not depth:
                    self.at = i + 1
                    return self.text[start:i]
        raise Broken("unclosed brace")

    def quoted(self) -> str:
        depth, start, i = 0, self.at + 1, self.at + 1
        while i < len(self.text):
            c = self.text[i]
            if c == "\\":
                i += 2
                continue
            depth += (c == "{") - (c == "}")
            if c == '"' and not depth:
                if self.text[i + 1 : i + 2] == '"':
                    i += 2
                    continue
                self.at = i + 1
                return self.text[start:i].replace('""', '"').replace('\\"', '"')
            i += 1
        raise Broken("unclosed quote")

    def value(self) -> str:
        parts = []
        while True:
            self.blanks()
            c = self.text[self.at : self.at + 1]
            if c == "{":
                parts.append(self.braced())
            elif c == '"':
                parts.append(self.quoted())
            elif m := re.compile(r"[^\s,{}#\"=]+").match(self.text, self.at):
                self.at = m.end()
                parts.append(self.macros.get(m.group().lower(), m.group()))
            else:
                raise Broken("no value")
            self.blanks()
            if self.text[self.at : self.at + 1] != "#":
                return "".join(parts)
            self.at += 1

    def fields(self, close: str) -> list[tuple[str, str]]:
        out = []
        while True:
            self.blanks()
            c = self.text[self.at : self.at + 1]
            if c == close:
                self.at += 1
                return out
            if c == ",":
                self.at += 1
                continue
            m = re.compile(r"([^\s=,{}]+)\s*=").match(self.text, self.at)
            if not m:
                raise Broken("no field")
            self.at = m.end()
            out.append((m.group(1).lower(), self.value()))


def parse(text: str) -> tuple[list[tuple[str, str, list[tuple[str, str]]]], list[str]]:
    """(entries, errors) of a text: each entry (kind, key, [(field, value)]). An entry that breaks off is an error; reading goes on at the next '@'."""
    r, entries, errors = Reader(text), [], []
    while m := re.compile(r"@\s*([A-Za-z]+)\s*([{(])").search(text, r.at):
        kind, r.at = m.group(1).lower(), m.end()
        close = "}" if m.group(2) == "{" else ")"
        try:
            if kind in SKIPPED:
                if close == "}":
                    r.at -= 1
                    r.braced()
                continue
            if kind == "string":
                r.macros |= dict(r.fields(close))
                continue
            k = re.compile(r"\s*([^\s,{}()=]*)\s*,?").match(text, r.at)
            r.at = k.end()
            entries.append((kind, k.group(1), r.fields(close)))
        except Broken as e:
            errors.append(f"{kind}: {e}")
            nxt = re.compile(r"\n\s*@").search(text, m.end())
            r.at = nxt.start() if nxt else len(text)
    return entries, errors


def plain(value: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"\\([{}&%$#_])", r"\1", re.sub(r"(?<!\\)[{}]", "", value))).strip()


def record(kind: str, key: str, fields: list[tuple[str, str]]) -> tuple:
    f = {k: plain(v) for k, v in reversed(fields)}
    pick = lambda *names: next((f[n] for n in names if f.get(n)), None)
    pages = re.split(r"\s*-{1,3}\s*|\s*–\s*", f.get("pages", ""), maxsplit=1)
    year = re.match(r"\s*(\d{4})", pick("year", "date") or "")
    authors = [a for a in (plain(x) for x in re.split(r"\s+and\s+", dict(reversed(fields)).get("author", ""))) if a]
    keywords = [k for k in (x.strip() for x in re.split(r"[;,]", f.get("keywords", ""))) if k]
    return (key, KINDS.get(kind, "GEN"), pick("title"), pick("abstract", "annote"), authors, int(year.group(1)) if year else None, pick("doi"), pick("journal", "journaltitle", "booktitle"), pick("volume"), pick("number", "issue"), pages[0] or None, pages[1] if len(pages) > 1 else None, keywords, pick("url"), pick("language"), pick("publisher", "school", "institution", "organization"))


SCHEMA = "key string, reference_type string, title string, abstract_text string, authors array<string>, publication_year int, doi string, journal string, volume string, issue string, start_page string, end_page string, keywords array<string>, url string, language string, publisher string"


def parse_texts(rows: DataFrame, text: str) -> DataFrame:
    """The records of BibTeX texts in a column; null and broken texts give those that can be read."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            yield pd.DataFrame([record(*e) for t in batch["text"] for e in parse(t)[0]], columns=names).astype({"publication_year": "Int32"})

    return rows.select(F.col(text).alias("text")).where("text is not null").mapInPandas(work, SCHEMA)


def read_bibtex(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of BibTeX files. A file is read whole, as macros hold for the rest of it."""
    return parse_texts(spark.read.text(list(paths), wholetext=True), "value")


def citation_key(authors: Column, year: Column, title: Column, stop: list[str]) -> Column:
    """Surname, year and first significant word of the title, in ASCII letters and digits; 'anon' and 'nd' stand in."""
    accents = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    bare = lambda c: F.regexp_replace(F.translate(F.lower(c), *accents), "[^a-z0-9]", "")
    first = F.trim(F.get(authors, F.lit(0)))
    surname = bare(F.when(first.contains(","), F.substring_index(first, ",", 1)).otherwise(F.element_at(F.split(first, r"\s+"), -1)))
    words = F.filter(F.transform(F.split(F.coalesce(title, F.lit("")), r"\s+"), bare), lambda w: (w != "") & ~w.isin(stop))
    return F.concat(F.coalesce(F.nullif(surname, F.lit("")), F.lit("anon")), F.coalesce(year.cast("string"), F.lit("nd")), F.coalesce(F.get(words, F.lit(0)), F.lit("")))


def unique_keys(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with the second of equal keys marked 'b', the third 'c' and so on, 'z' at most."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_n", n).withColumn(key, F.when(F.col("_n") == 1, F.col(key)).otherwise(F.concat(F.col(key), F.char(F.lit(96) + F.least("_n", F.lit(26)))))).drop("_n")


def write_entry(key: Column, kind: Column, fields: dict[str, Column]) -> Column:
    """An entry's text; blank fields are left out, braces escaped."""
    line = lambda name, c: F.when(F.trim(c) != "", F.concat(F.lit(f"  {name} = {{"), F.regexp_replace(F.trim(c), r"([{}])", r"\\$1"), F.lit("}")))
    return F.concat(F.lit("@"), kind, F.lit("{"), F.concat_ws(",\n", key, *(line(n, c) for n, c in fields.items())), F.lit("\n}\n"))

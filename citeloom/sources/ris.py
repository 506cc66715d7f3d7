"""RIS records: read from files or columns, written as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.identifiers import as_column, normalize_doi
from citeloom.functions.text import normalize_issn

# Kinds of references and the names they go by, in lower case.
TYPES = {
    "JOUR": "jour|journal|journal article|article|journalarticle|article in journal|pap|papel", "BOOK": "book|whole book|wholebook", "CHAP": "chap|book section|booksection|book chapter|bookchapter|chapter",
    "CONF": "conf|conference paper|conferencepaper|conference proceedings|conferenceproceedings|proceedings|conference", "THES": "thes|thesis|dissertation|phd thesis|master's thesis|msc thesis", "RPRT": "rprt|report|tech report|technical report|techreport",
    "ELEC": "elec|electronic article|electronicarticle|electronic source|electronicsource|online|online resource|e-article|web|web page|webpage|website|www|internet", "NEWS": "news|newspaper article|newspaperarticle|newspaper", "PAT": "pat|patent", "GEN": "gen|generic|unspecified|other|misc", "AV": "av|audiovisual|video|film", "ART": "art|artwork",
    "CASE": "case|legal case|legalcase|court case", "BILL": "bill|legislation", "STAT": "stat|statute", "HEAR": "hear|hearing", "COMP": "comp|computer program|computerprogram|software", "DICT": "dict|dictionary", "ENCYC": "encyc|encyclopedia", "UNBILL": "unbill|unenacted bill", "MUSIC": "music|musical score|musicscore", "CLASSIC": "classic|classic work",
}
KNOWN_TAGS = "TY TI T1 AB N2 AU PY DO JF T2 JO VL IS SP EP C7 KW UR LA PB PU SN EI M3 DA AD AN C3 J9 JI N1 PA PI WE ER".split()


def reference_type(c: Column | str) -> Column:
    """The code that a name of a kind stands for; another name in upper case."""
    raw = F.trim(as_column(c))
    names = F.create_map(*(F.lit(x) for code, all_names in TYPES.items() for name in all_names.split("|") for x in (name, code)))
    return F.coalesce(names[F.lower(raw)], F.upper(raw))


def tag_lines(record: Column | str) -> Column:
    """The record's (tag, value) pairs in order: line ends of any kind, fused tags parted, continuation lines joined to the line before."""
    text = F.regexp_replace(F.regexp_replace(as_column(record), "^﻿", ""), r"\r\n?", "\n")
    text = F.regexp_replace(text, r"(?<=\S) +(?=[A-Z]{2}  - )", "\n")
    text = F.regexp_replace(text, r"\n(?![A-Z][A-Z0-9]  -)", "\u0001")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^[A-Z][A-Z0-9]  -"))
    return F.transform(lines, lambda x: F.struct(F.substring(x, 1, 2).alias("tag"), F.replace(F.trim(F.regexp_replace(F.substring(x, 6, 1 << 30), "[\u0001\\s]+$", "")), F.lit("\u0001"), F.lit("\n")).alias("value")))


def parse_records(rows: DataFrame, record: str = "record") -> DataFrame:
    """The canonical columns of RIS records in a column; other columns stay. Text without a tag line gives nulls and empty lists."""
    kept = [c for c in rows.columns if c != record]
    t = rows.select(*kept, tag_lines(record).alias("_t"))
    values = lambda *tags: F.transform(F.filter("_t", lambda x: x["tag"].isin(list(tags))), lambda x: x["value"])
    first = lambda tag: F.get(values(tag), F.lit(0))
    last = lambda *tags: F.try_element_at(values(*tags), F.lit(-1))
    joined = lambda tag: F.when(F.size(values(tag)) > 0, F.array_join(values(tag), "; "))
    issns = F.filter(F.transform(F.filter("_t", lambda x: x["tag"] == "SN"), lambda x: normalize_issn(x["value"])), lambda x: x != "")
    ei = F.filter(F.transform(values("EI"), lambda x: normalize_issn(x)), lambda x: x != "")
    note = last("N1")
    number = lambda label: F.regexp_extract(note, rf"{label}:\s*(\d+)", 1).try_cast("int")
    extras = F.filter("_t", lambda x: ~x["tag"].isin(KNOWN_TAGS))
    return t.select(
        *kept, F.coalesce(reference_type(last("TY")), reference_type(first("M3"))).alias("reference_type"), last("TI", "T1").alias("title"), F.coalesce(last("AB"), first("N2")).alias("abstract_text"), values("AU").alias("authors"),
        F.regexp_extract(last("PY"), r"^\s*([+-]?\d+)\s*(?:/|$)", 1).try_cast("int").alias("publication_year"), normalize_doi(last("DO")).alias("doi"), F.coalesce(last("JF"), first("T2"), first("JO")).alias("journal"), last("J9").alias("journal_abbreviation"), last("JI").alias("journal_iso_abbreviation"),
        last("VL").alias("volume"), last("IS").alias("issue"), F.coalesce(last("SP"), first("C7")).alias("start_page"), last("EP").alias("end_page"), values("KW").alias("keywords"), last("UR").alias("url"), last("LA").alias("language"), F.coalesce(last("PB"), first("PU")).alias("publisher"),
        F.get(issns, F.lit(0)).alias("issn"), F.coalesce(F.get(issns, F.lit(1)), F.get(ei, F.lit(0))).alias("eissn"), last("DA").alias("date"), joined("AD").alias("author_address"), joined("C3").alias("custom_field3"), last("AN").alias("accession_number"), note.alias("notes"),
        number("Total Times Cited").alias("num_cited"), number("Cited Reference Count").alias("num_references"),
        F.map_from_entries(F.transform(F.array_distinct(F.transform(extras, lambda x: x["tag"])), lambda k: F.struct(k, F.transform(F.filter(extras, lambda x: x["tag"] == k), lambda x: x["value"])))).alias("extras"),
    )


def read_ris(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of RIS files, with terminated (false for a record without its end mark). The end mark is the reader's record separator, so that large files are split."""
    raw = spark.read.option("lineSep", "\nER  -").text(list(paths)).select(F.col("value").alias("raw"))
    parts = raw.select(F.filter(F.split(F.regexp_replace("raw", r"\r\n?", "\n"), r"\n(?=TY  -)"), lambda x: x.rlike(r"(?m)^\x{FEFF}?\s*TY  -")).alias("p"))
    each = parts.select(F.posexplode("p").alias("k", "record"), F.size("p").alias("n"))
    return parse_records(each.select(F.regexp_replace("record", r"^\s+", "").alias("record"), (F.col("k") == F.col("n") - 1).alias("terminated")))


def write_record(fields: dict[str, Column], lists: dict[str, Column]) -> Column:
    """The text of a record: a line for each field that is not blank, in the given order, a line for each element of lists."""
    line = lambda tag, c: F.when(F.trim(c) != "", F.concat(F.lit(f"{tag}  - "), c))
    singles = [F.array(line(tag, c)) for tag, c in fields.items()]
    many = [F.coalesce(_tagged(tag, c), F.array().cast("array<string>")) for tag, c in lists.items()]
    return F.concat(F.array_join(F.array_compact(F.concat(*singles[:1], *many[:1], *singles[1:], *many[1:])), "\n"), F.lit("\nER  - \n"))


def _tagged(tag: str, c: Column) -> Column:
    return F.transform(F.filter(c, lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit(f"{tag}  - "), x))

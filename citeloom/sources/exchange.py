"""What goes into and out of the library as a whole: project files, legacy files, journal lists, files named by DOI; wiki pages, vaults, networks, item lists, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.identifiers import as_column, normalize_doi
from citeloom.functions.text import normalize_title
from citeloom.session import scratch_dir
from citeloom.sources.catalog import to_camel

JOURNALS = "journal_title string, issn string, eissn string, publisher_name string"


def file_doi(name: Column | str) -> Column:
    """(doi, kind) of a file named by a DOI, its slash an underscore: '10.1000_x_references.ris' has references, '..._citations.ris' citations."""
    c = F.regexp_replace(as_column(name), r"^.*[/\\]", "")
    base = F.regexp_extract(c, r"^(.*)_(references|citations)\.[A-Za-z]+$", 1)
    return F.struct(F.nullif(normalize_doi(F.regexp_replace(base, r"^([^_]+)_", "$1/")), F.lit("")).alias("doi"), F.regexp_extract(c, r"_(references|citations)\.[A-Za-z]+$", 1).alias("kind"))


def read_journals(spark: SparkSession, *paths: str) -> DataFrame:
    """The journal list of CSV files with a header, rows without a title left out."""
    return spark.read.schema(JOURNALS).option("header", True).csv(list(paths)).where("trim(journal_title) <> ''")


def snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def write_project(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as JSON lines with names in camel case, in its own folder: a project of any size, written by all tasks."""
    for name, rows in tables.items():
        to_camel(rows).write.mode("overwrite").json(f"{folder}/{name}")


def read_project(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables that write_project wrote, with names in snake case; schemas are of the written names."""
    out = {}
    for name, schema in schemas.items():
        rows = spark.read.schema(schema).json(f"{folder}/{name}")
        out[name] = rows.toDF(*(snake(c) for c in rows.columns))
    return out


def merge_import(existing: DataFrame, incoming: DataFrame, key: Column, children: DataFrame, parent: str) -> tuple[DataFrame, DataFrame]:
    """(rows that are new, children with their parent's id as it is in the library): incoming rows whose key an existing row has are not inserted, and what refers to them is moved to it."""
    known = existing.select(key.alias("_k"), F.col("id").alias("_to")).where("_k is not null").groupBy("_k").agg(F.min("_to").alias("_to"))
    keyed = incoming.withColumn("_k", key)
    moved = keyed.join(known, "_k").select(F.col("id").alias("_from"), "_to").distinct()
    same = existing.select("id")
    new = keyed.join(known, "_k", "left_anti").drop("_k").join(same, "id", "left_anti")
    remapped = children.join(moved, F.col(parent) == F.col("_from"), "left").withColumn(parent, F.coalesce("_to", parent)).drop("_from", "_to")
    return new, remapped.distinct()


def collapse_legacy(papers: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers of an old file, one for each DOI, else for each title, and the links rewritten to them: the smallest id stays."""
    title = normalize_title("title")
    key = F.coalesce(F.concat(F.lit("d:"), normalize_doi("doi")), F.when(title != "", F.concat(F.lit("t:"), title)), F.concat(F.lit("i:"), "id"))
    keyed = papers.withColumn("_k", key)
    home = keyed.groupBy("_k").agg(F.min("id").alias("_to"))
    to = keyed.join(home, "_k").select("id", "_to")
    kept = papers.join(to.where("id = _to").select("id"), "id", "left_semi")
    rewritten = links.join(to, links["paper"] == to["id"], "left").select("parent", F.coalesce("_to", "paper").alias("paper"), "type").distinct()
    return kept, rewritten


def catalogue_filter(year_from: int | None = None, year_to: int | None = None, types: Sequence[str] = (), language: str | None = None, open_access: bool = False, retracted: bool = False) -> str:
    """The filter of a catalogue search as its address carries it."""
    out = ["has_abstract:true"] + ([] if retracted else ["is_retracted:false"])
    if year_from and year_to:
        out.append(f"publication_year:{year_from}-{year_to}")
    elif year_from or year_to:
        out.append(f"publication_year:{f'>{year_from}' if year_from else f'<{year_to}'}")
    out += ([f"type:{'|'.join(types)}"] if types else []) + ([f"language:{language}"] if language else []) + (["is_oa:true"] if open_access else [])
    return ",".join(out)


def catalogue_predicate(year_from: int | None = None, year_to: int | None = None, types: Sequence[str] = (), language: str | None = None) -> Column:
    """The same filter on works that are in the library: columns abstract_text, publication_year, reference_type, language."""
    out = F.coalesce(F.trim("abstract_text") != "", F.lit(False))
    y = F.col("publication_year")
    if year_from and year_to:
        out = out & y.between(year_from, year_to)
    elif year_from or year_to:
        out = out & (y > year_from if year_from else y < year_to)
    if types:
        out = out & F.col("reference_type").isin(list(types))
    return out & (F.col("language") == language) if language else out


def selection(rows: DataFrame, status: str | None = None, ids: DataFrame | None = None, errors: bool = False) -> DataFrame:
    """The articles of an export: all, of a status, of given ids, or those worked on though screened (a column screened)."""
    out = rows if status is None else rows.where(F.col("status") == status)
    out = out.where("status = 'working' and screened") if errors else out
    return out if ids is None else out.join(ids, "id", "left_semi")


def article_page(summary: Column, title: Column, abstract: Column) -> Column:
    """The Markdown page of an article: its summary (the fields of a JSON object as sections, or plain text), else its abstract. Full texts are not written."""
    parsed = F.when(F.trim(summary).startswith("{"), F.from_json(summary, "map<string,string>"))
    parts = F.array_join(F.transform(F.array_sort(F.map_entries(parsed)), lambda e: F.concat(F.lit("## "), e["key"], F.lit("\n\n"), e["value"])), "\n\n")
    plain = F.when((F.trim(summary) != "") & ~F.trim(summary).startswith("{"), summary)
    return F.concat(F.lit("# "), F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(F.nullif(parts, F.lit("")), plain, abstract, F.lit("")))


def vault_pages(pages: DataFrame, names: DataFrame, body: str) -> DataFrame:
    """pages(slug, body) with links [[slug]] rewritten to the names(slug, name) of a vault; unknown links keep their target."""
    pieces = pages.select("slug", F.posexplode(F.split(body, r"(?=\[\[)|(?<=\]\])")).alias("at", "piece")).withColumn("target", F.lower(F.regexp_extract("piece", r"^\[\[([^\]|]+)(?:\|[^\]]*)?\]\]$", 1)))
    named = pieces.join(names.select(F.lower("slug").alias("target"), "name"), "target", "left")
    text = F.when((F.col("target") != "") & F.col("name").isNotNull(), F.concat(F.lit("[["), "name", F.lit("]]"))).otherwise(F.col("piece"))
    return named.groupBy("slug").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", text.alias("t")))), lambda x: x["t"]), "").alias(body))


def write_network(nodes: DataFrame, edges: DataFrame, folder: str, kind: str = "json") -> None:
    """Nodes and edges as JSON lines or CSV, each in its folder."""
    for name, rows in (("nodes", nodes), ("edges", edges)):
        writer = rows.write.mode("overwrite")
        (writer.option("header", True).csv if kind == "csv" else writer.json)(f"{folder}/{name}")


def save_network(edges: DataFrame, label: str, folder: str | None = None) -> str:
    """Keeps a network's edges under its label as a table, in place of one of the same label; where they are."""
    path = f"{folder or scratch_dir(edges.sparkSession)}/network={label}"
    edges.write.mode("overwrite").parquet(path)
    return path


def to_items(rows: DataFrame) -> DataFrame:
    """(id, item): articles as a reference manager's items in JSON; 'Last, First' names are taken apart."""
    creators = F.transform("authors", lambda a: F.struct(F.lit("author").alias("creatorType"), F.trim(F.regexp_extract(a, r"^[^,]*,(.*)$", 1)).alias("firstName"), F.trim(F.substring_index(a, ",", 1)).alias("lastName")))
    item = F.struct(F.lit("journalArticle").alias("itemType"), "title", F.col("abstract_text").alias("abstractNote"), F.col("publication_year").cast("string").alias("date"), F.col("doi").alias("DOI"), F.col("journal").alias("publicationTitle"), "language", creators.alias("creators"))
    return rows.select("id", F.to_json(item).alias("item"))


def flow_report(counts: DataFrame) -> DataFrame:
    """(report): the flow of a review, one row of counts, as a Markdown table."""
    rows = [F.concat(F.lit(f"| {name.replace('_', ' ')} | "), F.col(name).cast("string"), F.lit(" |")) for name in counts.columns]
    return counts.select(F.concat_ws("\n", F.lit("| step | records |"), F.lit("|---|---|"), *rows).alias("report"))

"""One record from a group of duplicates, field by field."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.cleaning import own_text, trimmed_lower

#: Rank of a source that is missing or not listed: after all that are.
UNLISTED = 2**31 - 1


@dataclass(frozen=True)
class Rule:
    """How a field's survivor is chosen among the rows where filled holds: by the order columns, smaller first, then by the row's id."""

    field: str
    value: Column
    filled: Column
    order: Sequence[Column]


def survivors(rows: DataFrame, key: str, row_id: str, rules: Sequence[Rule]) -> DataFrame:
    """One row for each non-null key: n_rows_differ (whether it has several ids), and for each rule a struct field(id, value), null where no row fills it.

    A single aggregation: for each field the extreme of the composite struct (filled, order..., id), which is combined before the shuffle,
    so a key of any size costs one buffer a task. The survivorship order is written with the best first and the extreme is the minimum,
    because the last tie goes to the smaller id. Repeated rows change nothing; columns of other names are ignored.
    """
    picks = [
        F.min(F.when(rule.filled & F.col(row_id).isNotNull(), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(rule.order)), F.col(row_id).alias("id"), rule.value.alias("value")))).alias(rule.field) for rule in rules
    ]
    grouped = rows.where(F.col(key).isNotNull()).groupBy(key).agg((F.min(row_id) < F.max(row_id)).alias("n_rows_differ"), *picks)
    return grouped.select(key, F.coalesce("n_rows_differ", F.lit(False)).alias("n_rows_differ"), *(F.when(F.col(r.field).isNotNull(), F.struct(F.col(r.field)["id"].alias("id"), F.col(r.field)["value"].alias("value"))).alias(r.field) for r in rules))


def paper_survivors(references: DataFrame, trust: DataFrame) -> DataFrame:
    """The surviving delivery of each paper_id for abstract_text, citation_count and import_source.

    abstract_text: most own text (without markup, cut-off marks, placeholders), then trust, then created_at; citation_count: latest
    created_at with a count of zero or more, then trust; import_source: trust, then created_at. A missing created_at is the earliest,
    an unlisted or missing source ranks last. trust holds one row for each of a fixed list of sources, so it is broadcast.
    """
    ranks = trust.select(trimmed_lower("import_source").alias("_source"), F.col("trust_rank").alias("_rank")).where("_source is not null").groupBy("_source").agg(F.min("_rank").alias("_rank"))
    text = own_text("abstract_text")
    rows = references.select("paper_id", "link_id", "abstract_text", "citation_count", "import_source", trimmed_lower("import_source").alias("_source"), F.length(text).alias("_own"), F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(2**62))).alias("_at"))
    rows = rows.join(F.broadcast(ranks), "_source", "left")
    rank, newest = F.coalesce("_rank", F.lit(UNLISTED)), -F.col("_at")
    return survivors(
        rows,
        "paper_id",
        "link_id",
        [
            Rule("abstract_text", F.col("abstract_text"), F.col("_own") > 0, [-F.col("_own"), rank, newest]),
            Rule("citation_count", F.col("citation_count").cast("string"), F.col("citation_count") >= 0, [newest, rank]),
            Rule("import_source", F.col("import_source"), F.col("_source").isNotNull(), [rank, newest]),
        ],
    )


def surviving_links(references: DataFrame, trust: DataFrame) -> DataFrame:
    """(paper_id, field_name, link_id) of the papers with two or more link_ids; no row for a field that no delivery fills."""
    fields = ["abstract_text", "citation_count", "import_source"]
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"{f}.id").alias("link_id")) for f in fields)))
    return paper_survivors(references, trust).where("n_rows_differ").select("paper_id", pairs.alias("x")).select("paper_id", "x.field_name", "x.link_id").where("link_id is not null")

import re

import pytest

from citeloom.plans import all_queries, all_sql
from tests.oracle import DATA, compare

SQL = all_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    compare(spark, all_queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(SQL)))
def test_query_runs(spark, name):
    df = all_queries()[name](spark, DATA)
    assert len(df.columns) and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.entry(spark).columns) == {"a", "b", "raw", "cosine", "jaccard", "pearson"}
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize(
    ("name", "table", "columns"),
    [
        ("pubs_by_year", "articles", {"id", "import_source", "status", "publication_year"}),
        ("kpi_bundle", "articles", {"id", "import_source", "status", "publication_year", "num_cited"}),
        ("facet_query", "articles", {"id", "import_source", "status", "title", "abstract_text", "publication_year", "authors", "duplicate_of"}),
        ("author_rankings", "articles", {"id", "import_source", "authors", "publication_year", "num_cited"}),
        ("bm25_search", "documents", {"doc_id", "text"}),
        ("keyset_page", "articles", {"id", "import_source", "status", "sequence_id"}),
        ("semi_exists", "reference_papers", {"id"}),
    ],
)
def test_scans_read_the_columns_used(spark, name, table, columns):
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = all_queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", before)
    read = set()
    for line in plan.splitlines():
        if f"/{table}.parquet" in line and "ReadSchema: struct<" in line:
            schema = re.sub(r"array<[^<>]*>", "array", line.split("ReadSchema: struct<", 1)[1])
            read |= {c.split(":")[0] for c in schema.rsplit(">", 1)[0].split(",")}
    assert read == columns


@pytest.mark.parametrize("name", ["similar_titles", "title_jaccard"])
def test_pairs_of_sets_are_not_shuffled(spark, name):
    plan = all_queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "keys=[a#" not in plan

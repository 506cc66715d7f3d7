import pytest
from pyspark.sql import functions as F

from citeloom.functions import identifiers, text
from citeloom.functions.stemming import stem


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(("raw", "key"), [("https://doi.org/10.1/A", "10.1/a"), ("DOI:10.1/A", "10.1/a"), ("N/A", None), ("-", None), (None, None)])
def test_normalize_doi(spark, raw, key):
    assert one(spark, identifiers.normalize_doi("x"), raw) == key


@pytest.mark.parametrize(("raw", "issn"), [("13665545 (ISSN)", "1366-5545"), ("1234567x", "1234-567X"), ("1234-5678; 1", "1234-5678"), ("9781234567890", ""), ("", "")])
def test_issn(spark, raw, issn):
    assert one(spark, text.normalize_issn("x"), raw) == issn


@pytest.mark.parametrize(("raw", "key"), [("Smith, John A.", "smith ja"), ("John A Smith", "smith ja"), ("Plato", "plato"), ("", "")])
def test_author_key(spark, raw, key):
    assert one(spark, text.author_key("x"), raw) == key


def test_text_expressions(spark):
    assert one(spark, text.tokenize_for_match("x"), "The of and") == ["the", "of", "and"]
    assert one(spark, text.significant_words("x"), "This study of größe and soil soil") == ["größe", "soil", "soil"]
    assert one(spark, text.normalize_journal("x"), "Soil & Water: A-B (Online) (Print)") == "soil and water a b"
    assert one(spark, text.snippet("x", 10), "alpha beta gamma") == "alpha..."
    assert one(spark, text.strip_html("x"), "<p>A&amp;B</p><p>C <b>d</b></p>") == "A&B\n\nC d"
    assert one(spark, text.strip_rtf("x"), r"{\rtf1 A\par B}") == "A\nB"
    assert one(spark, text.tokenize("x"), None) == []


def test_label(spark):
    df = spark.createDataFrame([(["A", "B"], 2001), (["A"], None), ([], 2001)], "a array<string>, y int")
    assert [r[0] for r in df.select(text.paper_label(F.col("a"), F.col("y"))).collect()] == ["A et al. (2001)", "A", "Unknown (2001)"]


@pytest.mark.parametrize(("word", "root"), [("running", "run"), ("relational", "relat"), ("happily", "happili"), ("ponies", "poni"), ("generously", "generous"), ("hopping", "hop"), ("hoping", "hope"), ("sensational", "sensat"), ("skies", "sky"), ("abilities", "abil"), ("cats", "cat")])
def test_stem(word, root):
    assert stem(word) == root

import pytest

from citeloom.llm import keys
from citeloom.llm.spellings import given_names, institution_key, tokens


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "key"),
    [("https://doi.org/10.5001%2FAB.1", "10.5001/ab.1"), ("doi:10.5001/ab.1", "10.5001/ab.1"), ("DOI: 10.5001/AB.1.", "10.5001/ab.1"), (" doi.org/10.5001/ab.1 ", "10.5001/ab.1"), ("http://dx.doi.org/10.5001/ab.1", "10.5001/ab.1"), ("10.5001/a(b)", "10.5001/a(b)"), ("(10.5001/ab)", "10.5001/ab"), ("100%", None), ("none", None), ("", None), (None, None), ("10.5001/%zz", "10.5001/%zz")],
)
def test_doi_key(spark, raw, key):
    assert one(spark, keys.doi_key("x"), raw) == key


@pytest.mark.parametrize(("raw", "key"), [("Soil - carbon: a trial.", "soilcarbonatrial"), ("Editorial", None), ("[Cover]", None), (None, None)])
def test_title_key(spark, raw, key):
    assert one(spark, keys.title_key("x"), raw) == key


@pytest.mark.parametrize(
    ("name", "core", "given"),
    [("Prof. Henrietta T. Danbanzegre", "danbanzegre", ("h", "henrietta", "t")), ("Danbanzegre, HT", "danbanzegre", ("h", "", "t")), ("Bill van der Fossen", "fossen", ("w", "william", "")), ("FOSSEN, EV", "fossen", ("e", "", "v")), ("Fossen-Holt J", "fossen", ("j", "", ""))],
)
def test_names(name, core, given):
    parts, joined, organisation = tokens(name)
    assert core in parts and not organisation
    assert given_names(parts, joined, core) == given


def test_institutions():
    assert len({institution_key(x) for x in ("University of Temesi", "Univ. Temesi", "Temesi Univ", "Temesi Institute")}) == 1
    assert institution_key(None) == ""

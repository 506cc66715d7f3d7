import pytest

from citeloom.functions.repair import affiliation, repair_json, truncate_query


@pytest.mark.parametrize(
    ("text", "found"),
    [("Dept of Soil, University of Temesi, Lyon 69000, France", ("University of Temesi", "Lyon", "France")), ("Rive Hospital, Boston, MA 02115, USA", ("Rive Hospital", "Boston", "United States")), ("X Institute, York, England", ("X Institute", "York", "United Kingdom")), ("Univ X", ("Univ X", None, None)), ("", (None, None, None)), (None, (None, None, None))],
)
def test_affiliation(text, found):
    assert affiliation(text) == found


def test_truncate_query():
    assert truncate_query("a AND b") == "a AND b"
    q = truncate_query('("' + "word " * 400 + '" OR b) AND c', 100)
    assert len(q.encode()) <= 100 and q.count('"') % 2 == 0 and q.count("(") == q.count(")")
    q = truncate_query("(" + "alpha OR " * 300 + "z)", 200)
    assert len(q.encode()) <= 200 and q.endswith("alpha)") and q.count("(") == q.count(")")


@pytest.mark.parametrize(("text", "value"), [('```json\n{"a": 1}\n```', {"a": 1}), ('Sure: [1, 2,] done', [1, 2]), ('{"a": "x\ny"}', {"a": "x\ny"}), ('[{"a": 1}, {"b": 2}, {"c": ', [{"a": 1}, {"b": 2}]), ("none", None), ('{"a": "}"}', {"a": "}"})])
def test_repair_json(text, value):
    assert repair_json(text) == value

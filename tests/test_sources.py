import datetime as dt

from pyspark.sql import functions as F

from citeloom.sources import bibtex, catalog, ris
from citeloom.streaming import audit


def test_ris_reader(spark, tmp_path):
    (tmp_path / "a.ris").write_bytes(
        "﻿TY  - journal article\r\nTI  - Soil\rwater\r\nAU  - A, B\r\nAU  - C\r\nPY  - 2023/12/31/\r\nDO  - https://doi.org/10.1/X\r\nSN  - 12345678\r\nSN  - 1111-222X\r\nN1  - Total Times Cited: 7\nCited Reference Count: 9\r\nZZ  - odd\r\nER  - \r\nTY  - BOOK\r\nT1  - No end KW  - k1\r\nTY  - CHAP\r\nTI  - Last\r\n".encode()
    )
    rows = {r["title"]: r for r in ris.read_ris(spark, str(tmp_path / "a.ris")).collect()}
    first = rows["Soil\nwater"]
    assert (first["reference_type"], first["authors"], first["publication_year"], first["doi"], first["issn"], first["eissn"], first["num_cited"], first["num_references"]) == ("JOUR", ["A, B", "C"], 2023, "10.1/x", "1234-5678", "1111-222X", 7, 9)
    assert first["extras"] == {"ZZ": ["odd"]}
    assert rows["No end"]["keywords"] == ["k1"] and "Last" in rows


def test_ris_columns_without_tags(spark):
    r = ris.parse_records(spark.createDataFrame([(None, 1), ("", 2), ("junk", 3)], "record string, id int")).collect()
    assert [(x["id"], x["title"], x["publication_year"]) for x in r] == [(1, None, None), (2, None, None), (3, None, None)]


def test_bibtex():
    entries, errors = bibtex.parse('@string{j = "Soil"}\n@comment{x}\n@article{k1, title = {A {B} c}, journal = j # " Science", author={X, Y and Z}, year=2001, % note\n pages={1--9}}\n@book{bad, title={open\n@misc{k2, title="q ""r"" s", month = jan}')
    assert [e[1] for e in entries] == ["k1", "k2"] and len(errors) == 1
    r = bibtex.record(*entries[0])
    assert r[1:12] == ("JOUR", "A B c", None, ["X, Y", "Z"], 2001, None, "Soil Science", None, None, "1", "9")
    assert dict(entries[1][2]) == {"title": 'q "r" s', "month": "1"}


def test_unique_keys(spark):
    df = spark.createDataFrame([("a", i) for i in range(29)] + [("b", 1)], "k string, o int")
    keys = [r["k"] for r in bibtex.unique_keys(df, "k", ["o"]).orderBy("o").collect()]
    assert keys[:2] == ["a", "ab"] or {"a", "ab", "b"} <= set(keys)
    assert keys.count("az") == 4


def test_catalog(spark):
    w = '{"id":"W1","title":"T","doi":"https://doi.org/10.1/A","publication_year":2001,"abstract_inverted_index":{"b":[1],"a":[0,2]},"authorships":[{"author":{"display_name":"X"}}],"referenced_works":["W2","W3"]}'
    r = catalog.works(spark.createDataFrame([(w,), ("no json",), (None,)], "j string"), "j").collect()
    assert (r[0]["abstract_text"], r[0]["doi"], r[0]["authors"], r[0]["num_references"]) == ("a b a", "10.1/a", ["X"], 2)
    assert r[1]["work_id"] is None
    line = spark.createDataFrame([("Smith J, 1999, J SOIL SCI, V12, P34, DOI 10.1/AB",)], "x string").select(catalog.cited_reference("x").alias("c")).first()["c"]
    assert (line["author"], line["year"], line["source"], line["volume"], line["page"], line["doi"]) == ("Smith J", 1999, "J SOIL SCI", "12", "34", "10.1/ab")
    page = spark.createDataFrame([("---\ntitle: A: b\ntags: [x, y]\n---\nBody",)], "x string").select(catalog.frontmatter("x").alias("f")).first()["f"]
    assert page["meta"] == {"title": "A: b", "tags": "[x, y]"} and page["body"] == "Body"
    table = spark.createDataFrame([('a,"b"\n\n1,2',)], "x string").select(catalog.csv_to_markdown("x")).first()[0]
    assert table == "| a | b |\n| --- | --- |\n| 1 | 2 |"


def test_items(spark):
    j = '{"key":"K","itemType":"book","title":"T","date":"May 2003","creators":[{"creatorType":"editor","firstName":"A","lastName":"B"}]}'
    assert [(r["authors"], r["publication_year"]) for r in catalog.items(spark.createDataFrame([(j,), ('{"itemType":"note"}',)], "j string"), "j").collect()] == [(["B, A"], 2003)]


def test_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = [0, 100, 400, 701, 5000, 5000]
    rows = [(f"e{i}", "a1", t0 + dt.timedelta(seconds=s), "tagged", None, f"s{i}", None, "ui", t0) for i, s in enumerate(at)] + [("e9", "a1", t0 + dt.timedelta(days=40), "tagged", None, "z", None, "ui", t0)]
    df = spark.createDataFrame(rows, audit.SCHEMA)
    df.write.parquet(str(tmp_path / "in"))
    batch = {(r["started"], r["ts"], r["n"], r["to_status"]) for r in audit.coalesced(df).collect()}
    assert (t0, t0 + dt.timedelta(seconds=400), 3, "s2") in batch and len(batch) == 4
    q = audit.coalesced_stream(audit.read_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    stream = {(r["started"], r["ts"], r["n"], r["to_status"]) for r in spark.table("sessions").collect()}
    assert stream == {b for b in batch if b[3] != "z"}


def test_changed(spark):
    old, new = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "k string, h string"), spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "k string, h string")
    assert {tuple(r) for r in audit.changed(old, new, ["k"], "h").collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}


def test_inverted_index(spark):
    df = spark.createDataFrame([("x", "b a  b"), ("y", " ")], "id string, t string")
    back = catalog.index_rows(df, "id", "t").select("id", catalog.abstract_of_index("abstract_inverted_index").alias("t"))
    assert [tuple(r) for r in back.collect()] == [("x", "b a b")]
    assert F is not None

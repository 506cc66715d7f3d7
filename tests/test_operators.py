import pandas as pd
from pyspark.sql import functions as F

from citeloom.operators import graph, segments
from citeloom.operators.dedup import duplicate_pairs, greedy_groups
from citeloom.plans.facets import ArticleFilter, parse_toolbar
from tests.oracle import DATA


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_closure_with_a_cycle(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")])
    found = graph.closure(e, spark.createDataFrame([("a", "a")], "start string, node string"))
    assert {r["node"] for r in found.collect()} == {"b", "c"}


def test_levels_leave_cycles_out(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z")])
    assert {(r["node"], r["level"]) for r in graph.levels(e).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert graph.levels(edges(spark, []) if False else e.limit(0)).count() == 0


def test_path_counts_and_main_path(spark):
    e = edges(spark, [("s", "a"), ("s", "b"), ("a", "m"), ("b", "m"), ("m", "t"), ("m", "u"), ("b", "t")])
    w = {(r["src"], r["dst"]): r["weight"] for r in graph.path_counts(e).collect()}
    assert w == {("s", "a"): 2, ("s", "b"): 3, ("a", "m"): 2, ("b", "m"): 2, ("m", "t"): 2, ("m", "u"): 2, ("b", "t"): 1}
    path = {(r["src"], r["dst"]) for r in graph.main_path(graph.path_counts(e)).collect()}
    assert path == {("s", "b"), ("b", "m"), ("m", "t")}


def test_communities_split_two_cliques(spark):
    pairs = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(5) for j in range(i + 1, 5)] + [("a0", "b0", 1.0)]
    found = {r["node"]: r["community"] for r in graph.communities(spark.createDataFrame(pairs, "src string, dst string, weight double")).collect()}
    assert len({found[f"a{i}"] for i in range(5)}) == 1 and len({found[f"b{i}"] for i in range(5)}) == 1 and found["a1"] != found["b1"]


def test_blocks(spark):
    p = spark.createDataFrame([("d", "c"), ("c", "b"), ("x", "y")], "a string, b string")
    assert {(r["node"], r["block"]) for r in graph.blocks_of_pairs(p).collect()} == {("b", "b"), ("c", "b"), ("d", "b"), ("x", "x"), ("y", "x")}


def test_duplicate_tiers(spark):
    rows = [("1", "10.1/A", "Alpha beta gamma", 2001, ["Smith, J"]), ("2", "doi:10.1/a", "Other title here", 1999, None), ("3", None, "Alpha beta gamma.", 2001, ["X, Y"]), ("4", None, "Alpha betta gamna", 2005, ["John Smith"]), ("5", None, "Short", 2001, []), ("6", None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, doi string, title string, publication_year int, authors array<string>")
    assert {(r["a"], r["b"], r["kind"]) for r in duplicate_pairs(df).collect()} == {("1", "2", "exact"), ("1", "3", "exact"), ("1", "4", "fuzzy")}


def test_greedy_takes_the_first_partner():
    p = pd.DataFrame([("a", "b", "exact", 1.0), ("a", "c", "exact", 1.0), ("b", "c", "exact", 1.0), ("c", "d", "fuzzy", 0.8)], columns=["a", "b", "kind", "score"])
    assert [tuple(r) for r in greedy_groups(p)[["a", "b"]].to_numpy()] == [("a", "b"), ("c", "d")]


def test_greedy_replays_only_what_may_leave(spark):
    import random

    from citeloom.operators.dedup import kept_pairs, open_pairs

    rng = random.Random(3)
    rows = [(f"n{a:02}", f"n{b:02}", "exact" if rng.random() < 0.1 else "fuzzy", 0.8) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.3]
    pairs = spark.createDataFrame(rows, "a string, b string, kind string, score double")
    want = greedy_groups(pd.DataFrame(rows, columns=["a", "b", "kind", "score"]))
    assert sorted(tuple(r) for r in kept_pairs(pairs).collect()) == sorted(want.itertuples(index=False, name=None))
    clique = spark.createDataFrame([(f"n{a:03}", f"n{b:03}", "fuzzy", 0.8) for a in range(100) for b in range(a + 1, 100)], "a string, b string, kind string, score double")
    assert open_pairs(clique).count() == 99


def test_imports_replay_the_pairs_once(spark):
    from citeloom.plans.library import imports_classified
    from citeloom.plans.matching import dedup_greedy

    plan = imports_classified(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "FlatMapGroups" not in plan
    new = {r["id"] for r in spark.read.parquet(f"{DATA}/articles.parquet").where("import_source = 'ris_import'").collect()}
    found = {}
    for r in dedup_greedy(spark, DATA).collect():
        for x, y in ((r["b"], r["a"]), (r["a"], r["b"])):
            if x in new:
                found[x] = min(found.get(x, (r["kind"], y)), (r["kind"], y))
                break
    want = {(x, {"exact": "duplicate", "fuzzy": "review"}.get(found.get(x, [""])[0], "working"), found[x][1] if found.get(x, [""])[0] == "exact" else None) for x in new}
    assert {tuple(r) for r in imports_classified(spark, DATA).collect()} == want


def test_distances_of_many_titles():
    import random

    from citeloom.functions.distance import BAND, close_pairs, most

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(1)
    texts = []
    for size in (0, 3, 12, 40, 64, 65, 90, 120):
        base = [rng.choice("abcdé ") for _ in range(size)]
        for _ in range(6):
            text = list(base)
            for _ in range(rng.randrange(size // 3 + 1)):
                at = rng.randrange(len(text) + 1)
                text[at : at + rng.randrange(2)] = rng.choice(["", "a", "é"])
            texts.append("".join(text))
    found = {(i, j): d for part in close_pairs(texts, texts, 0.7, True) for i, j, d in zip(*part, strict=True)}
    for i, a in enumerate(texts):
        for j in range(i + 1, len(texts)):
            d, limit = distance(a, texts[j]), most(max(len(a), len(texts[j])), 0.7)
            if limit > BAND:  # left to Spark
                assert found.get((i, j)) == -1 or d > limit
            else:
                assert found.get((i, j)) == (d if d <= limit else None)


def test_titles_that_begin_alike_are_stepped_through_once(monkeypatch):
    import random

    import numpy as np

    from citeloom.functions import distance

    rng = random.Random(4)
    begins = [" ".join(rng.choice(["sleep", "therapy", "runoff", "of", "carbon"]) for _ in range(5)) for _ in range(3)]
    texts = list(dict.fromkeys(b + " " + "".join(rng.choice("abcdé ") for _ in range(rng.randrange(30))) for b in begins for _ in range(40)))
    i, j = np.triu_indices(len(texts), 1)
    for least in (0.7, 0.95):
        want = {(int(a), int(b)): int(d) for a, b, d in zip(*distance.listed_pairs(texts, texts, i, j, least), strict=True)}
        with monkeypatch.context() as m:
            m.setattr(distance, "banded", None)
            for looked in (distance.LOOK, 1):  # also one look a column
                m.setattr(distance, "LOOK", looked)
                assert want == {(int(a), int(b)): int(d) for part in distance.close_pairs(texts, texts, least, True) for a, b, d in zip(*part, strict=True)}
    assert want


def test_sets_of_common_items_equal_brute_force(spark, monkeypatch):
    import random

    from citeloom.operators import sets

    monkeypatch.setattr(sets, "BLOCK", 20)
    rng = random.Random(2)
    rows = [(f"k{i:03}", rng.sample("abcdefgh", rng.randrange(1, 7)) + rng.sample([f"w{n}" for n in range(60)], rng.randrange(3))) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, s array<string>")
    for least in (0.5, 0.8):
        want = sorted((a, b, round(len(set(x) & set(y)) / len(set(x) | set(y)), 6)) for a, x in rows for b, y in rows if a < b and len(set(x) & set(y)) / len(set(x) | set(y)) >= least)
        assert sorted(tuple(r) for r in sets.similar_sets(df, "id", "s", least, heavy=20).collect()) == want


def test_sets_are_sent_eight_times_at_most(spark):
    from citeloom.operators import blocks, sets

    met = blocks.block_pairs(spark.range(400).withColumn("part", F.lit(0)), ["part"], F.col("id"), 4, ["id"], sets.BLOCKS)
    sent = met.agg(F.sum(F.size("x_id") + F.when(F.col("same"), F.size("x_id")).otherwise(F.size("y_id")))).first()[0]
    assert sent <= 8 * 400


def test_titles_of_a_year_meet_over_all_blocks(spark, monkeypatch):
    from citeloom.operators import dedup

    monkeypatch.setattr(dedup, "BLOCK", 8)
    rows = [(f"r{i:02}", f"a title that is number {i:02} of all " + "long " * (30 if i > 50 else 0), 2001 + i % 2) for i in range(60)]
    found = {(r["a"], r["b"]) for r in dedup.alike(spark.createDataFrame(rows, "id string, title string, year int"), "year", 0.7).collect()}
    assert found == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1])}


def test_duplicates_of_repeated_titles_equal_brute_force(spark, monkeypatch):
    import random

    from citeloom.operators import dedup

    rng = random.Random(5)
    words = "sleep therapy hygiene runoff carbon review".split()
    titles = [" ".join(rng.choice(words) for _ in range(5)) for _ in range(12)]
    rows = [(f"k{n:03}", rng.choice([None, None, "10.1/a", "10.1/b"]), rng.choice(titles) + rng.choice(["", " x", " two"]), rng.choice([2001, 2001, 2002, None]), [rng.choice(["Ann Lee", "Bo Ray", "Cy Orr"])]) for n in range(90)]
    rows += [("k001", "10.1/c", "another title of the record", 2002, ["Ann Lee"])]  # two rows of one id
    rows += rows[5:9]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {}
    for x in rows:
        for y in rows:
            if x[0] < y[0]:
                s = 1 - distance(x[2], y[2]) / max(len(x[2]), len(y[2]))
                tier = 1 if x[1] and x[1] == y[1] else (2 if s >= 0.95 else 3) if x[3] and x[3] == y[3] and s >= 0.7 else 4 if x[4] == y[4] and s >= 0.8 else None
                if tier:
                    want[x[0], y[0]] = min(want.get((x[0], y[0]), (9, 0)), (tier, round(1.0 if tier == 1 else s, 6)))
    want = sorted((a, b, "exact" if t <= 2 else "fuzzy", s) for (a, b), (t, s) in want.items())
    df = spark.createDataFrame(rows, "id string, doi string, title string, publication_year int, authors array<string>")
    for block, small in ((2048, 16384), (8, 0), (8, 20)):
        monkeypatch.setattr(dedup, "BLOCK", block)
        monkeypatch.setattr(dedup, "SMALL", small)
        monkeypatch.setattr(dedup, "STEP", 50)
        assert sorted(tuple(r) for r in dedup.duplicate_pairs(df).collect()) == want


def test_exact_pairs_need_no_comparison_of_near_titles(spark, monkeypatch):
    from citeloom.operators import dedup
    from citeloom.plans.library import duplicates_merged

    title = "shift rotation and runoff in the north of a country"
    rows = [("k1", "10.1/a", title, 2001, ["Lee"]), ("k2", "10.1/a", "other", 2002, ["Ray"]), ("k3", None, title + "s", 2001, ["Lee"]), ("k4", None, title + " of all", 2001, ["Lee"]), ("k5", None, title, 2002, ["Lee"]), ("k3", "10.1/a", title, 2003, ["Orr"])]
    df = spark.createDataFrame(rows, "id string, doi string, title string, publication_year int, authors array<string>")
    exact = sorted((r["a"], r["b"]) for r in dedup.duplicate_pairs(df).where("kind = 'exact'").collect())
    assert exact == [("k1", "k2"), ("k1", "k3"), ("k2", "k3")] == sorted(map(tuple, dedup.exact_pairs(df).collect()))
    asked, alike = [], dedup.alike
    monkeypatch.setattr(dedup, "alike", lambda rows, part, least, *a: asked.append((part, least)) or alike(rows, part, least, *a))
    duplicates_merged(spark, DATA)
    assert asked == [("year", 0.95)]


def test_pairs_of_duplicates_are_not_shuffled(spark):
    from citeloom.operators.dedup import duplicate_pairs

    df = spark.createDataFrame([(f"k{n}", None, f"a title of some length {n}", 2001, ["Ann Lee"]) for n in range(30)], "id string, doi string, title string, publication_year int, authors array<string>")
    plan = duplicate_pairs(df)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan.split("Union")[0] and "Aggregate" not in plan.split("Union")[0]
    one = {("k1", "k2", "fuzzy")}
    far = spark.createDataFrame([("k1", None, "shift rotation and runoff", 2001, ["Lee"]), ("k2", None, "shift rotation and runofs", 2002, ["Lee"]), ("k3", None, "shift rotation and runofs", 2003, ["Ray"])], df.schema)
    assert {(r["a"], r["b"], r["kind"]) for r in duplicate_pairs(far).collect()} == one


def test_listed_distances_equal_those_of_blocks():
    import random

    import numpy as np

    from citeloom.functions import distance

    rng = random.Random(4)
    base = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (0, 5, 30, 62, 90, 130)]
    texts = [b[: rng.randrange(len(b) + 1)] + rng.choice(["", "xy", b]) for b in base for _ in range(9)] + base
    i, j = np.triu_indices(len(texts), 1)
    for least in (0.7, 0.8):
        want = {(a, b): d for part in distance.close_pairs(texts, texts, least, True) for a, b, d in zip(*part, strict=True)}
        assert {(a, b): d for a, b, d in zip(*distance.listed_pairs(texts, texts, i, j, least), strict=True)} == want


def test_chunks():
    text = "# Methods\n" + "One two three four. " * 200 + "\n# References\nx\n# Results\nShort end."
    c = segments.chunks(text)
    assert all(len(t.split()) <= segments.MOST for _, t in c) and c[0][0] == "Methods" and c[-1][1].endswith("Short end.")
    assert segments.chunks("") == [] and segments.captions("Figure 1. A\nmore\n\nTable 2: B") == [("Figure", 1, "A more"), ("Table", 2, "B")]
    assert len(segments.chunks("w " * 5000)) == 10


def test_toolbar():
    assert parse_toolbar("y: 2010-2012") == ArticleFilter(year_from=2010, year_to=2012)
    assert parse_toolbar("year: 2012-2010").search == "year: 2012-2010"
    assert parse_toolbar("a: Smith").author == "Smith" and parse_toolbar("doi:10.1/x").doi == "10.1/x" and parse_toolbar("plain").search == "plain"


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_journals_match_by_the_surest_tier(spark):
    from citeloom.operators import library

    index = spark.createDataFrame([("j1", "Soil Science", "1234-5678", "1111-1111"), ("j2", "Soil & Water", "2222-2222", "1234-5678"), ("j0", "soil science (print)", "", None)], "journal_id string, title string, issn string, eissn string")
    records = spark.createDataFrame([("a", "12345678", None, "x"), ("b", None, "1234-5678", "x"), ("c", "2222-2222", "1111-1111", "x"), ("d", "bad", None, "SOIL SCIENCE"), ("e", None, None, None), ("f", None, None, "soil and water")], "id string, issn string, eissn string, journal string")
    assert rows(library.match_journals(records, index)) == {("a", 1, "j1"), ("b", 3, "j2"), ("c", 1, "j2"), ("d", 5, "j0"), ("f", 5, "j2")}
    assert library.match_journals(records, index.limit(0)).count() == 0
    assert [r["title"] for r in library.search_journals(index, "soil").collect()] == ["Soil & Water", "Soil Science", "soil science (print)"]
    assert [r["journal_id"] for r in library.search_journals(index, "1234-5678").collect()] == ["j2", "j1"]


def test_records_keep_their_identity(spark):
    from citeloom.operators import library

    have = spark.createDataFrame([("p1", "10.1/a", "T"), ("p2", None, "U")], "id string, doi string, title string")
    new = spark.createDataFrame([("n1", "10.1/a", "other"), ("n2", None, "U"), ("n4", "10.1/z", "W"), ("n3", "10.1/z", "V"), ("n5", None, None)], "n string, doi string, title string")
    assert rows(library.identify(have, new, [F.col("doi"), F.col("title")], "n")) == {("n1", "p1", True), ("n2", "p2", True), ("n3", "n3", False), ("n4", "n3", False)}
    up = library.upsert(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), spark.createDataFrame([("b", 2), ("b", 5), ("c", 3)], "k string, v int"), ["k"], "v")
    assert rows(up) == {("a", 1), ("b", 5), ("c", 3)}


def test_numbers_follow_the_order(spark):
    from citeloom.operators import library

    df = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "x int").repartition(7)
    got = sorted(library.numbered(df, [F.col("x").asc()], 10).collect(), key=lambda r: r["x"])
    assert [r["sequence_id"] for r in got] == list(range(11, 1011))


def test_capacity_and_finalists(spark):
    from citeloom.operators import library

    assert spark.range(1).select(library.fills_capacity(F.array(*(F.lit(x).cast("long") for x in (5, 8, 4, 1))), 10).alias("t")).first()["t"] == [True, False, True, True]
    a = spark.createDataFrame([("g", i, 1.0 / (i + 1)) for i in range(30)], "g string, i int, s double")
    b = spark.createDataFrame([("g", i, float(i)) for i in range(30)], "g string, i int, s double")
    got = [r["i"] for r in library.finalists(a, b, "g", "i", "s").orderBy("rank").collect()]
    assert got == [*range(15), 29, 28, 27, 26, 25]


def test_similar_sets_equal_brute_force(spark):
    import random

    from citeloom.operators.pages import similar_sets

    rng = random.Random(1)
    sets = {i: sorted({f"w{min(rng.randrange(30), rng.randrange(30))}" for _ in range(rng.randrange(1, 9))}) for i in range(120)}
    df = spark.createDataFrame([(i, s) for i, s in sets.items()] + [(500, []), (501, None)], "id int, s array<string>")
    for least in (0.5, 0.8):
        want = {(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) >= least * len(set(sets[a]) | set(sets[b])) - 1e-9}
        assert {(r["a"], r["b"]) for r in similar_sets(df, "id", "s", least).collect()} == want


def test_pages(spark):
    from citeloom.operators import pages

    heads = spark.createDataFrame([("a", 1, "Head 1\nbody\nfoot"), ("a", 2, "Head 2\nHead 2\nfoot"), ("a", 3, "x\ny"), ("b", 1, "only")], "id string, page int, text string")
    assert rows(pages.without_running_heads(heads)) == {("a", 1, "body"), ("a", 2, "Head 2"), ("a", 3, "x\ny"), ("b", 1, "")}
    p = spark.createDataFrame([(1, "Sleep", "concept", ["sleep"], ["s1"]), (2, "sleep", "concept", ["x"], ["s9"]), (3, "other", "concept", ["q"], ["s1", "s2"]), (4, "more", "concept", ["z"], ["s2", "s1"]), (5, "sleep", "author", ["sleep"], ["s1"])], "place int, slug string, kind string, stems array<string>, sources array<string>")
    assert rows(pages.page_duplicates(p)) == {(1, 2), (3, 4)} and rows(pages.consolidated(p)) == {(2, 1), (4, 3)}
    assert pages.gfm_tables("a | b\nc | d\n\ntext\nx1   y1   z1\nx2   y2   z2")[1] == ["| a | b |\n| --- | --- |\n| c | d |", "| x1 | y1 | z1 |\n| --- | --- | --- |\n| x2 | y2 | z2 |"]
    assert pages.within_budget("One two three. Four five six seven. Eight", 4) == ["One two three.", "Four five six seven.", "Eight"]
    q = spark.createDataFrame([(["  B  two", "a one", "b TWO", "none", ""], "A one and b two")], "q array<string>, s string")
    assert q.select(pages.grounded(F.col("q"), F.col("s")).alias("g")).first()["g"] == ["a one", "B  two"]


def test_pages_are_consolidated_in_rounds(spark, monkeypatch):
    import random

    from citeloom.operators import pages

    rng = random.Random(6)
    data = [(f"p{n:03}", rng.choice([None, f"s{rng.randrange(40)}", f"S{n}"]), rng.choice(["concept", "method"]), rng.sample([f"w{k}" for k in range(14)], rng.randrange(5)), rng.sample(["a", "b", "c", "d", "e", "f", "g", None], 2)) for n in range(150)]
    df = spark.createDataFrame(data, "place string, slug string, kind string, stems array<string>, sources array<string>")
    want = {}
    for a, b in sorted((r["a"], r["b"]) for r in pages.page_duplicates(df).collect()):
        if a not in want and b not in want:
            want[b] = a
    assert len(set(want.values())) > 10
    for head, rows_, common in ((4096, 512, 32), (40, 16, 2), (7, 4, 1)):
        for name, value in (("HEAD", head), ("ROWS", rows_), ("COMMON", common), ("TRIED", 3)):
            monkeypatch.setattr(pages, name, value)
        assert rows(pages.consolidated(df)) == set(want.items())
    monkeypatch.setattr(pages, "page_duplicates", None)  # pairs of pages are never made
    assert rows(pages.consolidated(df)) == set(want.items())


def test_communities_of_two_cliques(spark):
    from citeloom.operators.graph import blocks_of_pairs, communities

    e = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "ab" for i in range(5) for j in range(i)] + [("a0", "b0", 0.5)]
    got = {r["node"]: r["community"] for r in communities(spark.createDataFrame(e, "src string, dst string, weight double")).collect()}
    assert len(set(got.values())) == 2 and len({got[f"a{i}"] for i in range(5)}) == 1
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("z1", "z2")]
    assert {r["block"] for r in blocks_of_pairs(spark.createDataFrame(chain, "a string, b string")).collect()} == {"n000", "z1"}


def test_nearest_equals_brute_force(spark):
    import numpy as np

    from citeloom.operators.vectors import nearest

    x = np.random.default_rng(0).normal(size=(60, 5)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(90, [0.0] * 5, 1), (91, None, 1), (92, [], 1)], "id long, v array<float>, g int")
    u = x.astype(float) / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 4)
    got = {(r["query"], r["key"]) for r in nearest(df, df.where("id < 4"), "id", "v", 5).collect()}
    assert got == {(q, int(k)) for q in range(4) for k in sorted(range(60), key=lambda k: (-s[q, k], k))[:5]}
    assert nearest(df, df.where("id < 4"), "id", "v", 1, "g").count() == 12

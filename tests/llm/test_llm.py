"""Each operator on its edges: nulls, empty and long texts, ties, repeats, empty tables, extra columns of clashing names; and against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.llm import encodings, groups, language, leakage, mixing, names, neighbours, pairs, queries, splitting, survivors
from tests.oracle import DATA, compare

T0 = dt.datetime(2024, 1, 1)
SAMPLES = "/root/testdata/sf0.001/lang_samples.parquet"


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert len(df.columns) and df.count() >= 0


# 1 groups


def test_groups_equal_union_find(spark):
    rng = random.Random(1)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    links = chain + [(f"n{rng.randrange(80):02d}", f"n{rng.randrange(80):02d}") for _ in range(60)] + [(None, "x"), ("x", None), ("l", "l"), chain[0]]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a and b and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = rows(groups.connected_groups(spark.createDataFrame(links, "a string, b string")))
    assert got == {(x, find(x)) for x in parent}
    assert groups.connected_groups(spark.createDataFrame([], "a string, b string")).count() == 0


def test_work_groups(spark):
    p = spark.createDataFrame([("p1", "10.5001/A", "A title of some length", "k"), ("p2", None, "a title, of some LENGTH", "k"), ("p3", "NA", "Editorial", "k"), ("p4", "NA", "Editorial", "k"), (None, "10.5001/a", None, "k"), ("p1", "10.5001/A", "A title of some length", "k")], "id string, doi string, title string, record_id string")
    a = spark.createDataFrame([("a1", "https://doi.org/10.5001%2Fa", "A title of some length"), ("a2", None, "A title of some length")], "id string, doi string, title string")
    assert rows(groups.work_groups(p, a)) == {("a1", "a1"), ("p1", "a1"), ("p2", "a1")}
    assert groups.work_groups(p.limit(0), a.limit(0)).count() == 0


# 2 neighbours


def vectors(spark, items):
    return spark.createDataFrame([(a, c, v, d, h, m, w, "x") for a, c, v, d, h, m, w in items], "article_id string, chunk_index int, embedding array<float>, dimensions int, input_hash string, model_name string, written_at timestamp, key string")


def test_vectors_on_edges(spark):
    later = T0 + dt.timedelta(1)
    items = [("a", 0, [1.0, 0.0], 2, "h", "m", T0), ("a", 0, [0.0, 1.0], 2, "h", "m", later), ("b", 0, [0.0, 2.0], 2, "h", "m", T0), ("b", 0, [0.0, 2.0], 2, "h", "m", T0), ("c", 0, [0.0, 0.0], 2, "h", "m", T0), ("d", 0, None, 2, "h", "m", T0), ("e", 0, [1.0], 2, "h", "m", T0), ("f", 0, [1.0, float("nan")], 2, "h", "m", T0), ("g", 0, [1.0, 1.0], 2, "h", "m", None), ("g", 0, [1.0, 1.0, 1.0], 3, "h", "n", T0), (None, 0, [1.0, 1.0], 2, "h", "m", T0), ("h", 0, [1.0, 0.0], 2, "h", "m", T0), ("h", 0, None, 2, "h", "m", later)]
    df = vectors(spark, items)
    assert rows(neighbours.similar_pairs(df)) == {("a#0", "b#0"), ("a#0", "g#0"), ("b#0", "g#0")}
    assert neighbours.similar_pairs(df.limit(0)).count() == 0


def test_equal_vectors_take_the_smallest_keys(spark):
    df = vectors(spark, [(f"a{i:02d}", 0, [1.0, 0.0], 2, "h", "m", T0) for i in range(20)] + [("b", 0, [0.0, 1.0], 2, "h", "m", T0)])
    found = {r["key"]: [x["key"] for x in r["neighbours"]] for r in neighbours.similar_vectors(neighbours.usable_vectors(df)).collect()}
    assert found["a19#0"] == [f"a{i:02d}#0" for i in range(5)] and found["a00#0"] == [f"a{i:02d}#0" for i in range(1, 6)] and found["b#0"] == [f"a{i:02d}#0" for i in range(5)]


def test_learned_partitions_keep_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 128)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 1200)] + 0.4 * rng.normal(size=(1200, 16))).astype(np.float32)
    df = vectors(spark, [(f"a{i:04d}", 0, v.tolist(), 16, "h", "m", T0) for i, v in enumerate(x)])
    u = neighbours.unit(x)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {tuple(sorted((f"a{i:04d}#0", f"a{j:04d}#0"))) for i in range(len(x)) for j in np.argsort(-s[i])[:5]}
    got = rows(neighbours.similar_pairs(df))
    assert len(got & want) / len(want) >= 0.9


def test_trees_of_partitions_keep_recall(spark, monkeypatch):
    """More parts than one classifier tells apart: a second one in each part."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16))
    x = (centres[rng.integers(0, 60, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    df = vectors(spark, [(f"a{i:04d}", 0, v.tolist(), 16, "h", "m", T0) for i, v in enumerate(x)])
    monkeypatch.setattr(neighbours, "PART", 64)
    monkeypatch.setattr(neighbours, "MOST_PARTS", 8)
    reps = neighbours.usable_vectors(df).withColumn("rep", F.col("key"))
    tree = neighbours.planted(reps)["m"]
    assert tree.root is not None and len(tree.inner) > 4
    u = neighbours.unit(x)
    home, probes = tree.routes(u)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    near = np.argsort(-s, axis=1)[:, :5]
    found = np.mean([home[j] in set(probes[i]) for i in range(len(x)) for j in near[i]])
    assert found >= 0.9 and len(np.unique(home)) > 20 and np.mean([len(p) for p in probes]) < 0.7 * len(np.unique(home))


def test_parts_are_balanced():
    x = neighbours.unit(np.random.default_rng(1).normal(size=(800, 8)))
    size = np.bincount(neighbours.balanced_parts(x, neighbours.neighbour_graph(x, 8), 8), minlength=8)
    assert size.max() <= 1.1 * 100 and size.sum() == 800


# 3 survivors


def test_survivors_on_edges(spark):
    refs = [("p1", "l2", "<p>Long own text</p>", 3, "openalex", T0), ("p1", "l1", "Long own text …", 5, " OpenAlex ", None), ("p1", "l3", "[Abstract not available]", -1, None, T0 + dt.timedelta(1)), ("p2", "l4", None, None, None, None), ("p2", "l5", "", None, "  ", None), ("p3", "l6", "x", 1, "a", T0), ("p3", "l6", "x", 1, "a", T0), (None, "l7", "x", 1, "a", T0), ("p4", None, "x", 1, "a", T0), ("p4", "l8", None, 2, "unlisted", T0), ("p4", "l9", None, 2, "unlisted", T0)]
    df = spark.createDataFrame([(*r, 9, 9) for r in refs], "paper_id string, link_id string, abstract_text string, citation_count int, import_source string, created_at timestamp, trust_rank int, rank int")
    trust = spark.createDataFrame([("openalex", 1), (None, 2)], "import_source string, trust_rank int")
    assert rows(survivors.surviving_links(df, trust)) == {("p1", "abstract_text", "l2"), ("p1", "citation_count", "l2"), ("p1", "import_source", "l2"), ("p4", "citation_count", "l8"), ("p4", "import_source", "l8")}
    assert survivors.surviving_links(df.limit(0), trust).count() == 0


# 4 pairs


def test_pairs_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    baskets = {f"b{i}": {f"i{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(1, 8))} for i in range(400)}
    data = [("f", b, x) for b, items in baskets.items() for x in items]
    df = spark.createDataFrame([*data, *data[:50], ("f", None, "z"), (None, "b1", "z"), ("f", "b1", None)], "field_name string, basket string, item string")
    count, both = {}, {}
    for items in baskets.values():
        for a in items:
            count[a] = count.get(a, 0) + 1
            for b in items:
                if a < b:
                    both[a, b] = both.get((a, b), 0) + 1
    want = {(a, b, n) for (a, b), n in both.items() if n >= 5 and n * len(baskets) >= 1.2 * count[a] * count[b]}
    for heavy in (1024, 7, 0):
        monkeypatch.setattr(pairs, "HEAVY", heavy)
        got = rows(pairs.cooccurrence(df, 5, 1.2).select("item_a", "item_b", "n_together"))
        assert got == want, heavy
    assert pairs.cooccurrence(df.limit(0)).count() == 0


def test_heavy_light_counts_agree(monkeypatch):
    import pandas as pd

    lists = [[0, 1, 9, 12], [1, 9], [], [12, 9, 0], [3]]
    outs = []
    for heavy in (0, 2, 10, 100):
        monkeypatch.setattr(pairs, "HEAVY", heavy)
        out = pd.concat(pairs.count_pairs(iter([pd.DataFrame({"items": lists})])))
        outs.append({(min(a, b), max(a, b)): n for a, b, n in out.to_numpy()})
    assert all(o == outs[0] for o in outs) and outs[0][9, 12] == 2 and outs[0][0, 9] == 2


# 5 language


def test_languages(spark):
    s = spark.read.parquet(SAMPLES)
    by = {r["lang"]: r["text"] for r in s.collect()}
    refs = [("ok", by["en"], "English"), ("wrong", by["de"], "en-GB"), ("none", by["fr"], None), ("und", by["tr"], "und"), ("mixed", by["en"] + "\n" + by["ja"], "en"), ("word", by["en"] + " The déjà vu item was dropped.", "eng"), ("hold", "[Abstract not available]", None), ("null", None, None), ("blank", " ", "x"), ("odd", by["it"], "Klingon"), ("cut", by["ru"] + " [truncated]", "rus"), ("ok", by["en"], "English"), (None, by["en"], None)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in refs], "link_id string, abstract_text string, language string, lang string, share double")
    got = {(r["link_id"], r["lang"]) for r in language.wrong_labels(df, s).collect()}
    assert got == {("wrong", "de"), ("none", "fr"), ("und", "tr"), ("mixed", "en"), ("mixed", "ja"), ("odd", "it")}
    assert language.wrong_labels(df.limit(0), s).count() == 0


def test_language_of_held_out_samples(spark):
    pdf = spark.read.parquet(SAMPLES).toPandas()
    test = pdf.groupby("lang").tail(5)
    model = language.train(pdf.drop(test.index))
    import pandas as pd

    out = pd.concat(language.detect(iter([pd.DataFrame({"id": test["lang"], "text": test["text"]})]), model))
    assert (out["id"] == out["lang"]).mean() == 1.0 and len(out) == len(test)


def test_segments_of_a_long_mixed_text(spark):
    s = spark.read.parquet(SAMPLES)
    by = {r["lang"]: r["text"] for r in s.collect()}
    text = (by["en"] + "\n") * 400 + (by["de"] + "\n") * 100
    r = language.detect_languages(spark.createDataFrame([("a", text)], "k string, t string"), "k", "t", s).collect()
    assert {x["lang"] for x in r} == {"en", "de"} and abs(sum(x["share"] for x in r) - 1) < 0.01
    de = next(x for x in r if x["lang"] == "de")["segments"]
    assert de[0][0] == 400 * (len(by["en"]) + 1)


# 6 names


def test_names(spark):
    a = [("A1", "Henrietta T. Danbanzegre", "Univ of X"), ("A2", "Danbanzegre, Hetty", "X University"), ("A3", "DANBANZEGRE, HT", None), ("A4", "Danbanzergre, H.", "Univ. X"), ("A5", "Patricia Danbanzegre", "Univ of Y"), ("A6", None, None), ("A7", "", None), ("A8", "The Noklanosi Sleep Consortium", None), ("A9", "Consortium, Noklanosi Sleep", None), ("A1", "Henrietta T. Danbanzegre", "Univ of X"), (None, "Nobody Here", None)]
    r = [("l1", ["H. T. Danbanzegre", None, "et al.", "Danbanzegre P", "Noklanosi Sleep Consort.", "Zzz Unknownsurname", "Q. Danbanzegre"]), ("l2", None), ("l3", [])]
    authors = spark.createDataFrame([(*x, "k", 1) for x in a], "author_id string, display_name string, institution string, key_a string, n int")
    refs = spark.createDataFrame([(*x, "k") for x in r], "link_id string, authors array<string>, entity string")
    got = rows(names.linked_names(refs, authors))
    people = ["A1", "A2", "A3", "A4"]
    want = {(x, y) for x in people for y in people if x < y} | {("A8", "A9"), ("A1", "l1#1"), ("A5", "l1#4"), ("A8", "l1#5")}
    assert got == want
    assert names.linked_names(refs.limit(0), authors.limit(0)).count() == 0


def test_short_names(spark):
    a = [("A1", "Li, X."), ("A2", "X Li"), ("A3", "Wu J"), ("A4", "NG, A."), ("A5", "李明"), ("A6", "Marta Brown"), ("A7", "M. Bronw"), ("A8", "Chen, Y."), ("A9", "Cheng, Y."), ("B1", "J. Y.")]
    r = [("l1", ["Li X", "WU J", "A. Ng", "李明", "Brwn, Marta", "J. Y.", "Li, Y."])]
    authors = spark.createDataFrame([(*x, None) for x in a], "author_id string, display_name string, institution string")
    got = rows(names.linked_names(spark.createDataFrame(r, "link_id string, authors array<string>"), authors))
    assert got == {("A1", "A2"), ("A1", "l1#1"), ("A3", "l1#2"), ("A4", "l1#3"), ("A5", "l1#4"), ("A6", "l1#5")}


def test_near_cores_of_few_letters(spark):
    rng = random.Random(7)
    cores = sorted({"".join(rng.choice("abd") for _ in range(rng.randrange(3, 7))) for _ in range(150)})
    df = spark.createDataFrame([(c,) for c in cores], "core string")
    got = rows(names.near_cores(df, df))
    assert {(a, b) for a in cores for b in cores if a != b and names.one_error(a, b)} <= got


def test_given_names_outside_the_list(spark):
    a = [("A1", "Xiomara Lopez"), ("A2", "X. Lopez"), ("A3", "Rodrigo Lopez"), ("A4", "Lopez, Rodirgo"), ("A5", "Tendai Lopez"), ("A6", "Lopez, Xoimara"), ("A7", "Ebuka Brankovitz"), ("A8", "Brankovitz E")]
    authors = spark.createDataFrame([(*x, None) for x in a], "author_id string, display_name string, institution string")
    got = rows(names.linked_names(spark.createDataFrame([("l1", ["Lopez, Xiomarra", "E. Brankovitz"])], "link_id string, authors array<string>"), authors))
    assert got == {("A1", "A2"), ("A1", "A6"), ("A2", "A6"), ("A3", "A4"), ("A7", "A8"), ("A1", "l1#1"), ("A7", "l1#2")}


def test_organisations_by_all_their_tokens(spark):
    a = [("A1", "European Sleep Society"), ("A2", "Sleep Soc., European"), ("A3", "European Heart Association"), ("A4", "European Hearth Association"), ("A5", "Nordic Kidney Research Network"), ("A6", "The European Sleep Soc.")]
    r = [("l1", ["Europ. Sleep Society", "Europaen Heart Assoc.", "Nordic Kidnney Res. Netw.", "Nordic Liver Research Network", "European Slp. Society", "European Sleep S"])]
    authors = spark.createDataFrame([(*x, None) for x in a], "author_id string, display_name string, institution string")
    got = rows(names.linked_names(spark.createDataFrame(r, "link_id string, authors array<string>"), authors))
    assert got == {("A1", "A2"), ("A1", "A6"), ("A2", "A6"), ("A3", "A4"), ("A1", "l1#1"), ("A3", "l1#2"), ("A5", "l1#3"), ("A1", "l1#5"), ("A1", "l1#6")}


def test_near_cores_equal_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abde") for _ in range(rng.randrange(6, 10))) for _ in range(120)]
    typo = [w[:i] + w[i + 1 :] for w in base[:30] for i in (2,)] + [w[:3] + w[4] + w[3] + w[5:] for w in base[30:60] if len(w) > 5] + [w[:1] + "x" + w[2:] for w in base[60:90]]
    cores = sorted({w for w in base + typo if len(w) >= names.LEAST_TYPO})

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            d = [i for i in range(len(a)) if a[i] != b[i]]
            return len(d) == 1 or (len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]])
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    df = spark.createDataFrame([(c,) for c in cores], "core string")
    got = rows(names.near_cores(df, df))
    assert {(a, b) for a in cores for b in cores if a != b and near(a, b)} <= got


# 7 splitting


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .\n,。\ŕ"), min_size=0, max_size=900), st.integers(8, 60), st.integers(0, 6))
def test_pieces_cover_the_text(text, limit, overlap):
    size, step, halo = len(text), 4 * limit, overlap + limit
    found = []
    for low in range(0, size, step):
        high, start = min(low + step, size), max(0, low - halo)
        found += splitting.cut_range(text[start : high + halo], start, low, high, size, limit, overlap)
    end = 0
    for a, b in found:
        assert a <= end < b and b - a <= limit and (end - a <= overlap + 3)
        end = b
    assert end == size


def test_split_on_edges(spark):
    long, bare = "Word one two. " * 2000, "x" * 9000
    items = [("a", 0, long), ("a", 0, long), ("b", None, bare), ("c", 1, None), ("d", 1, ""), ("e", 1, "y" * 4000), (None, 2, "z" * 4001)]
    df = spark.createDataFrame([(*x, "q") for x in items], "article_id string, chunk_index int, text string, piece string")
    got = splitting.split_texts(df, ["article_id", "chunk_index"], "text").toPandas()
    for key, text in ((("a", 0), long), (("b", None), bare), ((None, 2), "z" * 4001)):
        g = got[[(a if a == a else None, None if c != c else c) == key for a, c in zip(got["article_id"], got["chunk_index"], strict=True)]].sort_values("piece_no")
        assert list(g["piece_no"]) == list(range(len(g))) and g["end"].iloc[-1] == len(text) and (g["piece"].str.len() <= 4000).all()
        assert all(text[b:e] == p for b, e, p in zip(g["begin"], g["end"], g["piece"], strict=True))
        assert all(0 < e - b <= 250 for b, e in zip(g["begin"].iloc[1:], g["end"].iloc[:-1], strict=True))
    assert set(got["article_id"].dropna()) == {"a", "b"}
    assert splitting.split_texts(df.limit(0), ["article_id"], "text").count() == 0


def test_split_files(spark, tmp_path):
    text = "".join(f"Zeile {i} größer 漢字。\n" for i in range(30_000))
    (tmp_path / "f.txt").write_text(text, encoding="utf-8", newline="")
    (tmp_path / "e.txt").write_text("")
    raw = text.encode()
    got = splitting.split_files(spark, [str(tmp_path / "f.txt"), str(tmp_path / "e.txt")], 1000, 50).toPandas().sort_values("piece_no")
    assert list(got["piece_no"]) == list(range(len(got))) and got["end"].iloc[-1] == len(raw) and (got["piece"].str.len() <= 1000).all()
    assert all(raw[b:e].decode() == p for b, e, p in zip(got["begin"], got["end"], got["piece"], strict=True))


def test_split_files_keeps_broken_bytes_in_place(spark, tmp_path):
    raw = "".join(f"Line {i} is größer. " for i in range(9_000)).encode()
    raw = raw[:50_001] + b"\xff\xc3" + raw[50_001:120_000] + b"\x80\x80\x80" + raw[120_000:]
    (tmp_path / "b.txt").write_bytes(raw)
    got = splitting.split_files(spark, [str(tmp_path / "b.txt")], 1000, 50).toPandas().sort_values("piece_no")
    assert list(got["piece_no"]) == list(range(len(got))) and got["end"].iloc[-1] == len(raw) and got["begin"].iloc[0] == 0
    assert all(raw[b:e].decode("utf-8", "replace") == p for b, e, p in zip(got["begin"], got["end"], got["piece"], strict=True))
    assert all(0 < e - b <= 250 for b, e in zip(got["begin"].iloc[1:], got["end"].iloc[:-1], strict=True))


def test_pieces_of_the_tasks(spark):
    """The pieces of each task cover its text, overlap, are within the limit and are numbered."""
    texts = {(r["article_id"], r["chunk_index"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/embed_tasks.parquet").collect() if r["text"] and len(r["text"]) > 4000}
    got = queries.p7_pieces(spark, "/root/testdata/sf0.01").toPandas().sort_values(["article_id", "chunk_index", "piece_no"])
    of = {}
    for r in got.itertuples():
        of.setdefault((r.article_id, r.chunk_index), []).append(r)
    assert len(of) == len({t[:2] for t in texts})
    for a, c, text in texts:
        ps = [p for p in of[a, c] if text[p.begin : p.end] == p.piece]
        assert [p.piece_no for p in ps] == list(range(len(ps))) and ps[0].begin == 0 and ps[-1].end == len(text) and all(len(p.piece) <= 4000 for p in ps)
        assert all(0 < x.end - y.begin <= 250 for x, y in zip(ps, ps[1:], strict=False))


# 8 leakage


def test_near_leaks_are_found(spark):
    """Items planted with a word in forty changed: found where brute force over shingles says so."""
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    items = {i: [rng.choice(vocab) for _ in range(rng.randrange(50, 100))] for i in range(60)}
    docs, planted = [], set()
    for i, w in items.items():
        changed = list(w)
        changed[rng.randrange(20, 30)] = "zzz"
        docs.append((i, " ".join(rng.choice(vocab) for _ in range(80)) + " " + " ".join(changed) + " tail"))
        size = leakage.item_window(len(w))

        def grams(x):
            return {tuple(x[k : k + 5]) for k in range(len(x) - 4)}

        best = max(len(grams(changed[k : k + size]) & grams(w[k : k + size])) / len(grams(changed[k : k + size]) | grams(w[k : k + size])) for k in range(len(w) - size + 1))
        if best >= 0.8:
            planted.add((i, i))
    got = leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string"))
    found = {(r["id"], r["item_id"]) for r in got.where("similarity > 0").collect()}
    assert len(planted) >= 25 and len(found & planted) >= 0.9 * len(planted) and all(a == b for a, b in found)


def test_a_leak_in_several_slices_is_one(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(leakage, "SLICE", 400)
    w = [f"w{i}" for i in range(60)]
    tables = leakage.index_items([(1, " ".join(w))])
    text = " ".join(w[:30] + [f"x{i}" for i in range(1500)] + w[30:])
    out = next(leakage.leaks(iter([pd.DataFrame({"id": [9], "text": [text]})]), tables, leakage.Weights(np.zeros(0, np.uint64), np.zeros(0))))
    assert out["n_windows"].tolist() == [36] and 0.9 < out["containment"][0] < 1


def test_leaks_equal_brute_force(spark):
    item = "the quick brown fox jumps over the lazy dog while nine small cats watch from the old wooden fence today"
    w = item.split()
    docs = [(1, "x " + item.upper() + " y"), (2, "<p>" + " <b>".join(w[:13]) + "</p>"), (3, " ".join(w[:12])), (4, " ".join(w[:6]) + " odd " + " ".join(w[6:12])), (5, None), (6, ""), (7, "a­ " + "­".join(["the", ""]) + ",  " + ";\n".join(w[1:14])), (8, ("pad " * 5000) + " ".join(w[3:17]) + (" pad" * 5000)), (1, "x " + item.upper() + " y")]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, item, "x"), (2, item, "x"), (3, None, "x"), (4, "too short", "x")], "item_id long, text string, id string")
    got = {(r["id"], r["item_id"]) for r in leakage.leaked_items(df, "doc_id", "text", items).where("n_windows > 0").collect()}
    assert got == {(d, i) for d in (1, 2, 7, 8) for i in (1, 2)}
    assert leakage.leaked_items(df.limit(0), "doc_id", "text", items).count() == 0 and leakage.leaked_items(df, "doc_id", "text", items.limit(0)).count() == 0


def test_all_fingerprints_within_the_radius_are_found():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    b = a.copy()
    for i in range(300):
        for bit in rng.choice(64, i % 5, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    keys = leakage.blocks(a)
    order = tuple(np.argsort(k, kind="stable") for k in keys)
    starts = tuple(np.searchsorted(k[o], np.arange((1 << 16) + 1)) for k, o in zip(keys, order, strict=True))
    items = leakage.Items(a, np.arange(300), np.zeros((300, 13), np.uint64), order, starts, np.ones(300), {})
    i, j = leakage.candidates(b, items)
    assert {(x, y) for x, y in zip(i, j, strict=True)} >= {(k, k) for k in range(300) if k % 5 <= 3}


def test_passes_of_items_add_up(monkeypatch):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(10)]
    monkeypatch.setattr(leakage, "PASS_WINDOWS", 20)
    assert sum(len(t.prints) for t in leakage.index_items(items)) == 80 and len(leakage.index_items(items)) > 1


# 9 mixing


def test_mixture_reaches_the_shares(spark):
    docs = [(i, "word " * (5 + i % 60), ["a", " A", "b", "c"][i % 4]) for i in range(1200)] + [(2000, None, "a"), (2001, " ", "b"), (2002, "x", None), (2003, "x y", "unlisted"), (0, "word " * 5, "a")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, copies int")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.1, 8), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    mixed = mixing.mixture(df, targets).cache()
    share = {r["source"]: r for r in mixing.shares(mixed, df, targets).collect()}
    for s, want in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert abs(share[s]["actual_share"] - want) < 0.01
    assert share["none"]["n_documents"] == 0 and all((r["most_copies"] <= r["max_repeats"]) for r in share.values())
    assert mixed.groupBy("doc_id").count().where("count > 1").count() == 0
    assert mixing.mixture(df.limit(0), targets).count() == 0


def test_flight_keeps_the_totals():
    rng = np.random.default_rng(4)
    tokens, pi = rng.integers(1, 1000, 500), np.full(500, 0.37)
    out = mixing.flight(pi, tokens)
    left = (out > 1e-6) & (out < 1 - 1e-6)
    assert left.sum() <= 2 and abs(out.sum() - pi.sum()) < 1e-6 and abs((out * tokens).sum() - (pi * tokens).sum()) < 1e-3
    assert set(np.unique(mixing.land(out, tokens))) <= {0.0, 1.0}


# 10 encodings


@pytest.fixture(scope="module")
def model(spark):
    return encodings.Plausibility([r["text"] for r in spark.read.parquet(SAMPLES).collect()])


@pytest.mark.parametrize(("read_as", "written_in"), [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8"), ("latin-1", "cp1251"), ("cp1251", "utf-8")])
def test_round_trip(model, read_as, written_in):
    text = "Настоящее исследование описывает усталость после первой оценки результатов. " if "1251" in written_in else "Das überarbeitete Protokoll berücksichtigt Müdigkeit ebenso wie Schlafqualität über einen Zeitraum von 3 Monaten. "
    bad = text.encode(written_in).decode(read_as, "strict" if read_as != "cp1252" else "replace")
    assert encodings.repair(bad, model) == (text, False)


def test_twice_misread(model):
    text = "La présente étude compare l'éducation précoce avec la durée du séjour."
    assert encodings.repair(text.encode().decode("latin-1").encode().decode("latin-1"), model)[0] == text


def test_thrice_misread(model):
    text = bad = "L'étude présente a été répétée à l'hôpital après la première année."
    for _ in range(3):
        bad = bad.encode().decode("latin-1")
    assert encodings.repair(bad, model) == (text, False)


@pytest.mark.parametrize("dear", [200.0])
def test_repair_through_a_dearer_state(monkeypatch, dear):
    class Costs:
        def cost(self, text):
            return {"aé": 100.0, "bé": dear, "cé": 1.0}[text]

        def odd(self, text, most=0.0):
            return text == "aé"

    monkeypatch.setattr(encodings, "neighbours", lambda text: iter({"aé": [("bé", True)], "bé": [("cé", True)], "cé": []}[text]))
    assert encodings.restore("aé", Costs()) == "cé"


@pytest.mark.parametrize("text", ["The letters Ã and Â occur in the place names SÃO VELDO and ÂNGRA.", "O título “EDUCAÇÃO E GESTÃO” consta em maiúsculas (NÃO é erro).", "Örn Ðalvík and Þóra Ýrsdal are invented names.", "Costs: £5, ¥8, §4 and ¶2 apply © the authors.", "Ψ, Σ and Δ denote fixed effects; ½ dose at 9 °C.", "We write √(n) ≈ 4 and ∂f/∂x ≤ 1 throughout.", "stored as &eacute;tude &amp; r&eacute;sum&eacute;", "Doses were 5 µg ± 0.4 per day.", ""])
def test_sound_texts_stay(model, text):
    assert encodings.repair(text, model) == (text, False)


FOREIGN = {
    "pl": "Zażółć gęślą jaźń. Łódź, Kraków i Gdańsk są piękne.",
    "cs": "Příliš žluťoučký kůň úpěl ďábelské ódy. Dvě děti šly do školy, protože je to důležité.",
    "hu": "Árvíztűrő tükörfúrógép. A gyűrűk ára ötezer forint.",
    "el": "Το γρήγορο καφέ αλεπού πηδάει πάνω από το σκυλί.",
    "vi": "Tiếng Việt rất đẹp và phong phú.",
    "he": "שלום עולם, מה שלומך היום",
    "hi": "नमस्ते दुनिया",
    "th": "สวัสดีชาวโลก",
    "ko": "안녕하세요 세계",
    "uk": "Привіт, як справи? Її ім’я — Ґалина.",
    "da": "Blåbærsyltetøy på brødskive, søndag morgen.",
    "is": "Ég get borðað gler án þess að meiða mig. Þetta er ágætt.",
    "lv": "Rīts ir ļoti skaists, ģimene ēd brokastis.",
}
RARE = ["K. Süß and Ö. Groß (2001).", "Brontë", "We read Emily Brontë and coöperate with MÜLLER.", "Bjørn Åkesson", "MAÇÃ", "½ cup of milk", "α", "the α and β levels", "¡Hola! ¿Qué tal?", "┌───┐\n│ a │\n└───┘", "line\x85line", "icon \uf0b7 item", "The cost was €4 per visit, £5, ¥800, §4.", "à €9 per visit", "Smith† and Jones‡ agree", "H₂O CO₂ m² 10°C 5′–3′ ∞ 3×4 µm Å", "“État” « été » l’École", "США»; Её «Россия»", "don´t do it", "emoji 😀 👍🏽 here", "co\xadop\xaderation", "price ￥5 №3 ℃ ™ ® ©", "Íñigo Núñez y Ángel Gutiérrez", "İstanbul’da ığdır şehri", "naïve façade — résumé…"]


@pytest.mark.parametrize("text", [*FOREIGN.values(), *RARE])
def test_rare_and_foreign_texts_stay(model, text):
    assert encodings.repair(text, model) == (text, False)


@pytest.mark.parametrize("text", ["caf&Atilde;&copy; au lait", "caf\\u00c3\\u00a9 au lait", "caf&#195;&#169; au lait"])
def test_misread_then_escaped(model, text):
    assert encodings.repair(text, model) == ("café au lait", False)


def test_mac_read_as_windows(model):
    assert encodings.repair("The dÈj‡ vu item was dropped.", model)[0] == "The déjà vu item was dropped."


def test_restored_is_what_was_written(spark, model):
    clean = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang in ('de', 'fr', 'es', 'pt', 'it', 'ru', 'tr')").select("text").collect()]
    clean = [t for t in clean if t and not t.isascii() and encodings.repair(t, model) == (t, False)][:150]
    right = total = 0
    for i, text in enumerate(clean):
        read_as = ("cp1252", "latin-1", "cp1251", "cp437", "mac_roman")[i % 5]
        try:
            bad = text.encode().decode(read_as)
        except UnicodeDecodeError:
            continue
        total += 1
        right += encodings.repair(bad, model)[0] == text
    assert total > 80 and right >= 0.95 * total, (right, total)


def test_cut_search_is_reported(spark, monkeypatch):
    m = encodings.Plausibility(["Ein Text."])
    monkeypatch.setattr(encodings, "STATES", 0)
    assert list(encodings.repairs(iter([__import__("pandas").DataFrame({"id": [1], "text": ["schÃ¶n"]})]), ["Ein Text."]))[0]["searched"].tolist() == [False]
    assert encodings.mend("schÃ¶n", m)[2] is False


def test_encodings_on_edges(spark):
    s = spark.read.parquet(SAMPLES)
    docs = [(1, "The cafÃ©-based sessions ran weekly."), (2, "Lost caf� here."), (3, "plain"), (4, None), (5, ""), (6, "Die gute Ernährung der Fälle."), (7, "Sound line.\n" * 3000 + "The cafÃ©-based sessions."), (1, "The cafÃ©-based sessions ran weekly."), (None, "cafÃ©")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, restored string")
    got = {r["id"]: r for r in encodings.restore_encodings(df, "doc_id", "text", s).collect()}
    assert set(got) == {1, 2, 7} and got[1]["restored"] == "The café-based sessions ran weekly." and got[2]["lost"] and got[7]["restored"].endswith("café-based sessions.")
    assert encodings.restore_encodings(df.limit(0), "doc_id", "text", s).count() == 0
    assert F is not None


def test_padded_placeholders_have_no_language(spark):
    s = spark.read.parquet(SAMPLES)
    df = spark.createDataFrame([("a", "No abstract available" + " " * 200), ("b", "\n" * 100 + "N/A" + " " * 100), ("c", "The registry extract described sleep quality and blood pressure in rural clinics over several years.")], "id string, text string")
    assert {r["id"] for r in language.detect_languages(df, "id", "text", s).collect()} == {"c"}


def test_most_candidates_of_an_error_go_before_their_distance(spark):
    from citeloom.llm.names import halves, letters, near, one_error

    rng = random.Random(6)
    bases = ["".join(rng.choice("abcé") for _ in range(n)) for n in (3, 4, 5, 6, 7, 8, 9) for _ in range(6)]
    tokens = sorted({*bases, *(v for t in bases for k in range(len(t)) for v in (t[:k] + "x" + t[k + 1 :], t[:k] + t[k + 1 :], t[:k] + "x" + t[k:], t[:k] + t[k + 1 : k + 2] + t[k : k + 1] + t[k + 2 :]))})
    pairs = [(a, b) for a in tokens for b in [*rng.sample(tokens, 12), *bases[:3], *(t for t in tokens if one_error(a, t))] if a != b and len(a) > 2 and len(b) > 2]
    a, b = F.col("a"), F.col("b")
    plain = (F.levenshtein(a, b, 1) >= 0) | ((F.length(a) == F.length(b)) & (F.levenshtein(a, b, 2) == 2) & (letters(a) == letters(b)))
    found = spark.createDataFrame(pairs, "a string, b string").select("a", "b", halves(a, b).alias("halves"), near(a, b, F.xxhash64(letters(a)), F.xxhash64(letters(b))).alias("near"), plain.alias("plain")).collect()
    assert all(r["near"] == r["plain"] and (r["near"] or not one_error(r["a"], r["b"])) for r in found)
    assert sum(r["near"] for r in found) > 100 and sum(not r["halves"] for r in found) > 100

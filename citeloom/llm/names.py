"""Spellings of one person or organisation linked: a prefix-filtered q-gram join of rare tokens, verified by the other tokens of the names."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.spellings import FULL_FORM, ORGANISATION_WORDS, PARTICLES, WEAK_WORDS, given_names, institution_key, name_roles, tokens
from citeloom.llm.groups import connected_groups
from citeloom.session import cut

#: Letters of a gram, and grams that one typing error (a letter wrong, missing, added, or two swapped) can destroy at most.
GRAM, DESTROYED = 3, 4
#: Letters of a rare token from which grams find an error in it; shorter ones are found by what is left without one of their letters.
LEAST_TYPO = 6
#: Letters of the shortest token that is compared despite an error.
LEAST_NEAR = 3
#: Share of the weight of each of two organisations' tokens that the other must have; what a token counts that is one typing error apart; letters of an abbreviation.
SAME, NEAR, SHORTEST = 0.75, 0.9, 3


def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for raw in batch["raw"]:
            parts, joined, organisation = tokens(raw)
            rows.append((raw, parts, joined, organisation, *name_roles(raw, parts, joined)))
        yield pd.DataFrame(rows, columns=["raw", "parts", "joined", "organisation", "surnames", "givens"])


def shape(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for raw, parts, joined, core in zip(batch["raw"], batch["parts"], batch["joined"], batch["core"], strict=True):
            rows.append((raw, core, *given_names(list(parts), list(joined), core)))
        yield pd.DataFrame(rows, columns=["raw", "core", "initial", "given", "second"])


def name_forms(names: DataFrame) -> DataFrame:
    """(raw, core, initial, given, second) of names(raw), as forms_and_neighbours has them."""
    return forms_and_neighbours(names)[0]


def forms_and_neighbours(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw, core, initial, given, second) of distinct raw names: the core is the rarest token, weighed over all distinct names.

    Tokens that stand as given names more often than as surnames, as commas, initials and the order of all names show it, or second parts of a hyphenated word, are cores only where a name has nothing else; the list of given names adds one vote. Names of initials alone have no row. An organisation has the initial '#' and, as core, a name for all its spellings.
    Beside them, (a, b): all pairs of persons' cores and given names that are one error apart, which all later steps share.
    """
    parsed = cut(names.select("raw").distinct().mapInPandas(parse, "raw string, parts array<string>, joined array<string>, organisation boolean, surnames array<string>, givens array<string>"))
    hidden = cut(hidden_organisations(parsed))
    people = parsed.where("not organisation").join(hidden, "raw", "left_anti")
    exploded = people.select("raw", F.explode("parts").alias("t"), "joined", "surnames", "givens", F.size("parts").alias("size"))
    # one letter is a name only before a comma or in a script whose letters are words
    exploded = exploded.where((F.length("t") > 1) | (F.col("t") >= "\u2e80") | F.array_contains("surnames", F.col("t")))
    known = F.when(F.col("t").isin(list(FULL_FORM)), 1).otherwise(0)
    stands = lambda c: F.sum(F.array_contains(c, F.col("t")).cast("int"))
    # written, so that its size is known: a small vocabulary is joined without a shuffle of the names
    df = cut(exploded.groupBy("t").agg(F.count("*").alias("df"), stands("surnames").alias("s"), stands("givens").alias("g")))
    common = list({*ORGANISATION_WORDS, *WEAK_WORDS, *PARTICLES})
    # a word of one or two letters is weak beside longer ones, unless it stands as a surname
    short = (F.length("t") < 3) & (F.col("t") < "\u2e80") & (F.col("size") > 1) & (F.col("s") <= F.col("g"))
    rank = F.when(short | F.col("t").isin(common) | F.array_contains("joined", F.col("t")) | (F.col("g") + known > F.col("s")), 1).otherwise(0)
    cores = exploded.join(df, "t").groupBy("raw").agg(F.min(F.struct(rank.alias("rank"), "df", (-F.length("t")).alias("l"), F.col("t"))).alias("m")).select("raw", F.col("m.t").alias("core"))
    forms = cut(people.join(cores, "raw").mapInPandas(shape, "raw string, core string, initial string, given string, second string"))
    pairs = cut(near_tokens(forms.select(F.explode(F.array("core", "given")).alias("core"))))
    forms = forms.join(cut(right_givens(forms, pairs)), ["core", "given"], "left").select("raw", "core", F.when(F.col("right") != "", F.substring("right", 1, 1)).otherwise(F.col("initial")).alias("initial"), F.coalesce("right", "given").alias("given"), "second")
    return forms.union(organisations(parsed.where("organisation").union(parsed.where("not organisation").join(hidden, "raw", "left_semi")).select("raw", "parts"))), pairs


def hidden_organisations(parsed: DataFrame) -> DataFrame:
    """(raw) of organisations of which no word says so, but all words, two or more, are met in organisations more than in other names ('Noklanosi Sleep SG')."""
    long = F.filter("parts", lambda t: F.length(t) >= SHORTEST)
    words = parsed.select("raw", "organisation", F.size(long).alias("size"), F.explode(long).alias("t"))
    theirs = words.groupBy("t").agg((F.sum(F.col("organisation").cast("int")) * 2 > F.count("*")).alias("theirs")).where("theirs").select("t")
    # a name of which every word is theirs has as many words left as it had
    return words.where("not organisation and size > 1").join(theirs, "t").groupBy("raw").agg(F.count("*").alias("n"), F.max("size").alias("size")).where("n = size").select("raw")


def right_givens(forms: DataFrame, pairs: DataFrame) -> DataFrame:
    """(core, given, right) of given names taken as slips of the pen: one error apart from a better supported one.

    A real given name is met with several surnames, a slip with one; the right one is met with the same surname, or with several others.
    Of four letters or less nothing is a slip, as too many short names are neighbours.
    """
    used = cut(forms.where(F.length("given") > 4).groupBy("core", "given").agg(F.count("*").alias("n")))
    support = cut(used.groupBy("given").agg(F.count("*").alias("cores"), F.sum("n").alias("n")))
    names = support.select(F.col("given").alias("core"))
    a = support.where("cores = 1").select(F.col("given").alias("a"), F.col("n").alias("na"))
    b = support.select(F.col("given").alias("b"), F.col("cores").alias("cb"), F.col("n").alias("nb"))
    better = (F.col("cb") > 1) | (F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.length("b") < F.length("a"))) | ((F.col("nb") == F.col("na")) & (F.length("b") == F.length("a")) & (F.col("b") < F.col("a")))
    slips = cut(near_cores(a.select(F.col("a").alias("core")), names, pairs).join(a, "a").join(b, "b").where(better))
    mine = used.select("core", F.col("given").alias("a")).join(slips, "a").join(used.select("core", F.col("given").alias("b"), F.lit(True).alias("same")), ["core", "b"], "left")
    best = mine.where("same or cb >= 3").groupBy("core", "a").agg(F.max(F.struct(F.coalesce("same", F.lit(False)).alias("same"), "cb", "nb", "b")).alias("m"))
    return best.select("core", F.col("a").alias("given"), F.col("m.b").alias("right"))


def expanded(token: str) -> str:
    """The word that an abbreviation of a kind of organisation stands for."""
    return ORGANISATION_WORDS.get(token, token)


def one_error(a: str, b: str) -> bool:
    """Whether two different tokens are one typing error apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i + 2 :] == b[i + 2 :] and a[i : i + 2] == b[i : i + 2][::-1])


def token_likeness(a: str, b: str) -> float:
    """1 for equal tokens, abbreviations by prefix and initials; less for other abbreviations ('slp' for 'sleep') and tokens one typing error apart; else 0."""
    short, long = sorted((a, b), key=len)
    if a == b or (long.startswith(short) and (len(short) >= SHORTEST or len(short) == 1)):
        return 1.0
    rest = iter(long[1:])
    letters = len(short) >= SHORTEST and len(short) < len(long) and short[0] == long[0] and all(c in rest for c in short[1:])
    return NEAR if letters or (len(short) > SHORTEST and one_error(a, b)) else 0.0


def same_organisation(a: list[str], wa: list[float], b: list[str], wb: list[float]) -> bool:
    """Whether each of two sets of tokens holds enough of the other's weight, token by token, the likest and heaviest first.

    Where each has a word of its own that the other has nothing like, they are two organisations.
    """
    found = sorted(((token_likeness(x, y), wa[i] + wb[j], i, j) for i, x in enumerate(a) for j, y in enumerate(b)), reverse=True)
    mine, theirs, ma, mb = set(range(len(a))), set(range(len(b))), 0.0, 0.0
    for like, _, i, j in found:
        if like and i in mine and j in theirs:
            mine.discard(i)
            theirs.discard(j)
            ma, mb = ma + like * wa[i], mb + like * wb[j]
    if any(len(a[i]) > 1 for i in mine) and any(len(b[j]) > 1 for j in theirs):
        return False
    return ma >= SAME * sum(wa) and mb >= SAME * sum(wb)


def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        same = [same_organisation(*map(list, x)) for x in zip(batch["ta"], batch["wa"], batch["tb"], batch["wb"], strict=True)]
        yield batch.loc[same, ["a", "b"]]


def organisations(parsed: DataFrame) -> DataFrame:
    """(raw, core, initial, given, second) of organisations parsed into (raw, parts): names whose tokens agree by weight, directly or by a chain, have one core.

    Weights are those of rarity among all distinct organisations. Of two that agree, each has enough of its weight in the other, so one
    of its heaviest tokens, which hold more than may be missing, has a like token there: those are joined with all tokens.
    """
    word = F.udf(expanded, "string")
    few = ["the", "of", "for", "and", "on", "in"]
    kept = F.filter("parts", lambda t: ~t.isin(few))
    keys = cut(parsed.select("raw", F.concat_ws(" ", F.array_sort(F.array_distinct(kept))).alias("written")))
    words = keys.select("written", F.explode(F.split("written", " ")).alias("t")).distinct()
    words = words.join(words.select("t").distinct().withColumn("w", word("t")), "t")
    named = cut(words.groupBy("written").agg(F.concat_ws(" ", F.array_sort(F.collect_set("w"))).alias("name")))
    each = named.select("name").distinct().select("name", F.explode(F.split("name", " ")).alias("t"))
    n = named.select("name").distinct().count()
    df = cut(each.groupBy("t").agg(F.count("*").alias("df")))
    weight = F.log(F.lit(1.0) + F.lit(float(n)) / F.col("df"))
    sets = cut(each.join(df, "t").groupBy("name").agg(F.array_sort(F.collect_list(F.struct((-weight).alias("m"), "t"))).alias("s")).select("name", F.transform("s", lambda x: x["t"]).alias("t"), F.transform("s", lambda x: -x["m"]).alias("w")))
    # the heaviest tokens, as many as hold more weight than may be missing
    heavy = F.udf(lambda t, w: t[: next((i + 1 for i in range(len(w)) if math.fsum(w[: i + 1]) > (1 - SAME) * math.fsum(w) + 1e-9), len(t))], "array<string>")
    first = sets.select("name", F.explode(heavy("t", "w")).alias("t")).where(F.length("t") > 1)
    tokens_of = df.select(F.col("t").alias("core"))
    start = lambda c: F.substring(c, 1, SHORTEST)
    long = df.where(F.length("t") >= SHORTEST)
    begins = long.select(F.col("t").alias("a"), start("t").alias("p")).join(long.select(F.col("t").alias("b"), start("t").alias("p")), "p").where("a <> b and (startswith(a, b) or startswith(b, a))").select("a", "b")
    alike = cut(df.select(F.col("t").alias("a"), F.col("t").alias("b")).union(near_cores(tokens_of, tokens_of)).union(begins).distinct())
    others = sets.select("name", F.explode("t").alias("t"))
    near_names = first.select(F.col("name").alias("a"), F.col("t").alias("x")).join(alike.select(F.col("a").alias("x"), F.col("b").alias("y")), "x").join(others.select(F.col("name").alias("b"), F.col("t").alias("y")), "y").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda k: sets.select(F.col("name").alias(k), F.col("t").alias(f"t{k}"), F.col("w").alias(f"w{k}"))
    links = near_names.join(side("a"), "a").join(side("b"), "b").mapInPandas(compared, "a string, b string")
    groups = connected_groups(links).select(F.col("record").alias("name"), "group")
    empty = F.lit("")
    return keys.join(named, "written").join(groups, "name", "left").select("raw", F.coalesce("group", "name").alias("core"), F.lit("#").alias("initial"), empty.alias("given"), empty.alias("second"))


def halves(a: Column, b: Column) -> Column:
    """Whether two tokens begin or end alike, as they do where one letter is wrong, missing or added: what is before or behind it is half of a token, but for one letter."""
    h = F.greatest(F.floor(F.least(F.length(a), F.length(b)) / 2).cast("int") - 1, F.lit(0))
    return (F.substring(a, F.lit(1), h) == F.substring(b, F.lit(1), h)) | (F.substring(a, -h, h) == F.substring(b, -h, h))


def letters(c: Column) -> Column:
    return F.array_sort(F.split(c, ""))


def near(a: Column, b: Column, la: Column, lb: Column) -> Column:
    """Whether two tokens are at most one typing error apart; la and lb, a number for the letters of each, and halves are cheaper looks, by which most candidates go."""
    one = halves(a, b) & (F.levenshtein(a, b, 1) >= 0)
    return one | ((la == lb) & (F.length(a) == F.length(b)) & (F.levenshtein(a, b, 2) == 2) & (letters(a) == letters(b)))


def grams(cores: DataFrame) -> DataFrame:
    """(core, gram, pos): the rarest grams of each core, as many as an error can destroy and one more; gram frequencies over all cores."""
    padded = F.concat(F.lit("^"), F.col("core"), F.lit("$"))
    every = cores.select("core", F.explode(F.sequence(F.lit(0), F.length("core") + 2 - GRAM)).alias("pos"), padded.alias("p")).select("core", "pos", F.col("p").substr(F.col("pos") + 1, F.lit(GRAM)).alias("gram"))
    df = every.groupBy("gram").agg(F.count("*").alias("df"))
    order = F.array_sort(F.collect_list(F.struct("df", "gram", "pos")))
    return every.join(df, "gram").groupBy("core").agg(F.slice(order, 1, DESTROYED + 1).alias("g")).select("core", F.explode("g").alias("x")).select("core", F.col("x.gram").alias("gram"), F.col("x.pos").alias("pos"))


def near_tokens(tokens: DataFrame) -> DataFrame:
    """(a, b) of different tokens(core) one error apart, both ways: two such share a gram of their prefixes, at most one place apart; tokens under LEAST_TYPO letters share a deletion."""
    every = cut(tokens.select("core").where(F.length("core") >= LEAST_NEAR).distinct())
    number = F.xxhash64(letters(F.col("core"))).alias("l")
    prefix = cut(grams(every.where(F.length("core") >= LEAST_TYPO)).select("core", "gram", "pos", number))
    a = prefix.select(F.col("core").alias("a"), F.col("l").alias("la"), "gram", F.explode(F.array(F.col("pos") - 1, F.col("pos"), F.col("pos") + 1)).alias("pos"))
    long = a.join(prefix.withColumnsRenamed({"core": "b", "l": "lb"}), ["gram", "pos"]).select("a", "b", "la", "lb")
    # short ones one error apart are equal once a letter is left out of one or both
    without = F.transform(F.sequence(F.lit(1), F.length("core")), lambda i: F.concat(F.substring("core", F.lit(1), i - 1), F.substring("core", i + 1, F.length("core"))))
    less = every.where(F.length("core") <= LEAST_TYPO).select("core", number, F.explode(F.array_distinct(F.array_append(without, F.col("core")))).alias("less"))
    brief = less.withColumnsRenamed({"core": "a", "l": "la"}).join(less.withColumnsRenamed({"core": "b", "l": "lb"}), "less").where(F.least(F.length("a"), F.length("b")) < LEAST_TYPO).select("a", "b", "la", "lb")
    # each pair is compared one way
    one_way = long.union(brief).where((F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1)).where(near(F.col("a"), F.col("b"), F.col("la"), F.col("lb"))).select("a", "b").distinct()
    return one_way.withColumn("x", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).select("x.a", "x.b")


def near_cores(left: DataFrame, right: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b) of different cores of left and right one error apart, out of pairs, which holds all that there are, or is made here."""
    if pairs is None:
        pairs = near_tokens(left.select("core").union(right.select("core")))
    return pairs.join(left.select(F.col("core").alias("a")), "a", "left_semi").join(right.select(F.col("core").alias("b")), "b", "left_semi")


def agree(x: str, y: str) -> Column:
    """Whether two sets of values have one in common or one of them is empty."""
    return (F.size(x) == 0) | (F.size(y) == 0) | F.arrays_overlap(x, y)


def entities(batches: pd.DataFrame) -> pd.DataFrame:
    """Authors of one core and initial whose givens, second initials or institutions disagree, put together as far as they agree."""
    rows = batches.sort_values("author_id").to_dict("records")
    groups: list[dict] = []

    def fits(g: dict, r: dict) -> bool:
        return all(not r[k] or not g[k] or r[k] in g[k] for k in ("given", "second", "place"))

    # the rows that say most come first; those that say less join the one group that they fit, the larger where several do
    for r in sorted(rows, key=lambda r: (-bool(r["given"]) - bool(r["second"]) - bool(r["place"]), r["author_id"])):
        fit = sorted((g for g in groups if fits(g, r)), key=lambda g: (-sum(bool(r[k]) and r[k] in g[k] for k in ("given", "second", "place")), -g["n"], g["entity"]))
        if fit:
            g = fit[0]
        else:
            g = {"entity": r["author_id"], "n": 0, "given": set(), "second": set(), "place": set(), "rows": []}
            groups.append(g)
        g["n"] += 1
        g["rows"].append(r)
        for k in ("given", "second", "place"):
            if r[k]:
                g[k].add(r[k])
    out = [(r["author_id"], min(x["author_id"] for x in g["rows"])) for g in groups for r in g["rows"]]
    return pd.DataFrame(out, columns=["author_id", "entity"])


def certain(a: str, b: str, givens: Column) -> Column:
    """Short cores have many neighbours: of those an error apart, the given name in full must be the same."""
    return (F.least(F.length(a), F.length(b)) >= LEAST_TYPO) | givens


def author_entities(authors: DataFrame, forms: DataFrame, neighbours: DataFrame | None = None) -> DataFrame:
    """(author_id, core, block, initial, given, second, entity) of authors(author_id, display_name, institution): entity is the smallest author_id of the person or organisation."""
    place = F.udf(institution_key, "string")
    rows = authors.where("author_id is not null and display_name is not null").select("author_id", F.col("display_name").alias("raw"), "institution").distinct()
    places = rows.select("institution").distinct().where("institution is not null").select("institution", place("institution").alias("place"))
    rows = cut(rows.join(places, "institution", "left").join(forms, "raw").select("author_id", "core", "initial", "given", "second", F.coalesce("place", F.lit("")).alias("place")).distinct())
    filled = lambda c: F.collect_set(F.when(F.col(c) != "", F.col(c)))
    nodes = cut(rows.groupBy("core", "initial").agg(F.countDistinct("author_id").alias("n"), filled("given").alias("givens"), filled("second").alias("seconds"), filled("place").alias("places")))
    # a core stands for the better supported one among those an error away, if all else that is known agrees
    people = nodes.where("initial <> '#'")
    pairs = near_cores(people, people, neighbours)
    x = nodes.select(F.col("core").alias("a"), "initial", F.col("n").alias("na"), F.col("givens").alias("ga"), F.col("seconds").alias("sa"), F.col("places").alias("pa"))
    y = nodes.select(F.col("core").alias("b"), "initial", F.col("n").alias("nb"), F.col("givens").alias("gb"), F.col("seconds").alias("sb"), F.col("places").alias("pb"))
    better = (F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))
    ok = pairs.join(x, "a").join(y, ["b", "initial"]).where(better & certain("a", "b", F.arrays_overlap("ga", "gb")) & agree("ga", "gb") & agree("sa", "sb") & agree("pa", "pb"))
    best = ok.groupBy("a", "initial").agg(F.max(F.struct(F.arrays_overlap("pa", "pb").alias("same"), F.col("nb"), F.col("b"))).alias("m")).select(F.col("a").alias("core"), "initial", F.col("m.b").alias("to"))
    best = cut(best)
    twice = best.select(F.col("core").alias("to"), "initial", F.col("to").alias("to2"))
    best = best.join(twice, ["to", "initial"], "left").select("core", "initial", F.coalesce("to2", "to").alias("to"))
    rows = rows.join(best, ["core", "initial"], "left").withColumn("block", F.coalesce("to", "core")).drop("to")
    state = rows.groupBy("block", "initial").agg(F.min("author_id").alias("least"), F.size(filled("given")).alias("g"), F.size(filled("second")).alias("s"), F.size(filled("place")).alias("p"))
    clear = (F.col("g") <= 1) & (F.col("s") <= 1) & (F.col("p") <= 1)
    rows = cut(rows.join(state, ["block", "initial"]).withColumn("clear", clear))
    unclear = rows.where("not clear").select("block", "initial", "author_id", "given", "second", "place").groupBy("block", "initial").applyInPandas(entities, "author_id string, entity string").distinct()
    parted = rows.where("not clear").join(unclear, "author_id").select("author_id", "core", "block", "initial", "given", "second", "entity")
    return cut(rows.where("clear").select("author_id", "core", "block", "initial", "given", "second", F.col("least").alias("entity")).union(parted))


def entity_of_names(found: DataFrame, forms: DataFrame, neighbours: DataFrame | None = None) -> DataFrame:
    """(raw, entity) of the raw names that stand for one of the entities: by core, else by a core one error away; the other tokens must agree.

    Of several entities that agree, the one with the same given name, the same second initial, then most authors wins.
    """
    filled = lambda c: F.collect_set(F.when(F.col(c) != "", F.col(c)))
    known = cut(found.groupBy("core", "initial", "entity").agg(filled("given").alias("givens"), filled("second").alias("seconds"), F.countDistinct("author_id").alias("n")))
    whole = found.groupBy("entity").agg(filled("given").alias("e_givens"), filled("second").alias("e_seconds"), F.countDistinct("author_id").alias("e_n"))
    known = cut(known.join(whole, "entity").select("core", "initial", "entity", F.col("e_givens").alias("givens"), F.col("e_seconds").alias("seconds"), F.col("e_n").alias("n")))
    shapes = cut(forms.select("core", "initial", "given", "second").distinct())
    fits = lambda own, theirs: (F.col(own) == "") | (F.size(theirs) == 0) | F.array_contains(theirs, F.col(own))
    score = F.struct(F.array_contains("givens", F.col("given")).alias("g"), F.array_contains("seconds", F.col("second")).alias("s"), F.col("n"), F.col("entity"))

    def pick(joined: DataFrame) -> DataFrame:
        return joined.where(fits("given", "givens") & fits("second", "seconds")).groupBy("core", "initial", "given", "second").agg(F.max(score).alias("m")).select("core", "initial", "given", "second", F.col("m.entity").alias("entity"))

    same = pick(shapes.join(known, ["core", "initial"]))
    left = cut(shapes.where("initial <> '#'").join(known.select("core").distinct(), "core", "left_anti"))
    pairs = near_cores(left, known.where("initial <> '#'"), neighbours)
    sure = certain("core", "b", F.array_contains("givens", F.col("given")))
    typo = pick(left.join(pairs.select(F.col("a").alias("core"), "b"), "core").join(known.withColumnRenamed("core", "b"), ["b", "initial"]).where(sure))
    typo = cut(typo)
    # two spellings with an error each are two apart, but one apart from the right one, which may stand among the names
    hop = known.select("entity", "givens", "seconds", "n").dropDuplicates(["entity"]).join(typo.select(F.col("core").alias("b"), "initial", "entity").distinct(), "entity")
    rest = cut(left.join(typo.select("core", "initial", "given", "second"), ["core", "initial", "given", "second"], "left_anti"))
    pairs = near_cores(rest, hop.select(F.col("b").alias("core")), neighbours)
    twice = pick(rest.join(pairs.select(F.col("a").alias("core"), "b"), "core").join(hop, ["b", "initial"]).where(sure))
    return forms.join(same.union(typo).union(twice), ["core", "initial", "given", "second"]).select("raw", "entity")


def linked_names(references: DataFrame, authors: DataFrame) -> DataFrame:
    """(key_a, key_b): all pairs of author_ids of one person or organisation, and its smallest author_id with link_id#position of each author of the references that stands for it."""
    position = references.select("link_id", F.posexplode("authors").alias("pos", "raw")).where("link_id is not null and raw is not null")
    position = position.select(F.concat("link_id", F.lit("#"), (F.col("pos") + 1).cast("string")).alias("key_b"), "raw")
    forms, near_pairs = forms_and_neighbours(authors.select(F.col("display_name").alias("raw")).where("raw is not null").union(position.select("raw")))
    forms = cut(forms)
    found = author_entities(authors, forms, near_pairs)
    ids = found.select("entity", "author_id").distinct()
    pairs = ids.join(ids.withColumnRenamed("author_id", "other"), "entity").where(F.col("author_id") < F.col("other")).select(F.col("author_id").alias("key_a"), F.col("other").alias("key_b"))
    names = entity_of_names(found, forms, near_pairs)
    return pairs.union(position.join(names, "raw").select(F.col("entity").alias("key_a"), "key_b")).distinct()

"""Terms by their stemmed keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.fields import term_form
from citeloom.functions.stemming import stem


def keyed(rows: DataFrame, term: str) -> DataFrame:
    """rows with the key of a term, its words stemmed; terms without a word have no row. Each distinct term is stemmed once."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({term: batch[term], "key": [" ".join(stem(w) for w in f.split()) for f in batch["form"]]})

    forms = rows.select(term, term_form(term).alias("form")).where("form <> ''").distinct()
    return rows.join(forms.mapInPandas(work, f"`{term}` string, key string"), term)


def deduplicated(rows: DataFrame, key: str, terms: str) -> DataFrame:
    """(key, terms) of rows with a unique key: of terms with one stemmed key the first, in order."""
    each = keyed(rows.select(key, F.posexplode(terms).alias("pos", "term")), "term").groupBy(key, "key").agg(F.min(F.struct("pos", "term")).alias("m"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("m")), lambda x: x["term"]).alias(terms))

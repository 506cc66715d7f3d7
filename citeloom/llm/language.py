"""The languages of a text: character n-grams, mixture proportions by expectation-maximisation, a penalised choice of the language set."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.cleaning import CUT_MARK, MARKUP, own_text, trimmed_lower
from citeloom.session import widened

#: Hash buckets of trigrams and of single characters.
TRIGRAMS, SINGLES = 1 << 16, 1 << 12
#: Nats that a further language must gain over the text, and characters that its stretches must hold; a heading or a quoted word stays below.
PENALTY, LEAST_CHARS = 30.0, 12
STOPS = np.zeros(0x110000, dtype=bool)
STOPS[[ord(c) for c in "\n.!?。！？؟"]] = True

# Labels of the languages, in lower case; the part before a hyphen or underscore counts.
LABELS = {
    "ar": ["ar", "ara", "arabic", "arab", "العربية", "عربي"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "en": ["en", "eng", "english", "englisch"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano", "castilian"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "it": ["it", "ita", "italian", "italiano"],
    "ja": ["ja", "jpn", "jp", "japanese", "日本語"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "ru": ["ru", "rus", "russian", "русский"],
    "tr": ["tr", "tur", "turkish", "türkçe", "turkce"],
    "zh": ["zh", "zho", "chi", "cn", "cmn", "chinese", "中文", "汉语"],
}


def language_label(c: Column | str) -> Column:
    """The two-letter code that a label names; null for a label that is missing, says nothing or names another language."""
    text = trimmed_lower(c)
    names = F.create_map(*(F.lit(x) for code, all_names in LABELS.items() for name in all_names for x in (name, code)))
    return F.coalesce(names[text], names[F.regexp_extract(text, r"^(\p{L}+)", 1)])


@dataclass(frozen=True)
class Model:
    """Log-likelihoods of hashed n-grams by language; a few MB, whatever the corpus."""

    languages: tuple[str, ...]
    trigram: np.ndarray
    single: np.ndarray


def codes(text: str) -> np.ndarray:
    """Code points in lower case, digits as one."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    return np.where((c >= 48) & (c <= 57), 48, c)


def hashes(c: np.ndarray) -> np.ndarray:
    """For each position the bucket of the trigram that ends there."""
    x, y = np.concatenate([[32], c[:-1]]), np.concatenate([[32, 32], c[:-2]])
    return ((c * 40503 + x * 9973 + y * 131071) ^ ((c * 40503 + x * 9973 + y * 131071) >> 15)) % TRIGRAMS


def train(samples: pd.DataFrame) -> Model:
    """From labelled texts (lang, text); texts and labels that are null are left out."""
    samples = samples.dropna(subset=["lang", "text"])
    languages = tuple(sorted(set(samples["lang"])))
    trigram, single = np.full((TRIGRAMS, len(languages)), 0.02), np.full((SINGLES, len(languages)), 0.02)
    for lang, text in zip(samples["lang"], samples["text"], strict=True):
        c = codes(text)
        k = languages.index(lang)
        np.add.at(trigram[:, k], hashes(c), 1)
        np.add.at(single[:, k], c % SINGLES, 1)
    rows = lambda t: np.log(t / t.sum(axis=0)).astype(np.float32)
    return Model(languages, rows(trigram), rows(single))


def stretch_scores(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches between stops and line ends of all texts: text number, start, end, log-likelihood by language."""
    c = codes("\n".join(texts) + "\n")
    lengths = np.fromiter((len(t.lower()) + 1 for t in texts), np.int64, len(texts))
    ends = np.flatnonzero(STOPS[c]) + 1
    starts = np.concatenate([[0], ends[:-1]])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    owner = np.searchsorted(first, starts, side="right") - 1
    h, s = hashes(c), c % SINGLES
    score = np.empty((len(starts), len(model.languages)), dtype=np.float32)
    for k in range(len(model.languages)):
        at = model.trigram[:, k][h] + 0.5 * model.single[:, k][s]
        at[STOPS[c] | (c == 32) | (c == 48)] = 0
        score[:, k] = np.add.reduceat(at, starts) if len(starts) else 0
    return owner, starts - first[owner], ends - first[owner], score


def mixture(score: np.ndarray, size: np.ndarray, chosen: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation of the proportions of the chosen languages: log-likelihood, proportions, each stretch's posterior."""
    part = score[:, chosen].astype(np.float64)
    weight = np.full(len(chosen), 1 / len(chosen))
    for _ in range(20):
        joint = part + np.log(weight + 1e-9)
        top = joint.max(axis=1, keepdims=True)
        post = np.exp(joint - top)
        total = post.sum(axis=1, keepdims=True)
        post /= total
        new = (post * size[:, None]).sum(axis=0) / max(size.sum(), 1)
        done = np.abs(new - weight).max() < 1e-4
        weight = new
        if done:
            break
    return float((top + np.log(total)).sum()), weight, post


def languages_of(score: np.ndarray, size: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The language set: the best one, then each that gains more than PENALTY and has LEAST_CHARS of its own."""
    chosen = [int(score.sum(axis=0).argmax())]
    best, weight, post = mixture(score, size, chosen)
    while len(chosen) < score.shape[1]:
        gain = np.maximum(score - score[:, chosen].max(axis=1, keepdims=True), 0).sum(axis=0)
        nxt = int(gain.argmax())
        if gain[nxt] <= PENALTY:
            break
        tried = mixture(score, size, [*chosen, nxt])
        if tried[0] - best <= PENALTY or (size * (tried[2].argmax(axis=1) == len(chosen))).sum() < LEAST_CHARS:
            break
        chosen.append(nxt)
        best, weight, post = tried
    return chosen, weight, post


def detect(batches: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    """From (id, text) rows (id, lang, share, confidence, segments), one for each language of the text, segments its stretches as [start, end)."""
    for batch in batches:
        texts = list(batch["text"])
        if not texts:
            continue
        owner, start, end, score = stretch_scores(texts, model)
        size = (end - start).astype(np.float64)
        totals = np.zeros((len(texts), score.shape[1]))
        np.add.at(totals, owner, score)
        main = totals.argmax(axis=1)
        # only a text whose stretches gain enough elsewhere can have a second language
        gain = np.zeros(totals.shape)
        np.add.at(gain, owner, np.maximum(score - score[np.arange(len(owner)), main[owner]][:, None], 0))
        mixed = set(np.flatnonzero(gain.max(axis=1) > PENALTY))
        rest = np.sort(totals, axis=1)
        sure = 1 / (1 + np.exp(np.clip(rest[:, -2] - rest[:, -1], -50, 50)))
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        rows = []
        for i, key in enumerate(batch["id"]):
            lo, hi = first[i], first[i + 1]
            if i not in mixed:
                rows.append((key, model.languages[main[i]], 1.0, float(sure[i]), [[0, int(end[hi - 1]) if hi > lo else 0]]))
                continue
            chosen, weight, post = languages_of(score[lo:hi], size[lo:hi])
            own = post.argmax(axis=1)
            for j, k in enumerate(chosen):
                mine = own == j
                spans: list[list[int]] = []
                for a, b in zip(start[lo:hi][mine], end[lo:hi][mine], strict=True):
                    if spans and spans[-1][1] == a:
                        spans[-1][1] = int(b)
                    else:
                        spans.append([int(a), int(b)])
                sure_j = float((post[mine, j] * size[lo:hi][mine]).sum() / max(size[lo:hi][mine].sum(), 1)) if len(chosen) > 1 else float(sure[i])
                rows.append((key, model.languages[k], float(weight[j]), sure_j, spans))
        yield pd.DataFrame(rows, columns=["id", "lang", "share", "confidence", "segments"])


#: Blanks that do not make a placeholder longer.
BLANKS = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"


def detect_languages(texts: DataFrame, key: str, text: Column | str, samples: DataFrame) -> DataFrame:
    """(id, lang, share, confidence, segments) of each text that holds more than a placeholder; id is key as a string.

    samples(lang, text) is a fixed table of labelled texts, from which the n-gram model is trained on the driver. Texts are processed
    whole. Null, empty and placeholder texts have no row; a key that stands on several different texts has the rows of each.
    """
    model = train(samples.select("lang", "text").toPandas())
    raw = widened(texts.select(F.col(key).cast("string").alias("id"), (text if isinstance(text, Column) else F.col(text)).alias("text")).where("id is not null and text is not null"))
    rows = raw.select("id", F.regexp_replace(F.regexp_replace("text", MARKUP, " "), CUT_MARK, "").alias("text"))
    # no placeholder has so many characters that are no blanks; the expressions that tell them from text are for shorter texts
    rows = rows.where(((F.length(F.translate("text", BLANKS, "")) > 80) & F.col("text").rlike(r"\p{L}{2}")) | own_text("text").isNotNull())
    return rows.mapInPandas(lambda batches: detect(batches, model), "id string, lang string, share double, confidence double, segments array<array<int>>")


def wrong_labels(references: DataFrame, samples: DataFrame) -> DataFrame:
    """(link_id, lang, label, share, confidence, segments) of abstracts whose label is missing or wrong, or that are in several languages."""
    label = F.coalesce(language_label("language"), F.lit(""))
    rows = references.where("link_id is not null").select(F.to_json(F.struct("link_id", label.alias("label"))).alias("key"), "abstract_text")
    found = detect_languages(rows, "key", "abstract_text", samples).where((F.col("share") < 1) | (F.get_json_object("id", "$.label") != F.col("lang")))
    return found.select(F.get_json_object("id", "$.link_id").alias("link_id"), "lang", F.nullif(F.get_json_object("id", "$.label"), F.lit("")).alias("label"), "share", "confidence", "segments").dropDuplicates(["link_id", "lang"])

"""Text that was decoded with the wrong encoding: found, and restored by a best-first search over re-decodings and unescapings."""

from __future__ import annotations

import heapq
import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.session import widened

#: Encodings that text may have been read with, and that it may have been written in.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp1250", "cp866", "cp1253", "cp1254", "cp1256", "iso8859_15", "gb18030", "cp932")
WRITTEN_IN = ("cp1252", "mac_roman", "cp1251", "koi8_r", "cp1254", "cp1250", "cp1256", "cp1253", "cp866", "iso8859_5", "iso8859_6", "cp437", "cp850", "gb18030", "cp932", "euc_jp", "big5", "euc_kr")
MANY_BYTES = ("gb18030", "cp932", "euc_jp", "big5", "euc_kr")
#: Nats that a step of a repair costs, and each character that it changes: UTF-8 seldom comes by chance, any bytes give text in a one-byte code.
CHECKED, CHECKED_EACH, LOOSE, LOOSE_EACH, UNESCAPE = 3.0, 1.2, 11.0, 3.5, 1.0
#: Nats that the step costs in one-byte codes where no mark of ill-written text speaks for it.
UNMARKED = 18.0
#: States that are opened for a stretch; a search that has more is reported.
STATES = 2000
#: Nats a character that make a stretch worth a search.
ODD = 4.5
#: The sequences of UTF-8, as ranges of bytes.
UTF8 = [[(0xC2, 0xDF), (0x80, 0xBF)], [(0xE0, 0xE0), (0xA0, 0xBF), (0x80, 0xBF)], [(0xE1, 0xEC), *[(0x80, 0xBF)] * 2], [(0xED, 0xED), (0x80, 0x9F), (0x80, 0xBF)], [(0xEE, 0xEF), *[(0x80, 0xBF)] * 2], [(0xF0, 0xF0), (0x90, 0xBF), *[(0x80, 0xBF)] * 2], [(0xF1, 0xF3), *[(0x80, 0xBF)] * 3], [(0xF4, 0xF4), (0x80, 0x8F), *[(0x80, 0xBF)] * 2]]
STRETCH = re.compile(r"[^\n]*?(?:[.!?](?=[ \n])|\n|$)[ ]*", re.S)
RUN = re.compile(r"[^\x00-\x7f]+")
ESCAPE = re.compile(r"&(?:#\d{2,7}|#[xX][0-9A-Fa-f]{2,6}|[A-Za-z][A-Za-z0-9]{1,8});|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}")
#: Typographic characters count as what stands for them on a keyboard; those that have no width are charged by themselves.
PLAIN = str.maketrans({**dict.fromkeys("“”„«»", '"'), **dict.fromkeys("‘’", "'"), **dict.fromkeys("–—‐‑", "-"), **dict.fromkeys("\xa0  ", " "), "…": ".", **dict.fromkeys("\xad​‌‍⁠﻿", None)})
HIDDEN = re.compile("[\xad​-‏‪-‮⁠-⁤﻿]")
HIDDEN_COST, STRAY_COST, MARK_COST = 11.0, 6.0, 8.0
#: What well-written text does not have, whatever its language: signs inside of words, capitals behind small letters, scripts mixed in a word, accents that stand alone beside letters, lines of boxes beside letters, controls.
MARKS = regex.compile(
    r"(?<=[\p{Latin}\p{Greek}\p{Cyrillic}\p{Arabic}])[^\p{L}\p{M}\p{N}\s’‘‐‑·–—…′″×±°،؛؟\xad​-‍⁠\x00-\x7f](?=[\p{Latin}\p{Greek}\p{Cyrillic}\p{Arabic}])"
    r"|(?<=\p{Ll})(?=[^\x00-\x7f])\p{Lu}|(?<=(?=[^\x00-\x7f])\p{Ll})[A-Z]"
    r"|(?<=\p{Latin})[\p{Cyrillic}\p{Arabic}\p{Hebrew}]|(?<=[\p{Cyrillic}\p{Arabic}\p{Hebrew}])\p{Latin}"
    r"|(?<=\p{L})[¨¸˘ˆ˜˚¯]|[¨¸˘ˆ˜˚¯](?=\p{L})|(?<=\p{L})[─-▟]|[─-▟](?=\p{L})"
    "|[\x80-\x84\x86-\x9f]"
)
BOX = re.compile(r"[─-▟]{2}")
#: Characters lost in reading. A private-use character may be a sign of an icon font, U+0085 a line end.
LOST = re.compile("[�\x80-\x84\x86-\x9f]")
CONTROL = regex.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]|\p{Co}|\p{Cn}|\p{Cs}")


def encode(text: str, codec: str) -> bytes | None:
    """The bytes that codec reads as text; bytes that cp1252 and its kin leave open stand for themselves."""
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        if not codec.startswith("cp125"):
            return None
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode(codec)
        except UnicodeEncodeError:
            if not "\x80" <= ch <= "\x9f":
                return None
            out.append(ord(ch))
    return bytes(out)


def decode(raw: bytes | None, codec: str) -> str | None:
    try:
        return None if raw is None else raw.decode(codec)
    except UnicodeDecodeError:
        return None


def single_bytes(codec: str) -> dict[str, int]:
    """Each character that codec has for a byte from 0x80 on, and that byte; bytes that it leaves open stand for themselves."""
    return {decode(bytes([b]), codec) or chr(b): b for b in range(0x80, 0x100)}


def utf8_in(codec: str) -> re.Pattern:
    """Finds the sequences of characters that are UTF-8 read with codec."""
    chars = {b: re.escape(c) for c, b in TABLES[codec].items()}
    one = lambda lo, hi: "[" + "".join(chars[b] for b in range(lo, hi + 1)) + "]"
    return re.compile("|".join("".join(one(lo, hi) for lo, hi in sequence) for sequence in UTF8))


def swaps(codec: str, other: str) -> dict[str, str]:
    """For each character of codec's upper half the one that other has for its byte."""
    found = {c: decode(bytes([b]), other) for c, b in TABLES[codec].items()}
    return {c: to for c, to in found.items() if to is not None}


TABLES = {codec: single_bytes(codec) for codec in READ_AS if codec not in MANY_BYTES}
SEQUENCES = {codec: utf8_in(codec) for codec in TABLES}
SWAPS = {(a, b): swaps(a, b) for a in TABLES for b in WRITTEN_IN if b not in MANY_BYTES and a != b}


def reread_utf8(text: str, codec: str) -> str:
    """Each sequence of characters that are UTF-8 read with a one-byte codec, read as UTF-8; the rest as it is."""
    byte = TABLES[codec]
    return SEQUENCES[codec].sub(lambda m: bytes(byte[c] for c in m.group()).decode("utf-8"), text)


def unescape(text: str) -> str:
    """Entities and backslash escapes of characters outside ASCII as the characters that they stand for."""

    def char(m) -> str:
        s = m.group()
        to = html.unescape(s) if s[0] == "&" else chr(int(s[2:], 16))
        return to if not to.isascii() and not "\ud800" <= to <= "\udfff" else s

    return ESCAPE.sub(char, text)


def neighbours(text: str) -> Iterator[tuple[str, bool]]:
    """The texts one step away, and whether the step reads UTF-8; it only takes escapes away otherwise."""
    for codec in READ_AS:
        if codec in TABLES:
            changed = reread_utf8(text, codec)
        else:
            changed = RUN.sub(lambda m, codec=codec: decode(encode(m.group(), codec), "utf-8") or m.group(), text)
        if changed != text:
            yield changed, True
    if ESCAPE.search(text):
        yield unescape(text), False


def script(ch: str) -> int:
    """A number for the script of a letter, as far as re-decodings mix them up."""
    c = ord(ch)
    return 0 if c < 0x370 or 0x1E00 <= c < 0x1F00 else 1 if c < 0x400 else 2 if c < 0x530 else 3 if c < 0x800 else 4


@dataclass(frozen=True)
class Option:
    """A re-decoding that any bytes survive: nats gained, the text, how many marks of ill-written text go, the characters changed, and whether the samples have each new one behind the same two characters."""

    gain: float
    text: str
    marks: int
    changed: frozenset
    attested: bool


@dataclass
class Search:
    """What the search of one stretch found: the text, its cost with the steps to it, the one-byte re-decodings that gain over it by pair of codecs, and whether all states were opened."""

    text: str
    found: bool = False
    least: float = 0.0
    loose: dict[tuple[str, str], Option] = field(default_factory=dict)
    whole: bool = True


class Plausibility:
    """The cost of a text in nats: characters after their two predecessors, as counted in clean samples of all languages, with classes of characters behind."""

    def __init__(self, samples: list[str]):
        self.three, self.two, self.one = Counter(), Counter(), Counter()
        for text in samples:
            t = "  " + text.translate(PLAIN)
            self.one.update(t[2:])
            for i in range(2, len(t)):
                self.three[t[i - 2 : i + 1]] += 1
                self.two[t[i - 2 : i]] += 1
        self.pairs, self.heads = Counter(), Counter()
        for key, n in self.three.items():
            self.pairs[key[1:]] += n
            self.heads[key[1]] += n
        self.total = max(1, sum(self.one.values()))
        self.memo: dict[str, float] = {}
        self.known: dict[str, Search] = {}

    def rank(self, ch: str) -> float:
        """Nats for a character of which only the class is known."""
        c = ord(ch)
        if c < 0x80:
            return 6.0
        if c < 0xA0 or c == 0xFFFD or c >= 0xF0000:
            return 14.0
        if ch in "°±µ€£§¶†‡©®·×≤≥½¼¾¹²³":
            return 5.5
        if c < 0x250:
            return 8.0 if ch.isalpha() else 9.5
        if 0x400 <= c < 0x460 or 0x620 <= c < 0x660 or 0x3000 <= c < 0x3100:
            return 7.5
        if 0x4E00 <= c < 0xA000 or 0xFF00 <= c < 0xFF60 or 0xAC00 <= c < 0xD7A4:
            return 9.0
        if 0x370 <= c < 0x400 or 0x2200 <= c < 0x2300 or 0x2080 <= c < 0x20D0:
            return 8.5
        return 11.0

    def char(self, gram: str) -> float:
        cost = self.memo.get(gram)
        if cost is None and BOX.fullmatch(gram[1:]):
            cost = self.memo[gram] = 2.0  # a drawing goes on
        if cost is None:
            heads, two = self.heads[gram[1]], self.two[gram[:2]]
            p = 0.65 * (self.three[gram] / two if two else 0) + 0.22 * (self.pairs[gram[1:]] / heads if heads else 0) + 0.08 * self.one[gram[2]] / self.total + 0.05 * math.exp(-self.rank(gram[2]))
            cost = -math.log(p)
            if len(self.memo) < 500_000:
                self.memo[gram] = cost
        return cost

    def alone(self, ch: str) -> float:
        """Nats of a character by itself."""
        return -math.log(0.3 * self.one[ch.translate(PLAIN) or ch] / self.total + 0.05 * math.exp(-self.rank(ch))) if not HIDDEN.match(ch) else HIDDEN_COST

    def cost(self, text: str) -> float:
        """Nats of the characters, of those without width, of the marks of ill-written text, and of each letter outside the script that most letters have."""
        t, char = "  " + text.translate(PLAIN), self.char
        letters = Counter(script(ch) for run in RUN.findall(t) for ch in run if ch.isalpha())
        if letters:
            letters[0] += len(re.findall("[A-Za-z]", t))
        strays = sum(letters.values()) - max(letters.values(), default=0)
        return sum([char(t[i - 2 : i + 1]) for i in range(2, len(t))]) + HIDDEN_COST * len(HIDDEN.findall(text)) + MARK_COST * marks_of(text) + STRAY_COST * strays

    def attested(self, text: str, new: str) -> bool:
        """Whether the samples have each character of new that differs from text behind the two before it."""
        t = "  " + new.translate(PLAIN)
        return len(t) == len(new) + 2 and all(t[i : i + 3] in self.three for i, (a, b) in enumerate(zip(text, new, strict=True)) if a != b)

    def odd(self, text: str) -> bool:
        """Whether the characters about those outside ASCII cost more than ODD nats each anywhere, or text has marks of ill-written text."""
        if marks_of(text):
            return True
        t = "  " + text.translate(PLAIN) + "  "
        for m in RUN.finditer(t):
            lo, hi = m.start(), min(len(t), m.end() + 2)
            if sum(self.char(t[i - 2 : i + 1]) for i in range(max(2, lo), hi)) > ODD * (hi - lo):
                return True
        return bool(HIDDEN.search(text))


def marks_of(text: str) -> int:
    """How many marks of ill-written text there are; they stand in or beside what is outside ASCII."""
    return len(MARKS.findall(" ".join([text[max(0, m.start() - 1) : m.end() + 1] for m in RUN.finditer(text)])))


def altered(text: str, new: str) -> int:
    """How many characters of text are not in new."""
    return max(1, sum((Counter(text) - Counter(new)).values()))


def loose_steps(text: str, least: float, model: Plausibility) -> dict[tuple[str, str], Option]:
    """Re-decodings that any bytes survive and that gain over least, by pair of codecs.

    None may add controls, unassigned or private characters, characters without width, or marks of ill-written text; a pair that the
    characters by themselves speak against is not scored.
    """
    counts = Counter(ch for run in RUN.findall(text) for ch in run)
    own = {ch: model.alone(ch) for ch in counts}
    marks, hidden, control = marks_of(text), len(HIDDEN.findall(text)), len(CONTROL.findall(text))
    out: dict[tuple[str, str], Option] = {}
    seen: dict[str, Option] = {}

    def score(pair: tuple[str, str], new: str, changed: frozenset) -> None:
        if new not in seen:
            left = marks_of(new)
            if left > marks or len(HIDDEN.findall(new)) > hidden or len(CONTROL.findall(new)) > control:
                seen[new] = Option(0.0, new, 0, changed, False)
            else:
                seen[new] = Option(least - model.cost(new) - LOOSE_EACH * sum(counts[c] for c in changed), new, marks - left, changed, len(new) == len(text) and model.attested(text, new))
        if seen[new].gain > 0:
            out[pair] = seen[new]

    for pair, swap in SWAPS.items():
        changed, gain = [], 0.0
        for ch, n in counts.items():
            to = swap.get(ch)
            if to is None:
                break
            if to != ch:
                changed.append(ch)
                gain += n * (own[ch] - model.alone(to))
        else:
            if changed and (gain > 0 or marks):
                score(pair, text.translate({ord(c): swap[c] for c in changed}), frozenset(changed))
    for codec in TABLES:
        raw = encode(text, codec) if marks else None
        if raw is not None:
            for other in MANY_BYTES:
                new = decode(raw, other)
                if new is not None and new != text and len(new) < len(text):
                    score((codec, other), new, frozenset(counts))
    return out


def search(text: str, model: Plausibility) -> Search:
    """The cheapest text that readings of UTF-8 and unescapings reach from text: best first by the cost of the text and of the steps to it, each state once.

    Dearer texts are opened too, until a sound text is cheaper than all that wait. Every step makes a text shorter, so that the search ends by itself. Unescaping alone is no
    repair. One-byte re-decodings of the text are weighed for the whole document, by mend.
    """
    start = model.cost(text)
    out, least, seen, opened = Search(text), start, {text}, 0
    queue: list[tuple[float, int, float, str]] = [(start, 0, 0.0, text)]
    while queue:
        if opened >= STATES:
            out.whole = False
            break
        total, _, spent, state = heapq.heappop(queue)
        if total > least and out.found and not model.odd(out.text):
            break  # the best is sound, and all that is left is dearer
        opened += 1
        for new, checked in neighbours(state):
            if new in seen:
                continue
            seen.add(new)
            path = spent + (CHECKED + CHECKED_EACH * min(altered(state, new), 10) if checked else UNESCAPE)
            total = model.cost(new) + path
            if total < least and checked and not CONTROL.search(new.translate({ord(c): None for c in set(text)})):
                out.text, out.found, least = new, True, total
            heapq.heappush(queue, (total, len(seen), path, new))
    out.least = least
    return out


def restore(text: str, model: Plausibility) -> str:
    """The text that search finds."""
    return search(text, model).text


def explore(text: str, model: Plausibility) -> Search:
    """Everything that is known of one stretch."""
    found = Search(text)
    if ESCAPE.search(text) or model.odd(text):
        found = search(text, model)
        if not text.isascii():
            found.loose = loose_steps(text, found.least, model)
    return found


def mend(text: str, model: Plausibility) -> tuple[str, bool, bool]:
    """The text with its misread stretches restored, whether characters stay lost, and whether every search came to its end.

    One-byte re-decodings compete for the document: the gains that a pair of codecs has in all stretches must pay for it once, and
    there must be marks of ill-written text that it takes away, several characters that it explains, or places that the samples know.
    """
    out: list[str | Search] = []
    for m in STRETCH.finditer(text):
        s = m.group()
        if s.isascii() and not ESCAPE.search(s):
            out.append(s)
            continue
        found = model.known.get(s)
        if found is None:
            if len(model.known) > 20_000:
                model.known.clear()
            found = model.known[s] = explore(s, model)
        out.append(found)
    whole = all(x.whole for x in out if isinstance(x, Search))
    left = {i: x.loose for i, x in enumerate(out) if isinstance(x, Search) and x.loose}
    while left:
        of: dict[tuple[str, str], list[Option]] = {}
        for options in left.values():
            for pair, option in options.items():
                of.setdefault(pair, []).append(option)
        valid = {}
        for pair, options in of.items():
            gain, marked = sum(o.gain for o in options), any(o.marks for o in options)
            if gain >= (LOOSE if marked else UNMARKED) and (marked or len(frozenset().union(*(o.changed for o in options))) > 1 or all(o.attested for o in options)):
                valid[pair] = gain
        if not valid:
            break
        best = max(valid, key=lambda pair: (valid[pair], pair))
        for i in [i for i, options in left.items() if best in options]:
            out[i] = left.pop(i)[best].text
    fixed = "".join(x if isinstance(x, str) else x.text for x in out)
    return fixed, bool(LOST.search(fixed)), whole


def repair(text: str, model: Plausibility) -> tuple[str, bool]:
    """The text with its misread stretches restored, and whether characters stay lost."""
    return mend(text, model)[:2]


def repairs(batches: Iterator[pd.DataFrame], samples: list[str]) -> Iterator[pd.DataFrame]:
    model = Plausibility(samples)
    for batch in batches:
        rows = []
        for key, text in zip(batch["id"], batch["text"], strict=True):
            fixed, lost, whole = mend(text, model)
            if fixed != text or lost or not whole:
                rows.append((key, fixed, lost, fixed != text or lost, whole))
        yield pd.DataFrame(rows, columns=["id", "restored", "lost", "misread", "searched"])


def restore_encodings(texts: DataFrame, key: str, text: str, samples: DataFrame) -> DataFrame:
    """(id, restored, lost, misread, searched) of the texts of which a character was misread: the text as far as it can be had, and whether characters stay lost.

    Every text outside ASCII or with escapes is searched whole, stretch by stretch. samples(text) is a fixed table of clean texts, from
    which the plausibility of characters is counted. Null, empty and sound texts have no row; HTML entities and rare characters are
    sound. A text with a stretch of more than STATES states has a row with searched = false, misread or not.
    """
    clean = [r[0] for r in samples.select("text").where("text is not null").collect()]
    rows = texts.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").rlike(r"[^\x00-\x7f]|&#?\w{2,8};|\\[ux][0-9A-Fa-f]{2}"))
    kind = dict(rows.dtypes)["id"]
    return widened(rows).mapInPandas(lambda batches: repairs(batches, clean), f"id {kind}, restored string, lost boolean, misread boolean, searched boolean").distinct()

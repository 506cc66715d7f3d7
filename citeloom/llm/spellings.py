"""Names of people and organisations taken apart: folded tokens, titles and particles aside, initials, short forms."""

from __future__ import annotations

import re
import unicodedata

# Words that are no part of a name, particles, and words of organisations with their abbreviations.
TITLES = frozenset("dr prof professor mr mrs ms sir phd md msc jr sr".split())
PARTICLES = frozenset("van der den de dos das do da del della di du la le ter ten von zu zum bin ibn al el af av".split())
ORGANISATION = {
    "consortium": "consort consortium", "collaboration": "collab collaboration", "network": "netw network", "group": "grp group", "investigators": "inv investigators", "society": "soc society", "committee": "comm committee",
    "institute": "inst institute", "university": "univ university", "hospital": "hosp hospital", "centre": "ctr center centre", "association": "assoc association", "foundation": "found foundation", "laboratory": "lab laboratory", "department": "dept department",
}
ORGANISATION_WORDS = {short: full for full, shorts in ORGANISATION.items() for short in shorts.split()}
WEAK_WORDS = frozenset("the of for and study trial research res unit team on in".split())
# Given names and their short forms.
SHORT_FORMS = {
    "alexander": "alex sasha sandy", "anastasia": "nastya stacy", "archibald": "archie", "bartholomew": "bart barty", "chukwuemeka": "emeka", "cornelius": "kees neil", "dolores": "lola", "elizabeth": "beth liz lizzie betty eliza lisa", "esperanza": "espe",
    "francisco": "paco pancho", "frederick": "fred freddie", "giuseppe": "beppe peppe", "henrietta": "hetty etta", "ingeborg": "inge", "jacqueline": "jackie", "johannes": "hannes hans", "katarzyna": "kasia", "leopold": "poldi leo", "lorenzo": "renzo",
    "margarethe": "greta grete", "matthias": "matze matz", "nikolai": "kolya", "oluwaseun": "seun", "ottoline": "otti", "patricia": "trish pat patty", "philippa": "pippa", "robert": "bob rob bobby robbie", "rosalind": "ros roz", "sebastiana": "bastiana",
    "theodora": "dora", "timothea": "thea", "umberto": "berto", "ursula": "uschi", "vladislav": "vlad", "wilhelmina": "mina willa", "william": "bill will billy liam", "ximena": "mena", "yevgenia": "zhenya", "zbigniew": "zbyszek",
    "michael": "mike mick", "richard": "dick rick", "james": "jim jimmy", "thomas": "tom", "edward": "ed ted", "margaret": "peggy maggie meg", "katherine": "kate kathy katie", "christopher": "chris", "joseph": "joe", "samuel": "sam", "daniel": "dan", "benjamin": "ben", "charles": "charlie chuck", "susan": "sue", "andrew": "andy drew", "anthony": "tony", "david": "dave", "hyacinth": "hya", "kwabena": "kobby", "quentin": "quent",
}
FULL_FORM = {short: full for full, shorts in SHORT_FORMS.items() for short in shorts.split()} | {full: full for full in SHORT_FORMS}
LETTERS = str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "‐": "-", "‑": "-", "–": "-", "’": "'", "þ": "th", "ð": "d"})
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")


def fold(text: str) -> str:
    """Marks off the letters and special letters spelled out; case kept."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.translate(LETTERS)) if not unicodedata.combining(c))


def tokens(name: str) -> tuple[list[str], list[str], bool]:
    """(tokens, second parts of hyphenated words, is an organisation) of a name: given names first where a comma or nothing says otherwise.

    Titles, particles, brackets and 'et al.' are left out; initials that are run together are parted.
    """
    text = re.sub(r"\([^)]*\)|\bet\s+al\b\.?", " ", fold(name))
    shouting = text.upper() == text and sum(c.isalpha() for c in text) > 5
    head, comma, tail = text.partition(",")
    ordered = f"{tail} {head}" if comma else text
    # of a short name in capitals with one word of more than a letter, as 'WU J', that word is no run of initials
    lone = text.upper() == text and sum(len(w) > 1 for w in WORD.findall(text)) == 1
    out, joined = [], []
    for m in WORD.finditer(ordered):
        raw = m.group().replace("'", "")
        low = raw.lower()
        if low in TITLES and len(raw) > 1 and (len(low) > 2 or ordered[m.end() : m.end() + 1] == "." or not raw.isupper()):
            continue
        if low in PARTICLES and not (raw.isupper() and not shouting):
            continue
        given = bool(comma) and m.start() < len(tail)
        if raw.isupper() and not (lone or (comma and not given)) and 1 < len(raw) <= (3 if not shouting else 2 if given else 0):
            out += list(low)
            continue
        if m.start() and ordered[m.start() - 1] == "-" and out and len(out[-1]) > 1:
            joined.append(low)
        out.append(low)
    organisation = any(t in ORGANISATION_WORDS for t in out)
    return out, joined, organisation


def name_roles(name: str, parts: list[str], joined: list[str]) -> tuple[list[str], list[str]]:
    """(tokens that stand as a surname, tokens that stand as a given name) in this spelling, as far as commas, initials or the order show it."""
    head, comma, _ = fold(name).partition(",")
    if comma:
        surnames = [t for t in tokens(f"{head},")[0] if t in parts]
        return surnames, [t for t in parts if len(t) > 1 and t not in surnames]
    words = [t for t in parts if len(t) > 1 and t not in joined]
    if len(words) == 1:
        return (words, []) if len(parts) > 1 else ([], [])
    last = max((i for i, t in enumerate(parts) if len(t) == 1), default=None)
    if last is None or not words:
        return [], words[:1]
    after = [t for t in words if parts.index(t) > last]
    return after, [t for t in words if t not in after] if after else []


def given_names(parts: list[str], joined: list[str], core: str) -> tuple[str, str, str]:
    """(first initial, first given name in full or '', second initial) of a name whose rare token is core; short forms as their full names."""
    at = parts.index(core) if core in parts else len(parts)
    before = [t for t in parts[:at] if t not in joined]
    after = [t for t in parts[at + 1 :] if t not in joined]
    rest = before or after
    if not rest:
        return "", "", ""
    known = next((i for i, t in enumerate(rest) if t in FULL_FORM), None)
    if known and not before:
        rest = rest[known:]
    first = FULL_FORM.get(rest[0], rest[0])
    return first[0], first if len(first) > 1 else "", rest[1][0] if len(rest) > 1 else ""


def institution_key(name: str | None) -> str:
    """An institution without the words of its kind: the same however it is written."""
    if not name:
        return ""
    return " ".join(sorted(t for t in (m.group().lower() for m in WORD.finditer(fold(name))) if t not in ORGANISATION_WORDS and t not in WEAK_WORDS))

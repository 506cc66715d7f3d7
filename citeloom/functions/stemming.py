"""The English (Porter2) stemmer, as published; applied to distinct words only."""

from __future__ import annotations

import re

# Fixed values of the published algorithm.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", **{w: w for w in "sky news howe atlas cosmos bias andes".split()}}
KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = {"ational": "ate", "ization": "ize", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble"}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]
VOWEL = "[aeiouy]"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def regions(word: str) -> tuple[int, int]:
    m = re.match(r"gener|commun|arsen", word)
    first = m.end() if m else (m.end() if (m := re.search(r"[aeiouy][^aeiouy]", word)) else len(word))
    m = re.search(r"[aeiouy][^aeiouy]", word[first:])
    return first, first + m.end() if m else len(word)


def short(word: str, r1: int) -> bool:
    return r1 >= len(word) and bool(re.search(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$", word))


def stem(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) <= 2:
        return word
    word = word.lstrip("'")
    if word in SPECIAL:
        return SPECIAL[word]
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    r1, r2 = regions(word)
    word = re.sub(r"'s'$|'s$|'$", "", word)
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(VOWEL, word[:-2]):
        word = word[:-1]
    if word in KEPT:
        return word
    if m := re.search(r"eedly$|eed$", word):
        if m.start() >= r1:
            word = word[: m.start()] + "ee"
    elif (m := re.search(r"(?:ingly|edly|ing|ed)$", word)) and re.search(VOWEL, word[: m.start()]):
        word = word[: m.start()]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif short(word, r1):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    for suffix in sorted(STEP2, key=len, reverse=True):
        if word.endswith(suffix):
            if len(word) - len(suffix) >= r1:
                word = word[: -len(suffix)] + STEP2[suffix]
            break
    else:
        if word.endswith("ogi") and len(word) - 3 >= r1 and word[-4:-3] == "l":
            word = word[:-1]
        elif word.endswith("li") and len(word) - 2 >= r1 and word[-3:-2] in tuple("cdeghkmnrt"):
            word = word[:-2]
    for suffix in sorted([*STEP3, "ative"], key=len, reverse=True):
        if word.endswith(suffix):
            at = len(word) - len(suffix)
            if suffix == "ative":
                word = word[:at] if at >= r2 else word
            elif at >= r1:
                word = word[:at] + STEP3[suffix]
            break
    for suffix in STEP4:
        if word.endswith(suffix):
            if len(word) - len(suffix) >= r2:
                word = word[: -len(suffix)]
            break
    else:
        if word.endswith("ion") and len(word) - 3 >= r2 and word[-4:-3] in ("s", "t"):
            word = word[:-3]
    if word.endswith("e") and (len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not short(word[:-1], r1))):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()

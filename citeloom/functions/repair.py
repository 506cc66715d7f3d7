"""Text that came out of other programs put right: JSON that is nearly valid, boolean queries that are too long, affiliations in one line."""

from __future__ import annotations

import json
import re

# Names of countries at the end of an affiliation, and states that stand for one.
COUNTRIES = {"usa": "United States", "u.s.a.": "United States", "united states": "United States", "united states of america": "United States", "uk": "United Kingdom", "u.k.": "United Kingdom", "united kingdom": "United Kingdom", "england": "United Kingdom", "scotland": "United Kingdom", "wales": "United Kingdom", "peoples r china": "China", "p.r. china": "China", "pr china": "China", "china": "China", "germany": "Germany", "france": "France", "spain": "Spain", "italy": "Italy", "japan": "Japan", "brazil": "Brazil", "turkey": "Turkey", "turkiye": "Turkey", "russia": "Russia", "poland": "Poland", "portugal": "Portugal", "sweden": "Sweden", "netherlands": "Netherlands", "the netherlands": "Netherlands", "canada": "Canada", "australia": "Australia", "india": "India", "south korea": "South Korea", "republic of korea": "South Korea", "switzerland": "Switzerland", "austria": "Austria", "belgium": "Belgium", "denmark": "Denmark", "norway": "Norway", "finland": "Finland", "ireland": "Ireland", "greece": "Greece", "mexico": "Mexico", "argentina": "Argentina", "chile": "Chile", "egypt": "Egypt", "iran": "Iran", "israel": "Israel", "saudi arabia": "Saudi Arabia", "south africa": "South Africa", "new zealand": "New Zealand", "singapore": "Singapore", "taiwan": "Taiwan"}
STATES = frozenset("AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split())
PLACE = re.compile(r"univ|institut|college|school of|hospital|academy|polytechn|centre|center|laborator", re.I)
PART = re.compile(r"\b(dept|department|division|section|faculty|unit)\b", re.I)


def affiliation(text: str | None) -> tuple[str | None, str | None, str | None]:
    """(institution, city, country) of an affiliation: the country from the right, then the city, the institution the segment that names one best."""
    parts = [p.strip(" .") for p in (text or "").split(",") if p.strip(" .")]
    if not parts:
        return None, None, None
    country = COUNTRIES.get(parts[-1].lower())
    m = re.fullmatch(r"([A-Z]{2})(?:\s+\d{5}(?:-\d{4})?)?(?:\s+USA)?", parts[-1])
    if country is None and m and m.group(1) in STATES:
        country = "United States"
    if country:
        parts = parts[:-1]
        if country == "United States" and parts and re.fullmatch(r"([A-Z]{2})(?:\s+\d{5}(?:-\d{4})?)?", parts[-1]) and parts[-1][:2] in STATES:
            parts = parts[:-1]
    score = lambda p: 100 * bool(PLACE.search(p)) - 50 * bool(PART.search(p)) - 10 * (len(p) <= 3)
    institution = max(parts, key=score, default=None)
    rest = parts[parts.index(institution) + 1 :] if institution else []
    city = re.sub(r"\b[A-Z]{0,2}-?\d{3,}[A-Z]*\b", "", rest[-1]).strip() if rest else None
    return institution, city or None, country


def truncate_query(query: str, most: int = 1500) -> str:
    """At most most bytes of a boolean query: cut at a blank, trailing operators off, open quotes and brackets closed."""
    if len(query.encode()) <= most:
        return query
    text = query.encode()[: most - 8].decode("utf-8", "ignore")
    text = text.rsplit(" ", 1)[0]
    if text.count('"') % 2:
        text = text[: text.rindex('"')]
    while m := re.search(r"[\s(]+$|\s(?:AND|OR|NOT)$|^(?:AND|OR|NOT)$", text):
        text = text[: m.start()]
    while text.count("(") - text.count(")") > 0 and len(text) + text.count("(") - text.count(")") > most:
        text = text.rsplit(" ", 1)[0]
    return text + ")" * max(0, text.count("(") - text.count(")"))


def repair_json(text: str):
    """The value of JSON inside fences or prose, with raw control characters, or cut off at the end; None where there is none."""
    m = re.search(r"```(?:json)?\s*(.*?)(?:```|$)", text, re.S)
    body = m.group(1) if m else text
    start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    out, stack, quoted, escaped, ends = [], [], False, False, []
    for c in body[start:]:
        if quoted:
            if c in "\n\r\t" and not escaped:
                c = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}[c]
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]":
            if not stack or stack.pop() != c:
                return None
        out.append(c)
        if not quoted and c in "}]," and stack:
            ends.append((len(out) - (c == ","), "".join(reversed(stack))))
        if not stack and not quoted and c in "}]":
            break
    whole = "".join(out)
    for candidate in [whole, *("".join(out[:n]) + close for n, close in reversed(ends))]:
        try:
            return json.loads(re.sub(r",(\s*[}\]])", r"\1", candidate))
        except ValueError:
            continue
    return None

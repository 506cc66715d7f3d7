"""Documents taken apart: sections, captions, tables and chunks of whole sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a chunk aims at, has at least at the end, and has at most.
TARGET, LEAST, MOST = 512, 100, 1200
# Words of headings, by kind of section, in several languages.
HEADINGS = {
    "Abstract": "abstract summary resumen résumé zusammenfassung riassunto resumo",
    "Introduction": "introduction background introducción introducción einleitung introduzione introdução giriş",
    "Methods": "methods method methodology materials métodos méthodes methoden metodi yöntem",
    "Results": "results findings resultados résultats ergebnisse risultati bulgular",
    "Discussion": "discussion discusión diskussion discussione discussão tartışma",
    "Conclusion": "conclusion conclusions conclusión fazit conclusione conclusão sonuç",
    "References": "references bibliography referencias références literatur riferimenti referências kaynaklar",
}
KIND = {word: kind for kind, words in HEADINGS.items() for word in words.split()}
HEADING = re.compile(r"^(?:#{1,6}\s+(?P<md>.+)|(?:\d+(?:\.\d+)*\.?\s+)?(?P<plain>[^\W\d_][^\n.!?]{2,60}))$")
CAPTION = re.compile(r"^(?P<kind>Figure|Fig\.?|Table|Tab\.?)\s+(?P<number>\d+)\s*[.:–-]\s*(?P<text>.+)$", re.I)


def sections(text: str) -> list[tuple[str, str | None, str]]:
    """(kind, heading, body) in order: a section begins at a heading line; a line of pipes is a table, a caption line a figure or table."""
    out: list[tuple[str, str | None, list[str]]] = [("Text", None, [])]
    for line in re.split(r"\r\n|\r|\n", text):
        stripped = line.strip()
        m = HEADING.match(stripped) if stripped else None
        name = (m.group("md") or m.group("plain")).strip() if m else ""
        kind = KIND.get(name.lower().rstrip(":").split(" ")[0]) if name else None
        if m and (m.group("md") or (kind and len(name.split()) <= 3)):
            out.append((kind or "Heading", name, []))
        elif "|" in stripped and stripped.count("|") > 1:
            if out[-1][0] != "Table":
                out.append(("Table", None, []))
            out[-1][2].append(line)
        else:
            if out[-1][0] == "Table":
                before = next((s for s in reversed(out[:-1]) if s[0] != "Table"), ("Text", None, []))
                out.append((before[0], before[1], []))
            out[-1][2].append(line)
    return [(k, h, "\n".join(b).strip()) for k, h, b in out if "\n".join(b).strip()]


def sentences(text: str) -> list[str]:
    """Pieces that end behind . ! or ? (and closing marks) before a blank, or at a line end."""
    return [s for s in (p.strip() for p in re.findall(r"[^\n]*?(?:[.!?]+[\"')\]]*(?=\s|$)|\n|$)", text)) if s]


def pack(body: str, target: int) -> list[str]:
    """Whole sentences put together up to target words; a sentence above MOST words is sliced."""
    if len(body.split()) <= target:
        return [body]
    out: list[str] = []
    current: list[str] = []
    count = 0
    for s in sentences(body):
        words = s.split()
        if len(words) > MOST:
            if current:
                out.append(" ".join(current))
            out += [" ".join(words[i : i + target]) for i in range(0, len(words), target)]
            current, count = [], 0
            continue
        if current and count + len(words) > target:
            out.append(" ".join(current))
            current, count = [], 0
        current.append(s)
        count += len(words)
    return [*out, " ".join(current)] if current else out


def chunks(text: str, target: int = TARGET) -> list[tuple[str | None, str]]:
    """(section, text) of a document's chunks; references are left out, tables whole, a last chunk under LEAST words joins the one before."""
    out: list[tuple[str | None, str]] = []
    for kind, heading, body in sections(text):
        if kind == "References":
            continue
        label = heading if kind == "Heading" else None if kind == "Text" else kind
        out += [(label, piece) for piece in ([body] if kind == "Table" else pack(body, max(1, min(target, MOST)))) if piece.split()]
    if len(out) > 1:
        last, before = len(out[-1][1].split()), len(out[-2][1].split())
        if last < LEAST and last + before <= MOST:
            out[-2:] = [(out[-2][0], f"{out[-2][1]} {out[-1][1]}")]
    return out


def captions(text: str) -> list[tuple[str, int, str]]:
    """(kind, number, text) of figure and table captions; a caption goes on to the next blank line, caption or heading."""
    out, lines = [], text.splitlines()
    for i, line in enumerate(lines):
        m = CAPTION.match(line.strip())
        if m:
            rest = []
            for more in lines[i + 1 :]:
                if not more.strip() or CAPTION.match(more.strip()) or more.startswith("#"):
                    break
                rest.append(more.strip())
            out.append(("Figure" if m.group("kind").lower().startswith("f") else "Table", int(m.group("number")), " ".join([m.group("text").strip(), *rest])))
    return out


def chunk_documents(rows: DataFrame, key: str, text: str, target: int = TARGET) -> DataFrame:
    """(id, chunk_index, section, chunk, word_count) of each document; null and blank texts have none."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, i, s, c, len(c.split())) for k, t in zip(batch["id"], batch["text"], strict=True) for i, (s, c) in enumerate(chunks(t, target))]
            yield pd.DataFrame(out, columns=["id", "chunk_index", "section", "chunk", "word_count"])

    kept = rows.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null").distinct()
    return kept.mapInPandas(work, f"id {dict(kept.dtypes)['id']}, chunk_index int, section string, chunk string, word_count int")


def caption_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(id, kind, number, caption) of each document."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(k, *c) for k, t in zip(batch["id"], batch["text"], strict=True) for c in captions(t)], columns=["id", "kind", "number", "caption"])

    kept = rows.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null and text is not null").distinct()
    return kept.mapInPandas(work, f"id {dict(kept.dtypes)['id']}, kind string, number int, caption string")

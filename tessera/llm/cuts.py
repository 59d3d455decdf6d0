"""Problem 2: oversized items into pieces under a limit, cut at natural boundaries, with overlap.

A recursive hierarchy of separators: a text over the limit is split into sections (blank
lines), a section over it into lines, a line into sentences, a sentence into words, a word
into characters. The parts are packed greedily up to the limit; each piece after the first
opens with the trailing words of the one before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1_600, 200
LEVELS = ("section", "line", "sentence", "word", "character")

# Abbreviations whose dot ends no sentence, in English, German, French and Spanish, without the last dot.
ABBREVIATIONS = frozenset(
    """
    no nos nr nrs approx incl excl i.e e.g cf vs mr mrs ms dr prof st jr sr inc corp ltd co bros dept est fig figs sec vol ed eds pp p ca al viz resp
    jan feb mar apr jun jul aug sep sept oct nov dec u.s u.k u.n e.u a.m p.m ph.d gen gov sen rep rev hon capt col lt sgt art ch para
    z.b d.h u.a u.ä bzw usw ggf evtl inkl exkl zzgl abzgl ca mio mrd tsd str hr fr ing dipl abs s.o s.u v.a z.t o.ä vgl sog max min
    p.ex ex env m mm mme mlle n° réf chap art av apr janv févr avr juil déc
    p.ej ej aprox sr sra srta dr dra núm pág págs ud uds ee.uu cía dpto tel avda ref
    """.split()
)
_END = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s|$)")
_BEFORE = re.compile(r"[\w°.]+$")


def _ends_sentence(text: str, m: re.Match) -> bool:
    mark = m.group()
    if mark[0] != "." or mark.startswith(".."):
        return True
    before = _BEFORE.search(text, max(0, m.start() - 24), m.start())
    if not before:
        return True
    word = before.group()
    rest = text[m.end() : m.end() + 80].lstrip()
    if word.lower() in ABBREVIATIONS:
        # a unit of a figure that closes the text, such as "12 min.", still ends it
        return not rest
    if len(word) == 1 and word.isalpha() and word.isupper():
        i = before.start()
        while i and text[i - 1].isspace():
            i -= 1
        return not i or text[i - 1].isdigit() or text[i - 1] == "°" or not rest  # an initial, unless it is the unit of a figure
    return True


def _split(text: str, a: int, b: int, level: str) -> list[tuple[int, int]]:
    """Consecutive spans that cover a..b; blanks go with the part before them."""
    if level == "section":
        at = [m.end() for m in re.compile(r"\n[ \t]*(?:\n\s*)+|\f\s*").finditer(text, a, b)]
    elif level == "line":
        at = [m.end() for m in re.compile(r"\n").finditer(text, a, b)]
    elif level == "sentence":
        at = []
        for m in _END.finditer(text, a, b):
            if _ends_sentence(text, m):
                end = m.end()
                while end < b and text[end].isspace():
                    end += 1
                at.append(end)
    elif level == "word":
        at = [m.end() for m in re.compile(r"\s+").finditer(text, a, b)]
    else:
        at = list(range(a + 1, b))
    edges = [a, *(x for x in dict.fromkeys(at) if a < x < b), b]
    return list(zip(edges, edges[1:]))


def _size(text: str, a: int, b: int) -> int:
    return len(text[a:b].rstrip())


def atoms(text: str, limit: int) -> list[tuple[int, int, str | None]]:
    """(start, end, level of the cut before it) of consecutive parts of at most ``limit`` characters; the first has no cut before it."""

    def down(a: int, b: int, depth: int, before: str | None) -> list[tuple[int, int, str | None]]:
        if _size(text, a, b) <= limit:
            return [(a, b, before)]
        last = depth == len(LEVELS) - 1
        parts = [(x, min(b, x + limit)) for x in range(a, b, limit)] if last else _split(text, a, b, LEVELS[depth])
        levels = [before] + [LEVELS[depth]] * (len(parts) - 1)
        return [s for (x, y), level in zip(parts, levels) for s in ([(x, y, level)] if last else down(x, y, depth + 1, level))]

    return down(0, len(text), 0, None)


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str | None]]:
    """(start, end, where its own part begins, level of the cut there) of each piece of ``text``.

    The parts from ``own`` to ``end`` follow each other and cover the text; start..own repeats
    whole trailing words of the piece before, as many as fit into ``overlap`` and the limit
    (or exactly ``overlap`` characters where no word begins in them).
    """
    if overlap >= limit:
        raise ValueError("overlap must be under the limit")
    out: list[tuple[int, int, int, str | None]] = []
    start = own = end = 0
    level = None
    for a, b, before in atoms(text, limit):
        if b > own and _size(text, start, b) <= limit:
            end = b
            continue
        if end > own:
            out.append((start, end, own, level))
        room = min(overlap, limit - _size(text, a, b)) if out else 0
        own, end, level = a, b, before
        start = a
        if room > 0:
            low = max(a - room, out[-1][0] + 1)
            words = [m.start() for m in re.compile(r"(?<!\S)\S").finditer(text, low, a)]
            if low and words and words[0] == low and not text[low - 1].isspace():
                words = words[1:]
            start = words[0] if words else low if not re.search(r"\s", text[low:a]) else a
    if end > own:
        out.append((start, end, own, level))
    return out


def cut_kind(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> str:
    """'inside' if a piece had to begin inside a sentence that no line break divides, as one over the limit forces it to, else 'boundary'."""
    return "inside" if any(level in ("word", "character") for *_, level in pieces(text, limit, overlap)) else "boundary"


def _oversized(passages: DataFrame, limit: int) -> DataFrame:
    return passages.where(F.length(F.col("text").cast("string")) > limit)


def cut_kinds(passages: DataFrame, *, limit: int = LIMIT) -> DataFrame:
    """(passage_id, cut_kind) of each passage over ``limit`` characters, from where its pieces begin.

    Null, empty and short texts give no row; repeated rows count once; an empty table gives an
    empty result; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"passage_id": pdf["passage_id"], "cut_kind": [cut_kind(t, limit) for t in pdf["text"]]})

    rows = _oversized(passages, limit).select(F.col("passage_id").cast("long").alias("passage_id"), F.col("text").cast("string").alias("text"))
    return rows.dropDuplicates(["passage_id"]).mapInPandas(run, "passage_id long, cut_kind string")


def places(text: str, raw: str | None) -> list[int] | None:
    """For each character of ``text`` its place in ``raw``, the stretch of the page it was taken from; -1 for blanks.

    One walk over both: the text's characters follow each other in ``raw``, blanks matching any
    run of blanks. None without ``raw`` or where it differs.
    """
    if raw is None:
        return None
    out, i = [], 0
    for c in text:
        if c.isspace():
            out.append(-1)
            continue
        while i < len(raw) and raw[i] != c:
            if not raw[i].isspace():
                return None
            i += 1
        if i == len(raw):
            return None
        out.append(i)
        i += 1
    return out


def place(at: list[int] | None, base: int, a: int, b: int) -> tuple[int, int]:
    """Offsets in the page of characters a..b of a text whose ``places`` count from ``base``; text offsets added to it where they aren't known."""
    if at is None:
        return base + a, base + b
    while a < b and at[a] < 0:
        a += 1
    while b > a and at[b - 1] < 0:
        b -= 1
    return (base + at[a], base + at[b - 1] + 1) if a < b else (base + a, base + b)


def cut_pieces(passages: DataFrame, documents: DataFrame | None = None, *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(passage_id, document_id, piece_no, page, char_start, char_end, own_start, speaker, text): the pieces of each passage over ``limit``.

    Pieces are numbered from 1; ``text`` has at most ``limit`` characters, trailing blanks not
    counted and cut off. ``own_start`` is where the piece's own part begins in ``text``; before
    it stands the overlap. char_start and char_end are offsets in the page, exact against the
    raw text where ``documents`` is given; null if the passage's are. Edge cases as in cut_kinds.
    """
    rows = _oversized(passages, limit).select(
        F.col("passage_id").cast("long").alias("passage_id"), F.col("document_id").cast("long").alias("document_id"), F.col("page").cast("int").alias("page"), F.col("char_start").cast("int").alias("char_start"), F.col("char_end").cast("int").alias("char_end"), F.col("speaker").cast("string").alias("speaker"), F.col("text").cast("string").alias("text")
    ).dropDuplicates(["passage_id"])
    if documents is not None:
        pages = documents.select(F.col("doc_id").cast("long").alias("document_id"), F.split(F.col("text").cast("string"), "\f", -1).alias("pages"))
        wanted = pages.join(rows.select("document_id").distinct(), "document_id", "left_semi").dropDuplicates(["document_id"])
        raw = F.when(F.col("char_end") > F.col("char_start"), F.substring(F.try_element_at("pages", F.col("page")), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")))
        rows = rows.join(wanted, "document_id", "left").withColumn("raw", raw).drop("pages")
    else:
        rows = rows.withColumn("raw", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["passage_id", "document_id", "piece_no", "page", "char_start", "char_end", "own_start", "speaker", "text"]
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                known = not pd.isna(r.char_start)
                at = places(r.text, r.raw) if known and isinstance(r.raw, str) else None
                for i, (a, b, own, _) in enumerate(pieces(r.text, limit, overlap), 1):
                    said = r.text[a:b].rstrip()
                    s, e = place(at, int(r.char_start), a, a + len(said)) if known else (None, None)
                    out.append((r.passage_id, None if pd.isna(r.document_id) else int(r.document_id), i, None if pd.isna(r.page) else int(r.page), s, e, own - a, r.speaker, said))
            yield pd.DataFrame(out, columns=names).astype({"document_id": "Int64", "page": "Int32", "char_start": "Int32", "char_end": "Int32"})

    return rows.mapInPandas(run, "passage_id long, document_id long, piece_no int, page int, char_start int, char_end int, own_start int, speaker string, text string")

"""Files into documents and passages: text of HTML, DOCX, PDF and plain files, pages into passages with exact offsets."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx

# Elements that stand on lines of their own, hold no content, or are cells.
BLOCKS = frozenset("address article aside blockquote dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
NO_CONTENT = frozenset(("script", "style", "head", "noscript", "template", "ix:header", "xbrli:context"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CELLS = frozenset(("td", "th"))
#: Passages aim at so many tokens of four characters, and hold at most so many.
TARGET, MOST, PER_TOKEN = 250, 400, 4


class _Events(HTMLParser):
    """Markup as a list of (what, name or text, whether it hides its content)."""

    def __init__(self, markup: str) -> None:
        super().__init__(convert_charrefs=True)
        self.all: list[tuple[str, str, bool]] = []
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        styled = dict(attrs)
        unseen = tag in NO_CONTENT or "hidden" in styled or any(n == "style" and re.search(r"display\s*:\s*none", v or "", re.I) for n, v in attrs)
        self.all.append(("open", tag, unseen and tag not in VOID))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.all.append(("alone", tag, False))

    def handle_endtag(self, tag: str) -> None:
        self.all.append(("close", tag, False))

    def handle_data(self, data: str) -> None:
        self.all.append(("text", data, False))


#: What stands in the text for an element's begin or end.
GAPS = {("close", t): "\n\n" for t in BLOCKS} | {("open", t): "\n\n" for t in BLOCKS} | {("close", t): " | " for t in CELLS} | {("open", "br"): "\n", ("alone", "br"): "\n"}


def _end_of(events: list[tuple[str, str, bool]], i: int) -> int:
    """Where the element opened at i ends: elements of its name inside it are closed before."""
    name, inside = events[i][1], 0
    for j in range(i, len(events)):
        what, tag, _ = events[j]
        inside += (what == "open") - (what == "close") if what != "text" and tag == name else 0
        if not inside:
            return j
    return len(events)


def html_text(markup: str) -> str:
    """The visible text: a line per break, a blank line per block, cells divided by bars, none at a row's ends."""
    events, out, i = _Events(markup).all, [], 0
    while i < len(events):
        what, tag, hides = events[i]
        if hides:
            i = _end_of(events, i)
        else:
            out.append(tag if what == "text" else GAPS.get((what, tag), ""))
        i += 1
    lines = re.sub(r"[ \t\r\f\v\xa0]+", " ", "".join(out)).split("\n")
    tidy = (re.sub(r"^(?: ?\| ?)+|(?: ?\| ?)+$", "", line).strip() for line in lines)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(tidy)).strip()


def docx_text(content: bytes) -> str:
    """Paragraphs, then table rows with cells divided by bars, blocks divided by blank lines."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{w}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t")).strip()
    blocks = [said(p) for p in body.findall(f"{w}p")] + [" | ".join(said(c) for c in row.findall(f"{w}tc")) for row in body.iter(f"{w}tr")]
    return "\n\n".join(b for b in blocks if b)


def pdf_pages(content: bytes) -> list[str]:
    """The text of every page; needs the optional library pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("reading PDF needs pypdf, which is not installed") from e
    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]


def pages_of(path: str, content: bytes) -> list[str]:
    """The pages of a file by its suffix; raises ValueError for another kind."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("html", "htm"):
        return [html_text(content.decode("utf-8", "replace"))]
    if kind in ("txt", "md"):
        return content.decode("utf-8", "replace").split("\f")
    if kind == "docx":
        return [docx_text(content)]
    if kind == "pdf":
        return pdf_pages(content)
    raise ValueError(f"files of kind {kind} can't be read")


def extracted(files: DataFrame) -> DataFrame:
    """(path, title, pages, text_sha256, error) of a binaryFile frame; a file that can't be read has its error, not the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    out.append((path, pages_of(path, bytes(content)), None))
                except Exception as e:  # noqa: BLE001
                    out.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "pages", "error"])

    read = files.select("path", "content").mapInPandas(run, "path string, pages array<string>, error string")
    text, stem = F.array_join("pages", " "), F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return read.select("path", tx.title_of(F.lit(None).cast("string"), F.array_join("pages", "\n"), stem).alias("title"), "pages", F.when(F.length(tx.squeeze(text)) > 0, tx.sha256(tx.squeeze(text))).alias("text_sha256"), "error")


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """The extracted files of a folder, each text once (the first by path); unreadable ones are kept with their error."""
    got = extracted(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
    firsts = got.where("text_sha256 is not null").groupBy("text_sha256").agg(F.min(F.struct("path", "title", "pages")).alias("f")).select("f.path", "f.title", "f.pages", "text_sha256", F.lit(None).cast("string").alias("error"))
    return firsts.unionByName(got.where("text_sha256 is null"))


# Labels that are no names, headings that look like names, and how a word of a name is written.
ROLES = frozenset(("Operator", "Moderator", "Interviewer", "Analyst", "Expert", "Client", "Q", "A"))
NO_SPEAKERS = frozenset(("forward-looking statements", "safe harbor", "table of contents", "risk factors", "note", "source", "disclaimer"))
NAME_WORD = re.compile(r"[A-Z][a-zA-Z'\-]+")
#: Words of a name, at least and at most, and characters of a title behind it, at most.
NAME_WORDS, TITLE = (2, 4), 80


def speaker_label(line: str) -> tuple[str, int] | None:
    """(label, where the speech begins) of a line that opens with a speaker's role or name, perhaps with a title, and a colon."""
    label, colon, speech = line.partition(":")
    name, dash, title = (re.split(r"( [-–—] )", label, maxsplit=1) + ["", ""])[:3]
    words = name.split(" ")
    named = NAME_WORDS[0] <= len(words) <= NAME_WORDS[1] and all(map(NAME_WORD.fullmatch, words)) and (not dash or 0 < len(title) <= TITLE)
    if not colon or label.lower() in NO_SPEAKERS or not (label in ROLES or named):
        return None
    return label, len(line) - len(speech.lstrip())


def _tokens(n: int) -> int:
    return max(1, -(-n // PER_TOKEN))


class _Run:
    """Words joined by one blank, with the place of every character in the page."""

    def __init__(self, page: int, speaker: str | None, raw: str, spans: list[tuple[int, int]]) -> None:
        self.page, self.speaker = page, speaker
        self.text = " ".join(raw[a:b] for a, b in spans)
        self.at = [i for n, (a, b) in enumerate(spans) for i in ([spans[n - 1][1] - 1] if n else []) + list(range(a, b))]

    def absorb(self, other: _Run) -> bool:
        if (self.page, self.speaker) != (other.page, other.speaker) or _tokens(len(self.text) + 1 + len(other.text)) > TARGET:
            return False
        self.text += " " + other.text
        self.at += [self.at[-1], *other.at]
        return True


def _runs(page: int, raw: str, transcript: bool) -> Iterator[_Run]:
    """Paragraphs, or in a transcript the turns, of a page."""
    spans: list[tuple[int, int]] = []
    speaker = None
    for m in re.finditer(r"[^\n]*(?:\n|$)", raw) if transcript else re.finditer(r"(?:(?!\n[ \t]*\n)[\s\S])+", raw):
        a, b = m.span()
        line = m.group().strip()
        label = speaker_label(line) if transcript else None
        if label:
            if spans:
                yield _Run(page, speaker, raw, spans)
            spans, speaker = [], label[0]
            a += m.group().index(line) + label[1]
        spans += [(a + w.start(), a + w.end()) for w in re.finditer(r"\S+", raw[a:b])]
        if not transcript:
            if spans:
                yield _Run(page, None, raw, spans)
            spans = []
    if spans:
        yield _Run(page, speaker, raw, spans)


def _parts(text: str) -> Iterator[tuple[int, int]]:
    """Spans of at most MOST tokens: whole sentences as many as fit, a longer sentence at its last blank before the limit."""
    if _tokens(len(text)) <= MOST:
        yield 0, len(text)
        return
    most, start, end = MOST * PER_TOKEN, 0, 0
    bounds = [m.span() for m in re.finditer(r"(?<=[.!?])\s+", text)] + [(len(text), len(text))]
    at = 0
    for a, b in bounds:
        if end > start and _tokens(a - start) > MOST:
            yield from _hard(text, start, end, most)
            start = at
        end, at = a, b
    if end > start:
        yield from _hard(text, start, end, most)


def _hard(text: str, a: int, b: int, most: int) -> Iterator[tuple[int, int]]:
    while b - a > most:
        gap = text.rfind(" ", a, a + most)
        stop = gap if gap > a else a + most
        yield a, stop
        a = stop + (text[stop : stop + 1] == " ")
    if b > a:
        yield a, b


def passages_of(pages: list[str], transcript: bool = False) -> list[dict]:
    """Passages of a document: paragraphs or turns, short neighbours of one page and speaker merged, long ones cut, with exact page offsets."""
    merged: list[_Run] = []
    for number, raw in enumerate(pages, 1):
        for run in _runs(number, raw or "", transcript):
            if not merged or not merged[-1].absorb(run):
                merged.append(run)
    out = []
    for run in merged:
        for a, b in _parts(run.text):
            out.append({"seq": len(out), "page": run.page, "char_start": run.at[a], "char_end": run.at[b - 1] + 1, "speaker": run.speaker, "text": run.text[a:b]})
    return out


def split_passages(documents: DataFrame, *, transcripts: tuple[str, ...] = ("earnings_transcript", "expert_call")) -> DataFrame:
    """(document_id, seq, page, char_start, char_end, speaker, text, text_sha256): the passages of documents whose pages are divided by form feeds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["seq", "page", "char_start", "char_end", "speaker", "text"]
        for pdf in batches:
            rows = [(d, *(p[n] for n in names)) for d, t, call in zip(pdf["doc_id"], pdf["text"], pdf["call"]) for p in passages_of(t.split("\f"), bool(call))]
            yield pd.DataFrame(rows, columns=["document_id", *names])

    rows = documents.where("text is not null").select("doc_id", "text", F.coalesce(F.col("source_type").isin(*transcripts), F.lit(False)).alias("call"))
    out = rows.mapInPandas(run, "document_id long, seq int, page int, char_start int, char_end int, speaker string, text string")
    return out.withColumn("text_sha256", tx.sha256("text"))

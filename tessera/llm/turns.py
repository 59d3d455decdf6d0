"""Problem 1: raw call transcripts into clean, ordered speaker turns.

Labels, fillers and sound notes are matched with Aho-Corasick automata; context rules
decide what a match means (a label must open a line, a note must stand in brackets, an
ambiguous filler must be set off); matched intervals are subtracted from the text; windows
over the reading order join neighbouring segments of one participant into turns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Words and phrases of transcripts.
NOTES = (
    "applause", "audio cuts out", "audio gap", "background noise", "break", "break in audio", "cheering", "clears throat", "clearing throat", "cough", "coughing", "coughs", "cross talk",
    "crosstalk", "door closes", "door opens", "foreign language", "inaudible", "indiscernible", "laughing", "laughs", "laughter", "music", "no audio", "noise", "off mic", "overlapping",
    "overlapping speech", "overlapping speakers", "pause", "phone ringing", "phone rings", "ringing", "sigh", "sighs", "silence", "sneezes", "static", "technical difficulties",
    "technical difficulty", "typing", "unclear", "unintelligible", "video plays",
)
FILLERS = ("hm", "hmm", "hmmm", "erm", "mhm", "mm", "mm-hmm", "mmm", "uh", "uh-huh", "uhh", "uhm", "um", "umm")
#: Words that are fillers only if punctuation sets them off.
LOOSE_FILLERS = ("ah", "eh", "er", "i mean", "you know", "well you know")
UNKNOWN = ("unidentified", "unknown", "unnamed")
TITLE_SHORT = {"ceo": "chief executive officer", "cfo": "chief financial officer", "coo": "chief operating officer", "cto": "chief technology officer", "ir": "head of investor relations", "vp ir": "head of investor relations"}
ASKING, ANSWERING = ("interviewer", "analyst"), ("expert",)

_TIME = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
_TIMES = re.compile(rf"[\[(<{{]\s*{_TIME}\s*[\])>}}]|{_TIME}(?:\s*-->\s*{_TIME})?|-->")
_OPENING = re.compile(r"[ \t\xa0]*(?:>>+[ \t\xa0]*)?([^\n:]+(?:\d{1,2}:\d{2}[^\n:]{0,12})?)\s*:(?=\s|$)")
_NUMBERED = re.compile(r"(?:speaker|participant)[ _#-]*0*(\d{1,4})")
_WORD = re.compile(r"[^\W_]+")


def _automaton(phrases: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for p in phrases:
        a.add_word(p, p)
    a.make_automaton()
    return a


_kept: dict[str, ahocorasick.Automaton] = {}


def _notes() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    if not _kept:
        _kept["notes"], _kept["fillers"] = _automaton(NOTES), _automaton(FILLERS + LOOSE_FILLERS)
    return _kept["notes"], _kept["fillers"]


def _fold(text: str) -> str:
    """Lower case, character by character, so that offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def noise_spans(text: str) -> list[tuple[int, int]]:
    """Intervals of times, sound notes and fillers, merged and in order."""
    low, spans = _fold(text), [m.span() for m in _TIMES.finditer(text)]
    notes, fillers = _notes()
    for last, phrase in notes.iter(low):
        a, b = last - len(phrase) + 1, last + 1
        i, j = a, b
        while i and low[i - 1] in " \t":
            i -= 1
        while j < len(low) and low[j] in " \t":
            j += 1
        if i and j < len(low) and low[i - 1] + low[j] in ("[]", "()", "{}", "<>", "**"):
            spans.append((i - 1, j + 1))
    words = []
    for last, phrase in fillers.iter(low):
        a, b = last - len(phrase) + 1, last + 1
        if (a and (low[a - 1].isalnum() or low[a - 1] in "-'’")) or (b < len(low) and (low[b].isalnum() or (low[b] in "-'’" and b + 1 < len(low) and low[b + 1].isalnum()))):
            continue
        words.append((a, b, phrase))
    taken = sorted(spans)
    for a, b, phrase in words:
        if phrase in LOOSE_FILLERS:
            after, before = low[b:].lstrip(" \t")[:1], low[:a].rstrip(" \t")[-1:]
            set_off = after in (",", ".", "…", "") or (before in (",", "…") and after in (",", ".", "…", ""))
            if not set_off or (phrase in ("er", "eh", "ah") and after == "" and before not in ("", ",", ".", "…", "]", ")")):
                continue
        end = b
        while end < len(low) and low[end] in " \t":
            end += 1
        taken.append((a, end + 1 if end < len(low) and low[end] == "," else b))
    taken.sort()
    merged: list[tuple[int, int]] = []
    for a, b in taken:
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def clean(text: str) -> str:
    """``text`` without times, sound notes and fillers; blanks reduced, line breaks kept; '' if no word is left."""
    parts, at = [], 0
    for a, b in noise_spans(text):
        parts.append(text[at:a])
        at = b
    left = " ".join([*parts, text[at:]]) if parts else text
    left = "\n".join(s for s in (re.sub(r"[ \t\xa0]+", " ", line).strip() for line in left.split("\n")) if s)
    left = re.sub(r" +([,.;:?!])", r"\1", left)
    return left if _WORD.search(left) else ""


def _near(a: str, b: str, most: int) -> int:
    """Edits between two words, a swap of neighbours counting as one; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        before, row = row, new
    return min(row[-1], most + 1)


class Cast:
    """The participants of one call and the automaton of their names, titles and firms."""

    def __init__(self, people: list[tuple[int, str | None, str | None, str | None]]) -> None:
        self.numbers = {n for n, *_ in people}
        self.full, self.last, self.title, self.words = {}, {}, {}, []
        names = ahocorasick.Automaton()
        for n, name, title, firm in sorted(people, key=lambda p: p[0]):
            tokens = _WORD.findall((name or "").lower())
            if len(tokens) > 1:
                self.full.setdefault(" ".join(tokens), n)
                self.full.setdefault(" ".join([tokens[-1], *tokens[:-1]]), n)
                if (n, tokens) not in self.words:
                    self.words.append((n, tokens))
            if tokens:
                if (n, tokens[0]) not in (known := self.last.setdefault(tokens[-1], [])):
                    known.append((n, tokens[0]))
            if title and n not in (holders := self.title.setdefault(" ".join(_WORD.findall(title.lower())), [])):
                holders.append(n)
        for kind, table in (("full", self.full), ("last", self.last), ("title", self.title)):
            for phrase in table:
                if phrase and (phrase not in names or kind == "full"):
                    names.add_word(phrase, (kind, phrase))
        self.names = names
        if len(names):
            names.make_automaton()

    def _role(self, kinds: tuple[str, ...]) -> int | None:
        for k in kinds:
            if len(self.title.get(k, ())) == 1:
                return self.title[k][0]
        return None

    def find(self, label: str, *, strict: bool) -> int | None:
        """The participant a label names, 0 for an unknown one, None if it names nobody.

        strict: for a label inside a text, which must open with the name and hold no other words
        but a title, a firm or a time behind a bracket, dash or comma.
        """
        tokens = _WORD.findall(_TIMES.sub(" ", label).lower())
        if not tokens:
            return None
        said = " ".join(tokens)
        if tokens[0] in UNKNOWN:
            return 0 if not strict or len(tokens) <= 3 else None
        if (m := _NUMBERED.fullmatch(said.replace(" ", "_"))) or (m := _NUMBERED.fullmatch("".join(tokens))):
            return int(m[1]) if int(m[1]) in self.numbers else 0
        head = _TIMES.sub(" ", label).lower().strip(" \t\xa0>")
        lead = " ".join(_WORD.findall(re.split(r"\s[-–—]\s|[(\[|/]|,(?=[^,]*,)|,\s*(?=(?:%s)\b)" % "|".join(map(re.escape, [*self.title, *TITLE_SHORT] or ["$"])), head, maxsplit=1)[0]))
        hits: dict[str, list[tuple[int, int, str]]] = {"full": [], "last": [], "title": []}
        if len(self.names):
            for end, (kind, phrase) in self.names.iter(said):
                a = end - len(phrase) + 1
                if (a == 0 or said[a - 1] == " ") and (end + 1 == len(said) or said[end + 1] == " "):
                    hits[kind].append((a, end + 1, phrase))
        for a, b, phrase in hits["full"]:
            if not strict or (a == 0 and phrase == lead):
                return self.full[phrase]
        for a, b, phrase in hits["last"]:
            rest = said[:a].split()
            own = [n for n, first in self.last[phrase] if not rest or first.startswith(rest[-1]) and len(rest) == 1]
            if len(own) == 1 and (not strict or lead == said[:b]):
                return own[0]
        for a, b, phrase in hits["title"]:
            if lead == phrase or said == phrase:
                return self.title[phrase][0] if len(self.title[phrase]) == 1 else 0 if not strict else None
        if said in ("operator", "conference operator", "moderator"):
            return self._role(("conference operator", "operator", "moderator"))
        if lead in TITLE_SHORT:
            return self._role((TITLE_SHORT[lead],))
        if lead in ("q", "question", "interviewer"):
            return self._role(ASKING)
        if lead in ("a", "answer", "expert"):
            return self._role(ANSWERING)
        best = []
        first_word, *others = lead.split() or [""]
        for n, own in self.words:
            if others:
                d = _near(lead, " ".join(own), 3)
                d = min(d, _near(lead, " ".join([own[-1], *own[:-1]]), 3))
                if len(first_word) == 1 and own[0].startswith(first_word):
                    d = min(d, _near(others[-1], own[-1], 3))
            else:
                d = _near(lead, own[-1], 3)
            if d <= (2 if len(lead) >= 6 else 0):
                best.append((d, n))
        best.sort()
        if best and (len(best) == 1 or best[0][0] < best[1][0]):
            return best[0][1]
        return None if strict else 0


def segments(speaker: str | None, text: str | None, cast: Cast) -> list[tuple[int | None, str]]:
    """(participant or None, clean words) of the parts of a passage; a part without words is left out."""
    now = cast.find(speaker, strict=False) if speaker and speaker.strip() else None
    out: list[tuple[int | None, list[str]]] = [(now, [])]
    for line in (text or "").split("\n"):
        m = _OPENING.match(line)
        who = cast.find(m[1], strict=True) if m else None
        if who is not None:
            out.append((who, [line[m.end() :]]))
        else:
            out[-1][1].append(line)
    return [(who, said) for who, lines in out if (said := clean("\n".join(lines)))]


def spoken(passages: DataFrame, participants: DataFrame) -> DataFrame:
    """(document_id, seq, passage_id, part, participant_no or null, words): the parts with words of the passages of documents with participants."""
    people = (
        participants.select(F.col("document_id").cast("long").alias("document_id"), F.struct(F.col("participant_no").cast("int").alias("n"), "full_name", "job_title", "firm").alias("p"))
        .where("document_id is not null and p.n is not null")
        .groupBy("document_id")
        .agg(F.sort_array(F.collect_set("p")).alias("people"))
    )
    rows = passages.select(F.col("document_id").cast("long").alias("document_id"), F.col("seq").cast("int").alias("seq"), F.col("passage_id").cast("long").alias("passage_id"), F.col("speaker").cast("string").alias("speaker"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        casts: dict[int, Cast] = {}
        for pdf in batches:
            out = []
            for doc, seq, pid, speaker, text, people_ in zip(pdf["document_id"], pdf["seq"], pdf["passage_id"], pdf["speaker"], pdf["text"], pdf["people"]):
                if doc not in casts:
                    if len(casts) > 1000:
                        casts.clear()
                    casts[doc] = Cast([(p["n"], p["full_name"], p["job_title"], p["firm"]) for p in people_])
                out += [(doc, seq, pid, i, who, words) for i, (who, words) in enumerate(segments(speaker, text, casts[doc]))]
            done = pd.DataFrame(out, columns=["document_id", "seq", "passage_id", "part", "participant_no", "words"])
            yield done.astype({"document_id": "int64", "seq": "Int32", "passage_id": "Int64", "part": "int32", "participant_no": "Int32"})

    return rows.join(people, "document_id").dropDuplicates(["document_id", "seq", "passage_id"]).mapInPandas(run, "document_id long, seq int, passage_id long, part int, participant_no int, words string")


def turns(passages: DataFrame, participants: DataFrame, *, words: bool = True) -> DataFrame:
    """(document_id, turn_no, participant_no, first_passage_id[, words]): the turns of each document with participants, numbered from 1.

    Reading order is ``seq``, then passage_id, then the place in the text; a null seq comes
    first. Passages without words give no turn and interrupt none. Text without a label
    continues the last speaker; before any label, and where a label names nobody known, it is
    participant 0. Null and empty texts count as without words; repeated rows count once; a
    document without participants gives no rows; empty tables give an empty result; other
    columns are ignored.
    """
    order = Window.partitionBy("document_id").orderBy("seq", "passage_id", "part")
    who = spoken(passages, participants).withColumn("who", F.coalesce(F.last("participant_no", ignorenulls=True).over(order), F.lit(0)))
    starts = who.withColumn("starts", F.coalesce((F.col("who") != F.lag("who").over(order)).cast("int"), F.lit(1)))
    numbered = starts.withColumn("turn_no", F.sum("starts").over(order).cast("int"))
    if not words:
        return numbered.where("starts = 1").select("document_id", "turn_no", F.col("who").alias("participant_no"), F.col("passage_id").alias("first_passage_id"))
    said = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("seq", "passage_id", "part", "words"))), lambda s: s["words"]))
    per = numbered.groupBy("document_id", "turn_no").agg(F.first("who").alias("participant_no"), F.min(F.struct("seq", "passage_id")).getField("passage_id").alias("first_passage_id"), said.alias("words"))
    return per.select("document_id", "turn_no", "participant_no", "first_passage_id", "words")

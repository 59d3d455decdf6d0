"""Problem 7: encoding a corpus with a public byte-level BPE vocabulary, through a lexicon automaton.

Words (the tokenizer's pre-split pieces) are counted over the whole corpus. The frequent ones
are encoded once and compiled into a minimal acyclic transducer: prefixes and suffixes are
shared, and the number of a word is the sum of the skips along its path, which points to
its ids. The file is memory-mapped by the workers; words it doesn't hold are merged exactly.
"""

from __future__ import annotations

import base64
import heapq
import mmap
import re
import struct
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import near
from tessera.session import cut, shared_file

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words of the lexicon; words a task remembers, at most, and their longest length in characters.
LEXICON, REMEMBERED, LONGEST = 50_000, 400_000, 64
#: Grades of frequency to each doubling.
STEPS = 16
#: The tokenizer's pattern of pieces; L, N and S stand for letters, numbers and white space (fixed value).
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[N]+| ?[^SLN]+|[S]+(?![^S])|[S]+"
WHITE = "\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _ranges(kind: str, top: int) -> str:
    out, start = [], None
    for c in range(top + 2):
        inside = c <= top and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(re.escape(chr(start)) + ("-" + re.escape(chr(c - 1)) if c - 1 > start else ""))
            start = None
    return "".join(out)


def piece_patterns() -> tuple[str, str]:
    """The pattern for texts of the basic plane, whose classes are plain bit maps, and the one for all texts."""
    both = []
    for top in (0xFFFF, sys.maxunicode):
        classes = {"L": _ranges("L", top), "N": _ranges("N", top), "S": WHITE}
        both.append(re.sub(r"\[(\^?)([SLN]+)\]", lambda m: f"[{m[1]}{''.join(classes[x] for x in m[2])}]", PATTERN))
    return both[0], both[1]


class Pieces:
    """Splits texts into pieces."""

    def __init__(self, patterns: tuple[str, str]) -> None:
        self.plain, self._wide, self.wide = re.compile(patterns[0]).findall, patterns[1], None

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text):
            return self.plain(text)
        if self.wide is None:
            self.wide = re.compile(self._wide).findall
        return self.wide(text)


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes to id, of a rank file (base64 token, blank, id on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: neighbours are merged, lowest rank first, leftmost first; a heap keeps long pieces near-linear."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, size = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else n
        if j >= n or len(parts[i]) + len(parts[j]) != size or ranks.get(parts[i] + parts[j]) != r:
            continue
        parts[i] += parts[j]
        parts[j] = None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n:
                both = parts[a] + parts[b]
                if (x := ranks.get(both)) is not None:
                    heapq.heappush(heap, (x, a, len(both)))
    return [ranks[p] for p in parts if p is not None]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic automaton of the words with their ids, as one block of little-endian numbers.

    Built from sorted words, each finished state being replaced by an equal one (same finality
    and edges) where there is one, so suffixes are shared. Every edge has a skip: how many
    words come before those behind it.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def finish(state: list) -> int:
        key = (state[0], tuple(sorted(state[1].items())))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, {}]]
    last = b""
    for word in sorted(words):
        same = 0
        while same < min(len(last), len(word)) and last[same] == word[same]:
            same += 1
        while len(path) > same + 1:
            done = finish(path.pop())
            path[-1][1][last[len(path) - 1]] = done
        for byte in word[same:]:
            path[-1][1][byte] = -1
            path.append([False, {}])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        done = finish(path.pop())
        path[-1][1][last[len(path) - 1]] = done
    root = finish(path[0])
    count = [0] * len(states)
    first, byte, target, skip = [0], [], [], []
    for s, (final, edges) in enumerate(states):  # a state follows those it leads to
        n = int(final)
        for b, t in edges:
            byte.append(b)
            target.append(t)
            skip.append(n)
            n += count[t]
        count[s] = n
        first.append(len(byte))
    ids = [words[w] for w in sorted(words)]
    at = np.zeros(len(ids) + 1, "<i4")
    np.cumsum([len(x) for x in ids], out=at[1:])
    parts = [np.asarray(x, "<i4") for x in (first, byte, target, skip, [int(f) for f, _ in states], at, list(chain.from_iterable(ids)))]
    return struct.pack("<8i", root, *[len(p) for p in parts]) + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A compiled lexicon, memory-mapped from ``path`` or in ``content``."""

    def __init__(self, path: str | None, content: bytes | None = None) -> None:
        if path is not None:
            with open(path, "rb") as f:
                view = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        else:
            view = memoryview(content)
        self.root, *sizes = struct.unpack_from("<8i", view)
        numbers, at, arrays = view[32:].cast("i"), 0, []
        for n in sizes:
            arrays.append(numbers[at : at + n])
            at += n
        self.first, self.byte, self.target, self.skip, self.final, self.at, self.ids = arrays

    def get(self, word: bytes) -> tuple[int, ...] | None:
        state, number, first, byte = self.root, 0, self.first, self.byte
        for b in word:
            lo, hi = first[state], first[state + 1]
            end = hi
            while lo < hi:
                mid = (lo + hi) // 2
                if byte[mid] < b:
                    lo = mid + 1
                else:
                    hi = mid
            if lo == end or byte[lo] != b:
                return None
            number += self.skip[lo]
            state = self.target[lo]
        return tuple(self.ids[self.at[number] : self.at[number + 1]]) if self.final[state] else None


class Ids(dict):
    """Piece to ids: from the lexicon, else merged; what was met is remembered up to a bound."""

    def __init__(self, lexicon: Lexicon, ranks: dict[bytes, int]) -> None:
        self.lexicon, self.ranks = lexicon, ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "replace")
        ids = self.lexicon.get(raw)
        if ids is None:
            ids = tuple(merge(raw, self.ranks))
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


def frequent_words(documents: DataFrame, text: str, patterns: tuple[str, str], most: int) -> list[str]:
    """The most frequent pieces of all texts, at most ``most``, counted by task, then by piece.

    Frequencies are graded, STEPS to each doubling, and whole grades are taken, so that no
    more than ``most`` pieces and a count for each grade ever come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = Pieces(patterns), Counter()

        def out() -> pa.RecordBatch:
            kept = [(p, n) for p, n in counts.items() if len(p) <= LONGEST]
            return pa.RecordBatch.from_arrays([pa.array([p.encode("utf-8", "replace").decode() for p, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["piece", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.update(split(t))
            if len(counts) > REMEMBERED:
                yield out()
                counts.clear()
        yield out()

    counted = documents.select(F.col(text).cast("string").alias(text)).where(F.col(text).isNotNull()).mapInArrow(run, "piece string, n long")
    counted = cut(counted.groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1").withColumn("step", F.floor(F.log2("n") * STEPS)))
    least, room = None, most
    for r in sorted(counted.groupBy("step").count().collect(), reverse=True):
        if (room := room - r["count"]) < 0:
            break
        least = r.step
    return [] if least is None else sorted(r.piece for r in counted.where(F.col("step") >= least).select("piece").collect())


def encode(documents: DataFrame, *, row_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, lexicon: int = LEXICON) -> DataFrame:
    """(doc_id, ids): the ids of every document's whole text, once per document, without special tokens.

    A null and an empty text have no ids: an empty list, never null. The strings of special
    tokens are ordinary text. A document given twice counts once; an empty table gives
    an empty result; other columns are ignored. ``vocabulary`` is the path of a rank file on the
    driver; ``lexicon`` bounds the words compiled, which changes the speed only.
    """
    spark = documents.sparkSession
    patterns, ranks = piece_patterns(), read_ranks(vocabulary)
    words = {w.encode(): merge(w.encode(), ranks) for w in frequent_words(documents, text, patterns, lexicon)}
    block = compile_lexicon(words)
    path = shared_file(spark, "lexicon", block)
    known, content = spark.sparkContext.broadcast(ranks), None if path else spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, ids = Pieces(patterns), Ids(Lexicon(path, content.value if content else None), known.value)
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1).to_pylist()
            for at, some in near.slices(texts):
                per = [list(chain.from_iterable(map(ids.__getitem__, split(t)))) if t else [] for t in some]
                ends = np.zeros(len(per) + 1, np.int32)
                np.cumsum([len(x) for x in per], out=ends[1:])
                flat = np.fromiter(chain.from_iterable(per), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([docs.slice(at, len(some)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[row_id, "ids"])

    rows = documents.select(F.col(row_id).cast("long").alias(row_id), F.col(text).cast("string").alias(text)).where(F.col(row_id).isNotNull())
    return near.once(rows, row_id).mapInArrow(run, f"`{row_id}` long, ids array<int>")

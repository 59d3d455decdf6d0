"""Problem 9: the subjects of each document, by label propagation over a verified document graph.

Documents are compared by their telling words: those whose hand-labelled documents agree
on a subject, in a document's own sentences, outside quotes and its source's repeated lines. Every
two documents that share SHARED of these words and CONTAINED of the smaller set are linked; there are
no candidates beside that, and a link weighs the square of the sets' likeness. Links are neither
shuffled nor stored: documents with the same words are one node, the nodes are dealt to tiles, and a
task compares those of its tile with all that have a label and adds up what they bring. Labels go
round over the links; hand-given labels that the graph supports are trusted and clamped, others are
released; a document keeps every subject with a share of its neighbours' labels. What a subject needs to be a document's
own, sentences of its own, is then checked on its text, by the words telling in the
propagated labels.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import near
from tessera.llm import wordhash as wh
from tessera.llm.cuts import _END, ABBREVIATIONS, _ends_sentence
from tessera.session import cut

#: Sentences that make a subject a document's own; that keep a hand-given label.
OWN, CLAMPED = 3, 2
#: Labelled documents of a word, at least, when it is learnt from hand-given labels and from propagated ones, and the share of them that must agree on one subject.
SEED_SUPPORT, SUPPORT, AGREEMENT = 2, 3, 0.6
#: A link's shared telling words and their share of the smaller set, at least.
SHARED, CONTAINED = 2, 0.15
#: A label's share among a document's neighbours that gives it to the document; that keeps a hand-given one.
GIVEN_ON, TRUSTED = 0.25, 0.15
#: A word goes into the matrix product of two chunks if at least one in so many of their pairs of nodes share it; else its pairs are counted one by one.
RARE = 200
#: Nodes of a tile, at most, and its nodes times subjects (8 bytes each); tiles for each core where there are fewer nodes; nodes compared at once.
TILE, CELLS, TILES, CHUNK = 131_072, 8_000_000, 2, 768
#: Rows of two chunks' links that are weighed at once.
STRIP = 64
#: What a node does in a tile.
ASK, GIVE, BOTH = 0, 1, 2
#: Line hashes of all sources that are broadcast together, at most (8 bytes each); beyond it they are joined with a shuffle.
BROADCAST_LINES = 1_000_000

_QUOTES = re.compile(r"[“„][^“”„\n]+[”“]|«[^«»\n]+»|[“„][^“”„\f]+[”“]")

#: What a character is to a sentence's end.
_MARK, _CLOSING, _SPACE = 1, 2, 3


def _kind(c: str) -> int:
    return _MARK if c in ".!?…" else _CLOSING if c in "\"'”’»)]" else _SPACE if c.isspace() else 0


def _skips(documents: DataFrame, least_documents: int = 3, least_share: float = 0.05) -> DataFrame:
    """(source, skip): the hashes of the lines that a source repeats. A document is in ``documents`` once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at, some in near.slices(texts):
                h, owner, _, _ = wh.lines(some)
                order = np.lexsort((h, owner))
                h, owner = h[order], owner[order]
                once = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))[: len(h)]
                h, owner = h[once], owner[once]
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(at + owner)), pa.array(h.view(np.int64))], names=["source", "h"])

    total = documents.groupBy("source").agg(F.count("*").alias("total"))
    lines = documents.select("text", "source").where("text is not null").mapInArrow(run, "source string, h long")
    often = lines.groupBy("source", "h").agg(F.count("*").alias("n")).where(F.col("n") >= least_documents)
    kept = often.join(total, often["source"].eqNullSafe(total["source"])).where(F.col("n") >= least_share * F.col("total")).select(often["source"], "h")
    return cut(kept.groupBy("source").agg(F.collect_set("h").alias("skip")))  # under 1 / least_share times the lines of a document


def _ends_here(low: str, m: re.Match) -> bool:
    """Whether a sentence of a lower-cased text ends at this mark; only after a short word or an abbreviation are the full rules asked."""
    at = m.start()
    word = low[low.rfind(" ", max(0, at - 24), at) + 1 if at else 0 : at][-24:]
    if not word.isalnum():
        word = (word.split() or [""])[-1].lstrip("([{\"'“„«")
    return (len(word) > 1 and word not in ABBREVIATIONS) or _ends_sentence(low, m)


@cache
def _tails() -> np.ndarray:
    """The last words of abbreviations."""
    h, owner, _, _ = wh.words(sorted(ABBREVIATIONS))
    return h[np.append(owner[1:] != owner[:-1], True)]


def _sentence_ends(low: list[str], laid: tuple[np.ndarray, np.ndarray], h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where sentences of lower-cased texts end, as places in ``laid``. h, start, end: the texts' words, by place.

    Marks are found for all texts at once, as ``_END`` finds them. One that follows a word of two characters or
    more, with which no abbreviation ends, ends a sentence; the rules are asked about the others only.
    """
    codes, first = laid
    kind = np.append(wh.kinds("ends", _kind)[codes], _SPACE)
    at = np.flatnonzero((kind == _MARK) | (kind == _CLOSING))
    is_mark, place = kind[at] == _MARK, np.arange(len(at))
    mark = np.maximum.accumulate(np.where(is_mark, place, -1)) if len(at) else place  # the last up to here
    starts = is_mark & np.append(True, ~is_mark[:-1] | (np.diff(at) > 1))[: len(at)]
    begin = at[np.maximum.accumulate(np.where(starts, place, 0))[mark]] if len(at) else at
    ends = np.flatnonzero((kind[at + 1] == _SPACE) & (mark >= 0) & (at - at[mark] == place - mark))
    at, begin = at[ends] + 1, begin[ends]
    word = np.minimum(np.searchsorted(end, begin), max(len(end) - 1, 0))
    sure = (end[word] == begin) & (end[word] - start[word] > 1) & ~np.isin(h[word], _tails()) if len(end) else np.zeros(len(at), bool)
    for k in np.flatnonzero(~sure):
        i = np.searchsorted(first, begin[k], side="right") - 1
        sure[k] = _ends_here(low[i], _END.match(low[i], begin[k] - first[i]))
    return at[sure]


def _own_words(texts: list[str | None], skips: list[set[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, number of text, number of sentence in the text) of the words with letters only in the texts' own sentences."""
    low = [t.lower() if t else "" for t in texts]
    laid = wh.laid_out(low)
    h, owner, start, end = wh.words(low, laid)
    if not len(h):
        return h, owner, start
    keep = wh.only_letters(low, owner, start, end, laid) & (end - start > 2)
    line_h, line_owner, line_start, line_end = wh.lines(low, laid)
    line_cuts = np.searchsorted(line_owner, np.arange(len(low) + 1))
    cuts = np.searchsorted(owner, np.arange(len(low) + 1))
    first = laid[1]
    edges = np.sort(np.concatenate((first[line_owner] + line_start, _sentence_ends(low, laid, h, first[owner] + start, first[owner] + end))))
    sentence = np.searchsorted(edges, first[owner] + start, side="right") - np.searchsorted(edges, first)[owner]
    for i, t in enumerate(low):
        a, b = cuts[i], cuts[i + 1]
        if a == b:
            continue
        drop = [m.span() for m in _QUOTES.finditer(t)] if any(q in t for q in "“„«") else []
        if skips[i]:
            own = slice(line_cuts[i], line_cuts[i + 1])
            drop += [(x, y) for g, x, y in zip(line_h[own].view(np.int64).tolist(), line_start[own].tolist(), line_end[own].tolist()) if g in skips[i]]
        if drop:
            x, y = np.searchsorted(start[a:b], np.array(drop).T)
            for x, y in zip((a + x).tolist(), (a + y).tolist()):
                keep[x:y] = False
    return h[keep], owner[keep], sentence[keep]


def own_words(rows: DataFrame) -> DataFrame:
    """(doc_id, words, sentences): the words of each document's own sentences as 32-bit hashes, and the number of each word's sentence; a word counts once in a sentence. rows: doc_id, text, skip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            skips = [set(s) if s else set() for s in batch.column("skip").to_pylist()]
            for at, some in near.slices(texts):
                h, owner, sentence = _own_words(some, skips[at : at + len(some)])
                h, place = h >> np.uint64(32), (owner << 32) + sentence
                order = np.lexsort((h, place))
                h, place = h[order], place[order]
                once = np.concatenate(([True], (h[1:] != h[:-1]) | (place[1:] != place[:-1])))[: len(h)]
                h, owner, sentence = h[once], place[once] >> 32, place[once] & 0xFFFFFFFF
                ends = pa.array(np.searchsorted(owner, np.arange(len(some) + 1)).astype(np.int32))
                words = pa.array(h.astype(np.uint32).view(np.int32))
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(some)), pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, pa.array(sentence.astype(np.int32)))], names=["doc_id", "words", "sentences"])

    return rows.select("doc_id", "text", "skip").where("text is not null").mapInArrow(run, "doc_id long, words array<int>, sentences array<int>")


def _seeds(labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject, weight): hand-given labels by the spelling of ``subjects``; a document's weights add up to 1."""
    plain = lambda c: F.lower(F.regexp_replace(F.trim(F.col(c).cast("string")), r"\s+", " "))
    names = subjects.select(F.col("subject").cast("string").alias("subject"), plain("subject").alias("plain")).where("plain is not null").dropDuplicates(["plain"])
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), plain("subject").alias("plain"), F.col("labeler").cast("string").alias("labeler")).distinct()
    votes = given.join(names, "plain").where("doc_id is not null").groupBy("doc_id", "subject").agg(F.count("*").alias("n"))
    total = votes.groupBy("doc_id").agg(F.sum("n").alias("total"))
    return votes.join(total, "doc_id").select("doc_id", "subject", (F.col("n") / F.col("total")).alias("weight"))


def _tell(own: DataFrame, labels: DataFrame, names: list[str], support: int) -> DataFrame:
    """(word, subject, weight, n): the words whose labelled documents agree on a subject, verified, and the number of these documents. labels: (doc_id, subject, weight)."""
    met = own.join(labels.select("doc_id", _number(names).alias("s"), "weight"), "doc_id").select(F.explode(F.array_distinct("words")).alias("word"), "s", "weight").groupBy("word", "s").agg(F.sum("weight").alias("w"))
    best = met.groupBy("word").agg(F.sum("w").alias("n"), F.max(F.struct("w", "s")).alias("top"))  # names are in order
    return cut(best.where((F.col("n") >= support - 1e-9) & (F.col("top.w") >= (AGREEMENT - 1e-9) * F.col("n"))).select("word", _named(names, "top.s").alias("subject"), (F.col("top.w") / F.col("n")).alias("weight"), "n"))


def telling_sets(own: DataFrame, telling: DataFrame) -> DataFrame:
    """(doc_id, words): the distinct telling words of a document, for documents that have any.

    Up to BROADCAST_IDS telling words go to the tasks and are numbered from the one of most
    labelled documents on, so that ``words`` begins with the commonest; more are joined and keep their hashes.
    """
    words = telling.select("word", "n")
    if words.limit(near.BROADCAST_IDS + 1).count() > near.BROADCAST_IDS:
        met = own.select("doc_id", F.explode(F.array_distinct("words")).alias("word")).join(words, "word", "left_semi")
        return met.groupBy("doc_id").agg(F.array_sort(F.collect_set("word")).alias("words"))
    table = words.orderBy(F.desc(F.round("n", 6)), "word").toPandas()["word"].to_numpy(np.int32)
    place = np.argsort(table)
    known = own.sparkSession.sparkContext.broadcast((table[place], place.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, number = known.value
        for batch in batches:
            words = batch.column("words")
            size, flat = np.diff(words.offsets.to_numpy()), words.flatten().to_numpy()
            if not len(flat) or not len(have):
                continue
            at = np.minimum(np.searchsorted(have, flat), len(have) - 1)
            hit = have[at] == flat
            both = np.unique((np.repeat(np.arange(batch.num_rows), size)[hit] << 32) + number[at[hit]])
            ends = np.searchsorted(both >> 32, np.arange(batch.num_rows + 1)).astype(np.int32)
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array((both & 0xFFFFFFFF).astype(np.int32)))], names=["doc_id", "words"])
            yield out.filter(pa.array(np.diff(ends) > 0))

    return own.select("doc_id", "words").mapInArrow(run, "doc_id long, words array<int>")


def _support(own: DataFrame, telling: DataFrame) -> DataFrame:
    """(doc_id, subject, n): how many own sentences of each document support each subject, a sentence the strongest only, of equally strong ones the last by name."""
    if telling.limit(near.BROADCAST_IDS + 1).count() > near.BROADCAST_IDS:
        said = own.select("doc_id", F.explode(F.arrays_zip("words", "sentences")).alias("at")).select("doc_id", F.col("at.sentences").alias("sentence"), F.col("at.words").alias("word"))
        votes = said.join(telling.select("word", "subject", "weight"), "word").groupBy("doc_id", "sentence", "subject").agg(F.round(F.sum("weight"), 9).alias("w"))
        return votes.groupBy("doc_id", "sentence").agg(F.max(F.struct("w", "subject")).alias("top")).groupBy("doc_id", F.col("top.subject").alias("subject")).agg(F.count("*").alias("n"))
    table = telling.orderBy("word").toPandas()
    names = sorted(set(table["subject"]))
    known = own.sparkSession.sparkContext.broadcast((table["word"].to_numpy(np.int32), np.searchsorted(names, table["subject"]) if names else np.empty(0, int), table["weight"].to_numpy(float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, of, weight = known.value
        for batch in batches:
            words = batch.column("words")
            ends, flat = words.offsets.to_numpy(), words.flatten().to_numpy()
            if not len(flat) or not len(have):
                continue
            at = np.minimum(np.searchsorted(have, flat), len(have) - 1)
            hit = np.flatnonzero(have[at] == flat)
            at, owner = at[hit], np.repeat(np.arange(batch.num_rows), np.diff(ends))[hit]
            if not len(at):
                continue
            place = ((owner.astype(np.int64) << 32) + batch.column("sentences").flatten().to_numpy()[hit]) * len(names) + of[at]
            order = np.argsort(place, kind="stable")
            place, w = place[order], weight[at[order]]
            first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            w, place = np.round(np.add.reduceat(w, first), 9), place[first]
            sentence, subject = place // len(names), place % len(names)
            order = np.lexsort((subject, w, sentence))
            last = np.concatenate((sentence[order][1:] != sentence[order][:-1], [True]))
            whose, n = np.unique((sentence[order][last] >> 32) * len(names) + subject[order][last], return_counts=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(whose // len(names))), pa.array(whose % len(names), pa.int32()), pa.array(n, pa.int64())], names=["doc_id", "s", "n"])

    counted = own.mapInArrow(run, "doc_id long, s int, n long")
    return counted.select("doc_id", F.element_at(F.array(*map(F.lit, names)) if names else F.array(F.lit("")), F.col("s") + 1).alias("subject"), "n")


class _Tile:
    """Sums over the links of some nodes, its rows, to all nodes that it meets. With ``mutual`` the rows have labels, which they give to the nodes they meet."""

    def __init__(self, rows: pa.RecordBatch, n_subjects: int, mutual: bool) -> None:
        self.node = rows.column("node").to_numpy()
        words, subjects = rows.column("words"), rows.column("subjects")
        self.ends = words.offsets.to_numpy() - words.offsets[0].as_py()
        self.known, self.code = np.unique(words.flatten().to_numpy(), return_inverse=True)
        self.sums = np.zeros((len(self.node), n_subjects))
        self.labels = _matrix(rows, n_subjects) if mutual else None
        self.wanted = np.zeros((len(self.node), 0 if mutual else n_subjects), bool)
        if not mutual:
            self.wanted[np.repeat(np.arange(len(self.node)), np.diff(subjects.offsets.to_numpy())), subjects.flatten().to_numpy()] = True
        self.by_node = np.argsort(self.node)
        self.room = [np.empty(CHUNK * n, kind) for n, kind in ((CHUNK, np.float32), (STRIP, np.float32), (STRIP, np.float32), (STRIP, bool))]
        self.chunks = [(a, min(a + CHUNK, len(self.node))) for a in range(0, len(self.node), CHUNK)]
        self.here = np.zeros((len(self.chunks), len(self.known)), bool)
        for c, (a, b) in enumerate(self.chunks):
            self.here[c, self.code[self.ends[a] : self.ends[b]]] = True

    def meet(self, rows: pa.RecordBatch, some: bool, own: int | None = None) -> np.ndarray:
        """Adds what the labels of ``rows``, at most CHUNK, bring; if ``some``, only to nodes with a wanted subject that nothing has brought yet.

        Gives the sums of what the tile's labels, if it has any, bring to ``rows``. With ``own``, rows are the
        tile's own chunk of this number, and meet themselves and the chunks before them.
        """
        words = rows.column("words")
        size, flat = np.diff(words.offsets.to_numpy()), words.flatten().to_numpy()
        at = np.minimum(np.searchsorted(self.known, flat), len(self.known) - 1)
        hit = self.known[at] == flat
        code, owner = at[hit], np.repeat(np.arange(len(size)), size)[hit]
        there = np.zeros(len(self.known), bool)
        there[code] = True
        labels = _matrix(rows, self.sums.shape[1])
        node = rows.column("node").to_numpy()
        same = self.by_node[np.minimum(np.searchsorted(self.node, node, sorter=self.by_node), len(self.node) - 1)]
        same[self.node[same] != node] = -1
        every, back = np.ones(len(size), bool), np.zeros((len(size), self.sums.shape[1]))
        for c, (a, b) in enumerate(self.chunks if own is None else self.chunks[: own + 1]):
            both = self.here[c] & there
            if np.count_nonzero(both) < SHARED:
                continue
            asking = (self.wanted[a:b] & (self.sums[a:b] == 0)).any(1) if some else np.ones(b - a, bool)
            if not asking.any():
                continue
            mine = self.ends[a : b + 1]
            i, *x = _picked(np.repeat(np.arange(b - a), np.diff(mine)), self.code[mine[0] : mine[-1]], both, asking)
            j, *y = _picked(owner, code, both, every)
            if not len(i) or not len(j):
                continue
            weight = self.room[0][: len(i) * len(j)].reshape(len(i), len(j))
            _count(*x, *y, weight)
            self._weigh(weight, np.diff(mine)[i], size[j])
            for k in np.flatnonzero((same[j] >= a) & (same[j] < b)):  # a node is no neighbour of itself
                weight[i == same[j[k]] - a, k] = 0
            self.sums[a + i] += weight @ labels[j]
            if self.labels is not None and c != own:
                back[j] += weight.T @ self.labels[a + i]
        return back

    def _weigh(self, shared: np.ndarray, n: np.ndarray, m: np.ndarray) -> None:
        """Makes the numbers of words that nodes of n and of m words share the weights of their links, some rows at once that stay in the processor's cache."""
        # a share of the smaller set is the smaller share
        n_least, m_least = (np.maximum(CONTAINED * k - 1e-6, SHARED).astype(np.float32) for k in (n, m))
        n, m = n.astype(np.float32), m.astype(np.float32)
        for a in range(0, len(n), STRIP):
            part = shared[a : a + STRIP]
            weight, least, enough = (r[: part.size].reshape(part.shape) for r in self.room[1:])
            np.greater_equal(part, np.minimum.outer(n_least[a : a + STRIP], m_least, out=least), out=enough)
            np.add.outer(n[a : a + STRIP], m, out=weight)
            weight -= part
            np.divide(part, weight, out=weight)
            weight *= weight
            np.multiply(weight, enough, out=part)

    def meet_itself(self, rows: pa.RecordBatch) -> None:
        """Adds what the labels of ``rows``, which are the tile's, bring to each other."""
        for c, (a, b) in enumerate(self.chunks):
            self.sums[a:b] += self.meet(rows.slice(a, b - a), False, c)


def _matrix(rows: pa.RecordBatch, n_subjects: int) -> np.ndarray:
    """The labels of each row."""
    subjects = rows.column("subjects")
    labels = np.zeros((rows.num_rows, n_subjects), np.float32)
    labels[np.repeat(np.arange(rows.num_rows), np.diff(subjects.offsets.to_numpy())), subjects.flatten().to_numpy()] = rows.column("weights").flatten().to_numpy()
    return labels


def _listed(name: str, ids: np.ndarray, sums: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    """(name, subjects, sums) of the rows with any sum."""
    who, subject = np.nonzero(sums)
    each = np.flatnonzero(np.bincount(who, minlength=len(ids)))
    ends = pa.array(np.concatenate((np.searchsorted(who, each), [len(who)])).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(ids[each]), pa.ListArray.from_arrays(ends, pa.array(subject.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(sums[who, subject]).cast(kind))], names=[name, "subjects", "sums"])


def _tiled(batches: Iterator[pa.RecordBatch], n_subjects: int, some: bool, mutual: bool) -> Iterator[pa.RecordBatch]:
    """(node, subjects, sums): what the rows of each tile that GIVE bring to those that ASK, and with ``mutual`` also these to those; what rows that do BOTH bring to each other. Rows of a kind come together, those that ASK first."""
    last, asking, met = None, [], None
    for batch in batches:
        tiles, kinds = batch.column("tile").to_numpy(), batch.column("kind").to_numpy()
        edges = [0, *(np.flatnonzero((tiles[1:] != tiles[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(tiles)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if tiles[a] != last:
                yield from _ended(met, asking, n_subjects)
                last, asking, met = tiles[a], [], None
            part = batch.slice(a, b - a)
            if kinds[a] != GIVE:
                asking.append(part)
            elif asking:
                met = met or _Tile(_joined(asking), n_subjects, mutual)
                for at in range(0, part.num_rows, CHUNK):
                    some_rows = part.slice(at, CHUNK)
                    back = met.meet(some_rows, some)
                    if mutual:
                        yield _listed("node", some_rows.column("node").to_numpy(), back, pa.float32())
    yield from _ended(met, asking, n_subjects)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _ended(met: _Tile | None, asking: list[pa.RecordBatch], n_subjects: int) -> Iterator[pa.RecordBatch]:
    """The sums of a tile's own rows."""
    if asking and asking[0].column("kind")[0].as_py() == BOTH:
        rows = _joined(asking)
        met = _Tile(rows, n_subjects, True)
        met.meet_itself(rows)
    if met:
        yield _listed("node", met.node, met.sums, pa.float32())


def _picked(owner: np.ndarray, code: np.ndarray, among: np.ndarray, asking: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, place in rows and word, one each for every word of them in ``among``) of the rows asking that have at least SHARED words of those; words are numbered afresh."""
    hit = among[code] & asking[owner]
    owner, code = owner[hit], code[hit]
    use = np.flatnonzero(np.bincount(owner, minlength=len(asking)) >= SHARED)
    row = np.full(len(asking), -1)
    row[use] = np.arange(len(use))
    owner = row[owner]
    return use, owner[owner >= 0], (np.cumsum(among) - 1)[code[owner >= 0]]


def _count(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray, out: np.ndarray) -> None:
    """``out``: how many words the rows share; row i has word x, column j has word y. Common words are counted by a matrix product, rare ones pair by pair."""
    size = max(x.max(), y.max()) + 1
    each = np.bincount(y, minlength=size)
    pairs = np.bincount(x, minlength=size) * each
    often = pairs * RARE >= out.size
    place, n = np.cumsum(often) - 1, np.count_nonzero(often)
    sides = []
    for row, word, rows in ((i, x, out.shape[0]), (j, y, out.shape[1])):
        hit = often[word]
        sides.append(np.zeros((rows, n), np.float32))
        sides[-1][row[hit], place[word[hit]]] = 1
    np.matmul(sides[0], sides[1].T, out=out)
    (i, x), (j, y) = ((row[~often[word]], word[~often[word]]) for row, word in ((i, x), (j, y)))
    each[often] = 0
    n, start = each[x], np.cumsum(each) - each
    at = np.arange(n.sum()) + np.repeat(start[x] - np.cumsum(n) + n, n)
    np.add.at(out.reshape(-1), np.repeat(i, n) * out.shape[1] + j[np.argsort(y, kind="stable")][at], np.float32(1))


def _nodes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, node), (node, words)): documents with the same telling words are one node; those with too few to be linked are left out."""
    named = near.kept(sets.where(F.size("words") >= SHARED).select("doc_id", F.xxhash64("words").alias("node"), "words"))
    return named.select("doc_id", "node"), near.kept(named.groupBy("node").agg(F.first("words").alias("words")))


def _number(names: list[str]) -> Column:
    return (F.array_position(F.array(*map(F.lit, names)), F.col("subject")) - 1).cast("int")


def _named(names: list[str], number: str) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.col(number) + 1)


def _dealt(nodes: DataFrame, per: DataFrame, asks: DataFrame | None, n_subjects: int) -> tuple[DataFrame, bool]:
    """((tile, kind, node, words, subjects, weights) laid out by tile, whether tiles are mutual).

    per: (node, subjects, weights), the labels; asks: (node, words, subjects), if not all nodes
    ask. Where all ask and most have labels, nodes are dealt to groups and a tile is two groups,
    or one, so that any two nodes meet once and give each other their labels. Else a tile
    is a part of the nodes that ask, and all with labels go to each.
    """
    spark, none = nodes.sparkSession, lambda kind: F.array().cast(f"array<{kind}>")
    n = nodes.count()
    mutual = asks is None and 2 * per.count() > n
    least = -(-n // max(1, min(TILE, CELLS // n_subjects)))
    most = min(-(-n // CHUNK), TILES * spark.sparkContext.defaultParallelism)
    groups = max(1, least, math.isqrt(2 * most) if mutual else most)
    tiles = groups * (groups + 1) // 2 if mutual else groups
    # numbers of tiles of which each is in another partition
    keys = [r[0] for r in spark.range(64 * tiles).groupBy(F.pmod(F.hash("id"), F.lit(tiles)).alias("p")).agg(F.min("id").alias("id")).orderBy("p").select("id").collect()]
    tile, group = F.array(*map(F.lit, keys)).cast("array<bigint>"), F.pmod(F.col("node"), F.lit(groups)).cast("int")
    if mutual:
        met = nodes.join(per, "node", "left").select("node", "words", F.coalesce("subjects", none("int")).alias("subjects"), F.coalesce("weights", none("double")).alias("weights"), group.alias("x"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("y"))
        lo, hi = F.least("x", "y"), F.greatest("x", "y")
        kind = F.when(F.col("x") == F.col("y"), BOTH).when(F.col("x") < F.col("y"), ASK).otherwise(GIVE)
        sent = met.select(F.element_at(tile, (hi * (hi + 1) / 2 + lo + 1).cast("int")).alias("tile"), kind.alias("kind"), "node", "words", "subjects", "weights")
    else:
        asks = asks if asks is not None else nodes.withColumn("subjects", none("int"))
        sent = asks.select(F.element_at(tile, group + 1).alias("tile"), F.lit(ASK).alias("kind"), "node", "words", "subjects", none("double").alias("weights"))
        sent = sent.union(nodes.join(per, "node").select(F.explode(tile).alias("tile"), F.lit(GIVE), "node", "words", "subjects", "weights"))
    # nodes that begin with the same words are compared at once: they share the most, and others can be passed over
    return sent.repartition(tiles, "tile").sortWithinPartitions("tile", "kind", F.get("words", F.lit(0)), F.get("words", F.lit(1)), "node"), mutual


def _by_document(rows: DataFrame, n_subjects: int) -> DataFrame:
    """(doc_id, subjects, sums, total): the sums of each document's node, and what other documents of the same node bring. rows: (node, doc_id, subjects, sums), doc_id null for a part of the node's sums; else the document and its own labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = _joined(parts)
        rows = rows.take(pa.array(np.argsort(rows.column("node").to_numpy(), kind="stable")))
        node = rows.column("node").to_numpy()
        _, place = np.unique(node, return_inverse=True)
        step = max(1, CELLS // n_subjects)
        for at in range(0, place[-1] + 1, step):
            a, b = np.searchsorted(place, [at, at + step])
            some, own = rows.slice(a, b - a), place[a:b] - at
            is_doc = ~np.asarray(some.column("doc_id").is_null())
            size = np.diff(some.column("subjects").offsets.to_numpy())
            cell = np.repeat(own, size) * n_subjects + some.column("subjects").flatten().to_numpy()
            value, of_doc = some.column("sums").flatten().to_numpy().astype(float), np.repeat(is_doc, size)
            brought, labels = (np.bincount(cell[k], value[k], minlength=(own[-1] + 1) * n_subjects).reshape(-1, n_subjects) for k in (~of_doc, of_doc))
            who = np.flatnonzero(is_doc)
            mine = np.zeros((len(some), n_subjects))
            mine[np.repeat(np.arange(len(some)), size)[of_doc], some.column("subjects").flatten().to_numpy()[of_doc]] = value[of_doc]
            # documents of one node are linked with weight 1, each with all but itself
            sums = brought[own[who]] + np.maximum(np.round(labels[own[who]] - mine[who], 9), 0)
            listed = _listed("doc_id", some.column("doc_id").take(pa.array(who)).to_numpy(), sums, pa.float64())
            yield listed.append_column("total", pa.array(sums[sums.any(1)].sum(1)))

    return rows.repartition("node").mapInArrow(run, "doc_id long, subjects array<int>, sums array<double>, total double")


def _brought(docs: DataFrame, nodes: DataFrame, labels: DataFrame, names: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, subjects, sums, total) of ``neighbours``, by number of subject."""
    given = docs.join(labels, "doc_id").select("doc_id", "node", _number(names).alias("s"), F.col("weight").alias("w"))
    lists = lambda df: df.agg(F.collect_list(F.struct("s", "w")).alias("of"))
    per = near.kept(lists(given.groupBy("node", "s").agg(F.sum("w").alias("w")).groupBy("node")).select("node", F.col("of.s").alias("subjects"), F.col("of.w").alias("weights")))
    asks = None
    if wanted is not None:
        asks = nodes.join(docs.join(wanted, "doc_id").groupBy("node").agg(F.collect_set(_number(names)).alias("subjects")), "node")
    dealt, mutual = _dealt(nodes, per, asks, len(names))
    size, some = len(names), wanted is not None
    linked = dealt.mapInArrow(lambda batches: _tiled(batches, size, some, mutual), "node long, subjects array<int>, sums array<float>")
    own = docs.join(lists(given.groupBy("doc_id")), "doc_id", "left").select("node", "doc_id", F.coalesce("of.s", F.array().cast("array<int>")).alias("subjects"), F.coalesce("of.w", F.array().cast("array<double>")).cast("array<float>").alias("sums"))
    return _by_document(linked.select("node", F.lit(None).cast("long").alias("doc_id"), "subjects", "sums").union(own), size)


def neighbours(docs: DataFrame, nodes: DataFrame, labels: DataFrame, names: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, subject, s): the weights of the links of each document to documents with a label, by subject, each times the label's weight.

    docs, nodes: as given by ``_nodes``; labels: (doc_id, subject, weight). With ``wanted``
    (doc_id, subject) only documents in it ask, and of their sums only those of wanted
    subjects are sure to be there, and only to be above 0 where they are so in whole.
    """
    brought = _brought(docs, nodes, labels, names, wanted)
    return brought.select("doc_id", F.explode(F.arrays_zip("subjects", "sums")).alias("l")).select("doc_id", _named(names, "l.subjects").alias("subject"), F.col("l.sums").alias("s"))


def propagated(docs: DataFrame, nodes: DataFrame, seeds: DataFrame, names: list[str], rounds: int) -> DataFrame:
    """(doc_id, subject, weight) after ``rounds`` rounds.

    Each round a document takes every subject with a share of at least GIVEN_ON among its
    neighbours' labels; a hand-given one stays as long as the share is at least TRUSTED. A
    document's weights add up to 1.
    """
    given = near.small(cut(seeds.groupBy("doc_id").agg(F.collect_set(_number(names)).alias("given"))))
    now = seeds
    for _ in range(rounds):
        per = _brought(docs, nodes, now, names).join(given, "doc_id", "left")
        least = lambda l: F.when(F.coalesce(F.array_contains("given", l["subjects"]), F.lit(False)), min(GIVEN_ON, TRUSTED)).otherwise(GIVEN_ON)  # noqa: E731, E741
        held = per.select("doc_id", F.filter(F.arrays_zip("subjects", "sums"), lambda l: F.round(l["sums"] / F.col("total"), 6) >= least(l)).alias("all"))  # noqa: E741
        now = cut(held.select("doc_id", F.size("all").alias("n"), F.explode("all.subjects").alias("s")).select("doc_id", _named(names, "s").alias("subject"), (F.lit(1.0) / F.col("n")).alias("weight")))
    return now


def subjects_of(documents: DataFrame, labels: DataFrame, subjects: DataFrame, *, rounds: int = 2, least_sentences: int = OWN) -> DataFrame:
    """(doc_id, subject): each subject, as spelled in ``subjects``, that a document treats as a matter of its own.

    That is a subject that a label brought over the document graph, or by hand, and that at
    least ``least_sentences`` of the document's sentences support, or at least
    two if the subject was hand-given. Sentences in quotes and the lines a source
    repeats do not count. Null, empty and blank texts have no subject; labels of unknown
    subjects or documents are ignored, repeated ones count once; without labels the result is
    empty, as it is for empty tables; of a doc_id given twice one row counts; other columns are ignored.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    rows = near.once(rows, "doc_id")
    skips = _skips(rows)
    size = skips.agg(F.coalesce(F.sum(F.size("skip")), F.lit(0))).first()[0]
    named = skips.withColumnRenamed("source", "skip_source")
    with_skips = rows.join(F.broadcast(named) if size <= BROADCAST_LINES else named, F.col("source").eqNullSafe(F.col("skip_source")), "left")
    own = near.kept(own_words(with_skips).repartition("doc_id"))  # from here on joins by document move no words
    seeds = cut(_seeds(labels, subjects))
    names = sorted(r[0] for r in seeds.select("subject").distinct().collect())
    if not names:
        return seeds.select("doc_id", "subject")
    docs, nodes = _nodes(telling_sets(own, _tell(own, seeds, names, SEED_SUPPORT)))
    now = propagated(docs, nodes, seeds, names, rounds)
    n = cut(_support(own, _tell(own, now, names, SUPPORT)).where(F.col("n") >= min(least_sentences, CLAMPED)))
    given = n.join(seeds.select("doc_id", "subject"), ["doc_id", "subject"], "left_semi").select("doc_id", "subject")
    asked = n.where(F.col("n") >= least_sentences).select("doc_id", "subject").join(given, ["doc_id", "subject"], "left_anti")
    reached = neighbours(docs, nodes, now, names, asked).select("doc_id", "subject")
    return given.union(asked.join(reached, ["doc_id", "subject"], "left_semi"))


def composition(found: DataFrame, documents: DataFrame) -> DataFrame:
    """(subject, n_documents, n_chars): the corpus by subject; a document with two counts in both."""
    sizes = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).alias("chars")).dropDuplicates(["doc_id"])
    return found.join(sizes, "doc_id").groupBy("subject").agg(F.count("*").alias("n_documents"), F.sum("chars").alias("n_chars"))

"""Links of passages to earlier ones of the same ticker: exact repeats, near duplicates, previously seen, and filing redlines."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.dates import day_of
from tessera.functions.pyfuncs import close_ratio, sequence_ratio
from tessera.operators.retrieval import B, K1, LEAST_IDF, MARKED, PLAIN
from tessera.session import cut, release

# Filing forms that are compared with each other.
FORM_FAMILIES = {"10-K": ("10-K", "10-K/A", "20-F", "40-F"), "10-Q": ("10-Q", "10-Q/A")}
#: Passages whose candidates are found in one task: those of a ticker go to up to TILES tasks of TILE or more, but never over TILE_MOST in one.
TILE, TILES, TILE_MOST = 16384, 8, 65536
#: Words with their number of passages that are broadcast together, at most (12 bytes each); beyond it they are joined with a shuffle.
BROADCAST_WORDS = 1_000_000
#: Candidates and scores that a task works on at once.
CHUNK, CELLS = 8192, 1 << 18
_TOKEN, _WORD = re.compile(tx.TOKEN, re.ASCII), re.compile(r"[^\W_]+")
_STOPWORDS, _PLAIN = frozenset(tx.STOPWORDS), str.maketrans(MARKED, PLAIN)
_OF_PASSAGE = ("passage_id", "doc_ticker", "day", "document_id")


def passage_rows(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """Passages, each once, with what their documents say of them; passages of unknown documents are left out."""
    docs = documents.select(F.col("doc_id").alias("document_id"), F.col("ticker").alias("doc_ticker"), "title", "source_type", "source", "doc_date", "path", "ingested_at", "form", "origin", F.col("status").alias("doc_status"), day_of(F.col("doc_date"), F.col("ingested_at")).alias("day"))
    return passages.dropDuplicates(["passage_id"]).join(docs, "document_id")


def exact_repeats(rows: DataFrame) -> DataFrame:
    """(passage_id, repeat_of): passages whose text the ticker had in a strictly earlier document, with the first that had it.

    Earlier is by day, then document id. Passages of one document don't repeat each other. One
    window over (ticker, hash); null tickers and texts are left out.
    """
    keyed = rows.where("doc_ticker is not null and text is not null and day is not null").select("passage_id", "doc_ticker", "document_id", "day", "seq", tx.sha256("text").alias("h"))
    by = Window.partitionBy("doc_ticker", "h").orderBy("day", "document_id", "seq", "passage_id")
    first = F.first(F.struct("passage_id", "document_id")).over(by)
    return keyed.withColumn("first", first).where("first.document_id <> document_id").select("passage_id", F.col("first.passage_id").alias("repeat_of"))


class _Hash(dict):
    """64-bit hashes of words, those asked for lately at hand."""

    def __init__(self, seed: int):
        self.salt = seed.to_bytes(8, "big")

    def __missing__(self, word: str) -> int:
        if len(self) > BROADCAST_WORDS:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8, salt=self.salt).digest(), "big", signed=True)
        return h


def _indexed(low: str) -> list[str]:
    """``index_words`` of a lower-cased text; marks don't part words, so they are taken off word by word."""
    words = _WORD.findall(low)
    return words if low.isascii() else [w if w.isascii() else w.translate(_PLAIN) for w in words]


def _tells(token: str) -> bool:
    return token not in _STOPWORDS and (len(token) > 2 or any(map(str.isdigit, token)))


def analysed(text: str) -> tuple[list[str], list[str], list[str]]:
    """The same as ``index_words`` and ``tx.content_words`` of a text, and the indexed words of its ``tx.query_terms``, each once."""
    low = text.lower()
    content = list(filter(_tells, dict.fromkeys(_TOKEN.findall(low))))
    asked = dict.fromkeys(x for w in sorted(content, key=len, reverse=True)[: tx.QUERY_TERMS] for x in ((w,) if w.isalnum() else _WORD.findall(w)))
    return _indexed(low), content, list(asked)


def _counted(base: DataFrame) -> tuple[DataFrame, int, int, float]:
    """((h, n, asked): in how many passages each word is as an indexed one, and whether it may be asked for, by its hash; the seed of the hash, by which no two words of the corpus have one; passages, and their mean number of words)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, tokens, total, size = Counter(), set(), 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                low = text.lower()
                words = _indexed(low)
                n.update(set(words))
                tokens.update(_TOKEN.findall(low))
                total, size = total + 1, size + len(words)
            if len(n) + len(tokens) > BROADCAST_WORDS:
                yield given(n, tokens, total, size)
                n, tokens, total, size = Counter(), set(), 0, 0
        yield given(n, tokens, total, size)

    def given(n: Counter, tokens: set[str], total: int, size: int) -> pa.RecordBatch:
        content = set(filter(_tells, tokens))
        asked = {x for w in content for x in _WORD.findall(w)}
        all_ = list(content | asked | n.keys())
        return pa.RecordBatch.from_arrays([pa.array([None, *all_], pa.string()), pa.array([total, *(n[w] for w in all_)], pa.int64()), pa.array([size] + [0] * len(all_), pa.int64()), pa.array([False, *(w in asked for w in all_)])], names=["word", "n", "size", "asked"])

    words = cut(base.select("text").mapInArrow(count, "word string, n long, size long, asked boolean").groupBy("word").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.bool_or("asked").alias("asked")))
    total, size = words.where("word is null").select("n", "size").first() or (0, 0)
    for seed in range(64):

        def hashes(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            known = _Hash(seed)
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([known[w] for w in batch.column(0).to_pylist()], pa.int64()), batch.column(1), batch.column(2)], names=["h", "n", "asked"])

        hashed = words.where("word is not null").select("word", "n", "asked").mapInArrow(hashes, "h long, n long, asked boolean")
        if hashed.groupBy("h").count().where("count > 1").isEmpty():
            return hashed, seed, total, (size / total if total else 0.0) or 1.0
    raise ValueError("no hash tells all words")


def _offsets(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(where each list begins and the last ends, their members)."""
    ends = lists.offsets.to_numpy()
    return ends - ends[0], lists.flatten().to_numpy()


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The whole numbers from each ``first`` on, ``size`` of them, one span after the other."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _days(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("day").cast(pa.int32()).to_numpy()


class _Best:
    """The best candidates so far of the passages of one tile, which ask in the order of their time."""

    def __init__(self, asks: pa.RecordBatch, most: int, avg_len: float):
        self.most, self.avg_len, self.n = most, avg_len, asks.num_rows
        self.id, self.day, self.doc = asks.column("passage_id").to_numpy(), _days(asks), asks.column("document_id").to_numpy()
        self.ends, self.words = _offsets(asks.column("asked"))
        self.idf = asks.column("idf").flatten().to_numpy()
        self.content_ends, self.content = _offsets(asks.column("content"))
        self.score, self.cand, self.shared = np.full((self.n, most), -np.inf), np.zeros((self.n, most), np.int64), np.zeros((self.n, most))

    def meet(self, rows: pa.RecordBatch) -> None:
        """Takes candidates, which come in the order of their time, into account."""
        C = rows.num_rows
        ids = rows.column("passage_id").to_numpy()
        # how many of these candidates are strictly earlier than each passage
        kind = np.concatenate((np.zeros(self.n, np.int64), np.ones(C, np.int64)))
        order = np.lexsort((kind, np.concatenate((self.doc, rows.column("document_id").to_numpy())), np.concatenate((self.day, _days(rows)))))
        earlier = np.empty(self.n + C, np.int64)
        earlier[order] = np.cumsum(kind[order])
        earlier = earlier[: self.n]
        start = int(np.searchsorted(earlier, 1))  # of passages in their order of time
        if start == self.n:
            return
        ends, words = _offsets(rows.column("words"))
        size = rows.column("size").to_numpy()
        vocabulary, word = np.unique(words, return_inverse=True)
        key, f = np.unique(word.astype(np.int64) * C + np.repeat(np.arange(C), np.diff(ends)), return_counts=True)
        if not len(key):
            return
        doc = key % C
        part = f * (K1 + 1) / (f + K1 * ((1 - B) + B * size[doc] / self.avg_len))
        at = np.minimum(np.searchsorted(vocabulary, self.words), len(vocabulary) - 1)
        known = (vocabulary[at] == self.words) & (self.idf > 0)
        content_ends, content = _offsets(rows.column("content"))
        kinds, content = np.unique(content, return_inverse=True)
        mine = np.minimum(np.searchsorted(kinds, self.content), max(len(kinds) - 1, 0))
        mine_known = kinds[mine] == self.content if len(kinds) else np.zeros(len(mine), bool)
        step = max(1, CELLS // C)
        for a in range(start, self.n, step):
            b = min(self.n, a + step)
            span = slice(self.ends[a], self.ends[b])
            ok = known[span]
            who = np.repeat(np.arange(b - a), np.diff(self.ends[a : b + 1]))[ok]
            from_ = at[span][ok].astype(np.int64) * C
            first, last = np.searchsorted(key, from_), np.searchsorted(key, from_ + earlier[a:b][who])
            n = last - first
            hit = _spans(first, n)
            score = np.bincount(doc[hit] + np.repeat(who * C, n), part[hit] * np.repeat(self.idf[span][ok], n), minlength=(b - a) * C).reshape(b - a, C)
            least = np.maximum(self.score[a:b].min(axis=1), 0)
            if C > self.most:
                least = np.maximum(least, np.partition(score[:, : earlier[b - 1]], -self.most, axis=1)[:, -self.most] if earlier[b - 1] > self.most else 0)
            who, which = np.nonzero((score >= (least - 1e-6)[:, None]) & (score > 0))
            if not len(who):
                continue
            # the words that both have, by a row of marks for each passage
            marks = np.zeros((b - a, len(kinds) + 1), bool)
            own = slice(self.content_ends[a], self.content_ends[b])
            have = np.diff(self.content_ends[a : b + 1])
            marks[np.repeat(np.arange(b - a), have)[mine_known[own]], mine[own][mine_known[own]]] = True
            n = content_ends[which + 1] - content_ends[which]
            both = np.cumsum(np.concatenate(([0], marks[np.repeat(who, n), content[_spans(content_ends[which], n)]])))
            upto = np.cumsum(n)
            both = both[upto] - both[upto - n]
            shared = np.where((n == 0) | (have[who] == 0), 0.0, both / np.maximum(n + have[who] - both, 1))
            self._take(a, b, who, np.round(score[who, which], 6), ids[which], shared)

    def _take(self, a: int, b: int, who: np.ndarray, score: np.ndarray, cand: np.ndarray, shared: np.ndarray) -> None:
        old_who, old = np.nonzero(self.score[a:b] > -np.inf)
        who, score, cand, shared = (np.concatenate(x) for x in ((old_who, who), (self.score[a:b][old_who, old], score), (self.cand[a:b][old_who, old], cand), (self.shared[a:b][old_who, old], shared)))
        order = np.lexsort((cand, -score, who))
        who = who[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        kept = place < self.most
        for table, new in ((self.score, score), (self.cand, cand), (self.shared, shared)):
            table[a + who[kept], place[kept]] = new[order][kept]

    def rows(self, least: float) -> pa.RecordBatch:
        who, place = np.nonzero((self.score > -np.inf) & (self.shared >= least))
        return pa.RecordBatch.from_arrays([pa.array(self.id[who]), pa.array(self.cand[who, place]), pa.array((place + 1).astype(np.int32)), pa.array(self.shared[who, place])], names=["passage_id", "candidate_id", "place", "shared"])


def candidates(rows: DataFrame, most: int = tx.CANDIDATES, *, least: float = 0.0, broadcast: int = BROADCAST_WORDS) -> DataFrame:
    """(passage_id, candidate_id, place, shared): for each passage up to ``most`` earlier ones of its ticker by BM25 over its most distinctive words.

    ``shared`` is the Jaccard likeness of the content words; those under ``least`` take a place but
    are not given. Statistics are those of all rows. Ties go to the smaller id. The passages of a ticker are
    dealt to tiles; a task reads the ticker's passages in the order of their time, some at a time, scores them all
    for its tile and holds the best, so pairs are neither shuffled nor stored.
    """
    base = rows.where("doc_ticker is not null and text is not null and day is not null").select("passage_id", "doc_ticker", "day", "document_id", "text")
    counted, seed, total, avg_len = _counted(base)
    idf = F.log((F.lit(total) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    rare = counted.select("h", F.when((F.col("n") == 0) | ~F.col("asked"), 0.0).when(idf > 0, idf).otherwise(LEAST_IDF).alias("idf"))
    few = counted.limit(broadcast + 1).count() <= broadcast
    table = rare.toPandas().sort_values("h") if few else None
    known = base.sparkSession.sparkContext.broadcast((table["h"].to_numpy(np.int64), table["idf"].to_numpy(float)) if few else None)

    def analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Hash(seed)
        for batch in batches:
            columns = []
            found = [analysed(t) for t in batch.column("text").to_pylist()]
            for each in zip(*found):
                ends = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int32)
                flat = np.fromiter(map(number.__getitem__, chain.from_iterable(each)), np.int64, ends[-1])
                if few:
                    flat = np.searchsorted(known.value[0], flat).astype(np.int32)
                if few and not columns:  # of the words of a passage only those that may be asked for
                    hit = known.value[1][flat] > 0
                    flat, ends = flat[hit], np.concatenate(([0], np.cumsum(hit)))[ends].astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            if not columns:
                continue
            weights = columns[2].flatten().to_numpy()
            weights = pa.ListArray.from_arrays(columns[2].offsets, pa.array(known.value[1][weights] if few else np.zeros(len(weights))))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in _OF_PASSAGE] + [pa.array([len(f[0]) for f in found], pa.int32()), *columns, weights], names=[*_OF_PASSAGE, "size", "words", "content", "asked", "idf"])

    word = "int" if few else "long"
    weighed = base.mapInArrow(analyse, f"passage_id long, doc_ticker string, day date, document_id long, size int, words array<{word}>, content array<{word}>, asked array<{word}>, idf array<double>")
    if not few:
        each = weighed.select("passage_id", F.explode("asked").alias("h")).join(rare.where("idf > 0"), "h").groupBy("passage_id").agg(F.collect_list(F.struct("h", "idf")).alias("of"))
        weighed = weighed.drop("asked", "idf").join(each, "passage_id", "left").withColumn("asked", F.coalesce("of.h", F.array().cast("array<bigint>"))).withColumn("idf", F.coalesce("of.idf", F.array().cast("array<double>"))).drop("of")
    sizes = base.groupBy("doc_ticker").agg(F.count("*").alias("n")).select("doc_ticker", F.ceil(F.col("n") / F.least(F.lit(TILE_MOST), F.greatest(F.lit(TILE), F.ceil(F.col("n") / TILES)))).cast("int").alias("tiles"))
    # a passage asks in one tile and is a candidate in all of its ticker
    sent = weighed.join(sizes, "doc_ticker").withColumn("mine", F.pmod(F.xxhash64("passage_id"), F.col("tiles")).cast("int"))
    none = lambda column: F.slice(column, 1, 0)
    to = F.concat(F.array(F.struct(F.col("mine").alias("tile"), F.lit(0).alias("kind"))), F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(t.alias("tile"), F.lit(1).alias("kind"))))
    sent = sent.withColumn("to", F.explode(to)).withColumn("asks", F.col("to.kind") == 0)
    sent = sent.select("doc_ticker", "to.tile", "to.kind", "day", "document_id", "passage_id", "size", F.when(F.col("asks"), none("words")).otherwise(F.col("words")).alias("words"), "content", F.when(F.col("asks"), F.col("asked")).otherwise(none("asked")).alias("asked"), F.when(F.col("asks"), F.col("idf")).otherwise(none("idf")).alias("idf"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, asks, best = None, [], None
        for batch in batches:
            tickers, tiles, kinds = (batch.column(i).to_pylist() for i in range(3))
            edges = [0, *(i for i in range(1, len(tiles)) if tiles[i] != tiles[i - 1] or kinds[i] != kinds[i - 1] or tickers[i] != tickers[i - 1]), len(tiles)]
            for a, b in zip(edges, edges[1:]):
                if (tickers[a], tiles[a]) != last:
                    if best:
                        yield best.rows(least)
                    last, asks, best = (tickers[a], tiles[a]), [], None
                some = batch.slice(a, b - a)
                if kinds[a] == 0:
                    asks.append(some)
                elif asks:
                    best = best or _Best(pa.Table.from_batches(asks).combine_chunks().to_batches()[0], most, avg_len)
                    for at in range(0, some.num_rows, CHUNK):
                        best.meet(some.slice(at, CHUNK))
        if best:
            yield best.rows(least)

    dealt = sent.repartition("doc_ticker", "tile").sortWithinPartitions("doc_ticker", "tile", "kind", "day", "document_id")
    return dealt.mapInArrow(run, "passage_id long, candidate_id long, place int, shared double")


def links(rows: DataFrame) -> DataFrame:
    """(passage_id, repeat_of, similar_to, similarity, seen_ids): every passage with its links to earlier ones of its ticker.

    An exact repeat has no other links. A near duplicate shares PREFILTER of the content words
    and NEAR of the token sequence; seen are up to SEEN_LIMIT that share SEEN of the words. Candidates that
    are repeats themselves take a place but are never linked.
    """
    # read several times from here on: the join of passages with documents is done once
    rows = cut(rows.select("passage_id", "doc_ticker", "document_id", "day", "seq", "text"))
    release(rows.sparkSession)
    repeats = cut(exact_repeats(rows))
    found = candidates(rows, least=tx.SEEN).join(repeats.select("passage_id"), "passage_id", "left_anti").join(repeats.select(F.col("passage_id").alias("candidate_id")), "candidate_id", "left_anti")
    scored = cut(found)
    del found
    release(rows.sparkSession)  # what the tiles read
    seen = scored.groupBy("passage_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("shared")).alias("s"), F.col("candidate_id").alias("id")))), 1, tx.SEEN_LIMIT), lambda s: s["id"]).alias("seen_ids"))
    mine = rows.select("passage_id", F.col("text").alias("t"))
    theirs = rows.select(F.col("passage_id").alias("candidate_id"), F.col("text").alias("ct"))
    near = scored.where(F.col("shared") >= tx.PREFILTER).join(mine, "passage_id").join(theirs, "candidate_id").withColumn("ratio", close_ratio("t", "ct", tx.NEAR)).where("ratio is not null")
    best = near.groupBy("passage_id").agg(F.max(F.struct("ratio", (-F.col("place")).alias("p"), "candidate_id")).alias("best")).select("passage_id", F.col("best.candidate_id").alias("similar_to"), F.round("best.ratio", 4).alias("similarity"))
    out = rows.select("passage_id").join(repeats, "passage_id", "left").join(best, "passage_id", "left").join(seen, "passage_id", "left")
    return out.select("passage_id", "repeat_of", "similar_to", "similarity", F.coalesce("seen_ids", F.array().cast("array<bigint>")).alias("seen_ids"))


def form_family(form) -> F.Column:
    """'10-K' or '10-Q' for the forms compared with each other, else null."""
    out = F.when(F.lit(False), "")
    for family, forms in FORM_FAMILIES.items():
        out = out.when(form.isin(*forms), family)
    return out


def latest_two(documents: DataFrame) -> DataFrame:
    """(ticker, family, new_id, old_id): of every ticker and form family the latest filing and the one before, by day and id."""
    filed = documents.where("ticker is not null").select("doc_id", "ticker", form_family(F.col("form")).alias("family"), day_of(F.col("doc_date"), F.col("ingested_at")).alias("day")).where("family is not null and day is not null")
    by = Window.partitionBy("ticker", "family").orderBy(F.desc("day"), F.desc("doc_id"))
    ranked = filed.withColumn("place", F.row_number().over(by)).where("place <= 2")
    return ranked.groupBy("ticker", "family").agg(F.max(F.when(F.col("place") == 1, F.col("doc_id"))).alias("new_id"), F.max(F.when(F.col("place") == 2, F.col("doc_id"))).alias("old_id")).where("old_id is not null")


def redlines(passages: DataFrame, pairs: DataFrame, *, most: int = 80) -> DataFrame:
    """(ticker, family, kind, passage_id, old_passage_id, ratio, place): what changed from the old filing to the new.

    A new passage with the same normalized text as an old one is unchanged and not listed. Of the
    others, one that shares words with an old passage and NEAR of its sequence is changed, the rest
    are added; old passages that nothing was matched to are removed. Per filing pair at most
    ``most`` items, changed before added before removed, in reading order.
    """
    texts = passages.dropDuplicates(["passage_id"]).where("text is not null").select("document_id", "passage_id", "seq", "text", tx.normalize("text").alias("norm"), tx.content_words("text").alias("words"))
    # each is used several times, and has few of all passages: their words are worked out once
    new = cut(pairs.join(texts.withColumnRenamed("document_id", "new_id"), "new_id").select("ticker", "family", "passage_id", "seq", "text", "norm", "words"))
    old = cut(pairs.join(texts.withColumnRenamed("document_id", "old_id"), "old_id").select("ticker", "family", F.col("passage_id").alias("old_passage_id"), F.col("seq").alias("old_seq"), F.col("text").alias("old_text"), F.col("norm").alias("old_norm"), F.col("words").alias("old_words")))
    key = ["ticker", "family"]
    same = new.join(old.withColumnRenamed("old_norm", "norm"), [*key, "norm"]).select(*key, "passage_id", "old_passage_id")
    left = new.join(same.select("passage_id").distinct(), "passage_id", "left_anti")
    met = left.select(*key, "passage_id", F.explode("words").alias("word")).join(old.select(*key, "old_passage_id", F.explode("old_words").alias("word")), [*key, "word"]).select(*key, "passage_id", "old_passage_id").distinct()
    close = met.join(left.select("passage_id", "text", "words"), "passage_id").join(old.select("old_passage_id", "old_seq", "old_text", "old_words"), "old_passage_id")
    close = cut(close.where(tx.jaccard(F.col("words"), F.col("old_words")) >= tx.PREFILTER)).withColumn("ratio", sequence_ratio("old_text", "text")).where(F.col("ratio") >= tx.NEAR)
    best = close.groupBy(*key, "passage_id").agg(F.max(F.struct("ratio", (-F.col("old_seq")).alias("s"), "old_passage_id")).alias("best"))
    changed = best.join(left.select("passage_id", "seq"), "passage_id").select(*key, F.lit("changed").alias("kind"), "passage_id", F.col("best.old_passage_id").alias("old_passage_id"), F.round("best.ratio", 4).alias("ratio"), "seq")
    none = F.lit(None)
    added = left.join(best.select("passage_id"), "passage_id", "left_anti").select(*key, F.lit("added").alias("kind"), "passage_id", none.cast("long").alias("old_passage_id"), none.cast("double").alias("ratio"), "seq")
    used = same.select("old_passage_id").union(changed.select("old_passage_id")).distinct()
    removed = old.join(used, "old_passage_id", "left_anti").select(*key, F.lit("removed").alias("kind"), none.cast("long").alias("passage_id"), "old_passage_id", none.cast("double").alias("ratio"), F.col("old_seq").alias("seq"))
    all_ = changed.unionByName(added).unionByName(removed)
    by = Window.partitionBy(*key).orderBy(F.when(F.col("kind") == "changed", 0).when(F.col("kind") == "added", 1).otherwise(2), "seq", "passage_id", "old_passage_id")
    return all_.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most).drop("seq")

"""Problem 8: evaluation texts leaking into training text, by a prefix-filtered containment join.

An item's windows are its runs of WINDOW words; a document gives an item away if it holds one
whole. A window's tokens are its shingles of PART words. To hold the window a document must
hold all of them, so one token is prefix enough: the rarest in the corpus. A document's
shingles meet the prefix tokens, the token's place in the window bounds where the window
would lie, and exactly that stretch of words is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import near
from tessera.llm import wordhash as wh
from tessera.llm.near import union_all

WINDOW, PART = 13, 5
#: Windows of items that are broadcast at once (24 bytes each); more items are taken in blocks of so many windows.
BLOCK = 500_000


def _windows(items: list[tuple[int, str]], window: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window hash, tokens of each window as a matrix, item_id) of all items, each distinct window of an item once."""
    texts = [t for _, t in items]
    h, owner, _, _ = wh.words(texts)
    whole, at = wh.shingles(h, owner, window)
    if not len(whole):
        return whole, np.empty((0, window - part + 1), np.uint64), np.empty(0, np.int64)
    tokens, where = wh.shingles(h, owner, part)
    place = np.full(len(h), -1, np.int64)
    place[where] = np.arange(len(where))
    matrix = tokens[place[at[:, None] + np.arange(window - part + 1)]]
    ids = np.asarray([i for i, _ in items], np.int64)[owner[at]]
    order = np.lexsort((ids, whole))
    fresh = np.concatenate(([True], (whole[order][1:] != whole[order][:-1]) | (ids[order][1:] != ids[order][:-1])))
    keep = order[fresh]
    return whole[keep], matrix[keep], ids[keep]


def _rarity(documents: DataFrame, text: str, tokens: np.ndarray, part: int) -> np.ndarray:
    """How often each of the sorted ``tokens`` occurs in all documents; counts are added up by task, then by token number."""
    known = documents.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, total = known.value, np.zeros(len(known.value), np.int64)
        for batch in batches:
            for _, some in near.slices(batch.column(0).to_pylist()):
                h, owner, _, _ = wh.words(some)
                s, _ = wh.shingles(h, owner, part)
                i = np.minimum(np.searchsorted(have, s), len(have) - 1)
                total += np.bincount(i[have[i] == s], minlength=len(have))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["token", "n"])

    counts = documents.select(F.col(text).cast("string").alias(text)).where(F.col(text).isNotNull()).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    out = np.zeros(len(tokens), np.int64)
    for r in counts.toPandas().itertuples():
        out[r.token] = r.n
    return out


def _block(documents: DataFrame, row_id: str, text: str, items: list[tuple[int, str]], window: int, part: int) -> DataFrame:
    whole, matrix, ids = _windows(items, window, part)
    tokens = np.unique(matrix)
    counts = _rarity(documents, text, tokens, part) if len(tokens) else np.empty(0, np.int64)
    n = counts[np.searchsorted(tokens, matrix)]
    lead = np.lexsort((np.arange(matrix.size) % max(1, matrix.shape[1]), n.ravel(), np.repeat(np.arange(len(matrix)), matrix.shape[1]))).reshape(matrix.shape)[:, 0] - np.arange(len(matrix)) * matrix.shape[1] if len(matrix) else np.empty(0, np.int64)
    prefix = matrix[np.arange(len(matrix)), lead]
    held = n[np.arange(len(matrix)), lead] > 0  # a window whose rarest token no document has is in none
    prefix, place, whole, ids = prefix[held], lead[held], whole[held], ids[held]
    order = np.argsort(prefix, kind="stable")
    index = documents.sparkSession.sparkContext.broadcast((prefix[order], place[order], whole[order], ids[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, off, full, item = index.value
        for batch in batches:
            doc, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for start, some in near.slices(texts):
                if not len(pre):
                    continue
                h, owner, _, _ = wh.words(some)
                s, at = wh.shingles(h, owner, part)
                a, b = np.searchsorted(pre, s, side="left"), np.searchsorted(pre, s, side="right")
                met = np.flatnonzero(b > a)
                if not len(met):
                    continue
                per = (b - a)[met]
                row = np.repeat(met, per)
                entry = np.repeat(a[met], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
                begin = at[row] - off[entry]
                fits = (begin >= 0) & (begin + window <= len(h))
                begin, entry = begin[fits], entry[fits]
                fits = owner[begin] == owner[begin + window - 1] if len(begin) else np.empty(0, bool)
                begin, entry = begin[fits], entry[fits]
                if not len(begin):
                    continue
                whole_, where = wh.shingles(h, owner, window)
                spot = np.searchsorted(where, begin)
                same = whole_[spot] == full[entry]
                found = np.unique(np.stack((owner[begin][same] + start, item[entry][same])), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(doc[found[0]]), pa.array(found[1])], names=[row_id, "item_id"])

    rows = documents.select(F.col(row_id).cast("long").alias(row_id), F.col(text).cast("string").alias(text)).where(F.col(row_id).isNotNull() & F.col(text).isNotNull())
    return rows.mapInArrow(run, f"`{row_id}` long, item_id long")


def leaks(documents: DataFrame, items: DataFrame, *, row_id: str = "doc_id", text: str = "text", window: int = WINDOW, part: int = PART, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id), each once: the document holds ``window`` words in a row that also stand in a row in the item.

    Words are longest runs of letters and digits, lower-cased. Items come to the driver in
    blocks of at most ``block`` windows, so neither the driver nor a broadcast grows with
    their number; each block is one pass over the documents. Null, empty and shorter texts on
    either side give no row; overlapping items each give their own; repeated rows count
    once; empty tables give an empty result; other columns are ignored.
    """
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    parts, now, size = [], [], 0
    for r in wanted.toLocalIterator():
        n = max(0, len(r.text.split()) * 2)
        if now and size + n > block:
            parts.append(_block(documents, row_id, text, now, window, part))
            now, size = [], 0
        now.append((r.item_id, r.text))
        size += n
    parts.append(_block(documents, row_id, text, now, window, part))
    return union_all(parts).distinct()


def leaked_items(found: DataFrame) -> DataFrame:
    """(item_id, n_documents): how many documents give each leaked item away."""
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_documents"))

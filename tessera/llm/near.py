"""What the near-duplicate operators share: fingerprints, table matches and exact checks.

A *node* is a distinct set of word shingles, named by a 64-bit hash; exact copies of a
text are one node, so a hot group of copies costs one node however large it is. The
operators make keys of nodes, nodes that share a key are candidates, and candidates are
checked exactly on their shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import wordhash as wh
from tessera.session import cut

#: Ids that are broadcast to pick rows out of a scan: at most so many (8 or 16 bytes each); beyond it, a shuffle join.
BROADCAST_IDS = 300_000
#: Partitions of the shuffle of keys, as a multiple of the session's number.
WIDER = 4
#: Nodes that one task remembers so as to make the keys of copies once only; then it starts afresh.
SEEN = 500_000
#: A batch of texts is hashed in slices of about so many characters.
SLICE = 400_000

#: Flat sorted shingle sets and their offsets to (owner of each key, key, fingerprint of each set as bytes or None).
KeyMaker = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray | None]]


def slices(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """(position, texts) of slices of about SLICE characters; a longer text is a slice of its own."""
    at = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > SLICE:
            yield at, texts[at:i]
            at, size = i, 0
        size += n + 1
    if at < len(texts):
        yield at, texts[at:]


def flat_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat sorted distinct shingles, offsets of each text's, number of words of each text)."""
    sets, n = [], np.empty(len(texts), np.int64)
    for i, (n_words, s) in enumerate(wh.shingle_sets(texts, k)):
        sets.append(s)
        n[i] = n_words
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=offsets[1:])
    return np.concatenate(sets) if sets else np.empty(0, np.uint64), offsets, n


def node_ids(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The name of each set; 0 for an empty one."""
    size = np.diff(offsets)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(wh.mix(flat), out=sums[1:])
        ids = wh.mix((sums[offsets[1:]] - sums[offsets[:-1]]) ^ size.astype(np.uint64))
    ids[size == 0] = 0
    return ids.astype(np.int64)


def keyed(df: DataFrame, row_id: str, text: str, *, k: int, least_words: int, maker: KeyMaker, at: Column | None = None) -> DataFrame:
    """(row_id, node, keys, mark, at) of the rows whose text has at least ``least_words`` words and a shingle of k words.

    ``at``, a number of the row, is handed on, if given; else it is null. ``keys`` is empty and ``mark``, the fingerprint, null where the same task has made them
    for the node before. Null and blank texts give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for at, part in slices(texts):
                flat, offsets, n = flat_sets(part, k)
                nodes = node_ids(flat, offsets)
                use = np.flatnonzero((n >= max(least_words, 1)) & (np.diff(offsets) > 0))
                if not len(use):
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                fresh = []
                for i in use:
                    if (x := int(nodes[i])) not in seen:
                        seen.add(x)
                        fresh.append(i)
                keys, ends = np.empty(0, np.int64), np.zeros(len(part), np.int64)
                prints: list[bytes | None] = [None] * len(part)
                if fresh:
                    sub = np.zeros(len(fresh) + 1, np.int64)
                    np.cumsum(np.diff(offsets)[fresh], out=sub[1:])
                    owner, key, marks = maker(np.concatenate([flat[offsets[i] : offsets[i + 1]] for i in fresh]), sub)
                    keys = key.astype(np.int64)
                    ends[fresh] = np.bincount(owner, minlength=len(fresh))
                    for j, i in enumerate(fresh if marks is not None else ()):
                        prints[i] = marks[j].tobytes()
                cuts = np.concatenate(([0], np.cumsum(ends[use]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at + use]), pa.array(nodes[use]), pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys)), pa.array([prints[i] for i in use], pa.binary()), batch.column(2).take(pa.array(at + use))], names=[row_id, "node", "keys", "mark", "at"])

    picked = df.select(F.col(row_id).cast("long").alias(row_id), F.col(text).cast("string").alias(text), (F.lit(None) if at is None else at).cast("long").alias("at")).where(F.col(text).isNotNull() & F.col(row_id).isNotNull())
    return picked.mapInArrow(run, f"`{row_id}` long, node long, keys array<long>, mark binary, at long")


def runs(rows: DataFrame) -> DataFrame:
    """(key, node) of the keys that two nodes or more have; the rest never leaves the partition it was sorted in.

    One shuffle by key, over WIDER times the session's partitions, as a row has tens of keys.
    Nodes repeated within a key were made by different tasks and count once.
    """
    parts = WIDER * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met(rows.select("node", F.explode("keys").alias("key")).repartition(parts, "key"))


def met(keys: DataFrame, *more: str) -> DataFrame:
    """(key, node) of the keys that two nodes or more have, and the columns ``more``; ``keys`` is laid out by key already."""
    w = Window.partitionBy("key")
    return keys.withColumn("lo", F.min("node").over(w)).withColumn("hi", F.max("node").over(w)).where("lo < hi").select("key", "node", *more)


def together(found: DataFrame) -> DataFrame:
    """(a, b), a < b: nodes that share a key, each pair once. A hot key is split by adaptive skew handling of the join."""
    return found.select("key", F.col("node").alias("a")).join(found.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b").distinct()


def promising(pairs: DataFrame, rows: DataFrame, may: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The pairs whose fingerprints, one row of bytes for each end, ``may`` be alike."""
    marks = rows.where("mark is not null").groupBy("node").agg(F.max("mark").alias("mark"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, y = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(len(pdf), -1) for c in ("ma", "mb"))
                yield pdf.loc[may(x, y), ["a", "b"]]

    both = pairs.join(marks.select(F.col("node").alias("a"), F.col("mark").alias("ma")), "a").join(marks.select(F.col("node").alias("b"), F.col("mark").alias("mb")), "b")
    return both.select("a", "b", "ma", "mb").mapInPandas(run, "a long, b long")


def small(ids: DataFrame) -> DataFrame:
    """``ids``, one or two columns of 8 bytes and already cut, marked for broadcast if it has at most BROADCAST_IDS rows."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def hashed(texts: DataFrame, text: str, k: int) -> DataFrame:
    """(node, shingles) of the rows (node, text), each node once; ``shingles`` is the sorted set as little-endian 64-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes_, texts = batch.column("node").to_numpy(), batch.column(text).to_pylist()
            for at, part in slices(texts):
                flat, offsets, _ = flat_sets(part, k)
                raw = flat.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(nodes_[at : at + len(part)]), pa.array([raw[8 * offsets[i] : 8 * offsets[i + 1]] for i in range(len(part))], pa.binary())], names=["node", "shingles"])

    return texts.select("node", text).mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def sets_of(df: DataFrame, row_id: str, text: str, members: DataFrame, nodes: DataFrame, *, k: int) -> DataFrame:
    """(node, shingles) of ``nodes``, from the text of one member of each; other texts are filtered out before they are hashed.

    members: (row_id, node).
    """
    first = cut(members.join(nodes.select("node"), "node", "left_semi").groupBy("node").agg(F.min(row_id).alias(row_id)))
    picked = df.select(F.col(row_id).cast("long").alias(row_id), F.col(text).cast("string").alias(text)).where(F.col(text).isNotNull()).join(small(first), row_id)
    return hashed(picked, text, k)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared values of two sorted sets, divided by the values either has; 0 if both are empty."""
    if not len(a) and not len(b):
        return 0.0
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b, likeness) of the pairs whose sets have a likeness of at least ``least``, checked exactly."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for x, y in zip(pdf["sa"], pdf["sb"]):
                short, long_ = sorted((len(x), len(y)))
                got.append(likeness(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) if short >= least * long_ - 1e-9 else 0.0)
            pdf = pdf[["a", "b"]].assign(likeness=np.asarray(got, float))
            yield pdf[pdf["likeness"] >= least - 1e-12]

    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    return joined.select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long, likeness double")


def ends(pairs: DataFrame) -> DataFrame:
    """(node) at either end of a pair, once."""
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``pairs`` (a, b) is linked to over any number of links.

    Each round a node takes the smallest of its root's root and its neighbours' roots' roots, its
    root takes the same one, and the lineage is cut. Roots only sink, so it ends, and only
    when nothing moves: then all linked nodes have one root. Chains of 60 to 100,000 nodes, in
    order or shuffled, take about the logarithm of their length in rounds. No link leaves the executors.
    """
    links = cut(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = cut(links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        tops = roots.join(roots.select(F.col("node").alias("n2"), F.col("root").alias("top")), F.col("root") == F.col("n2")).select("node", "root", "top")
        near = links.join(tops.select(F.col("node").alias("b"), "top"), "b").groupBy("a").agg(F.min("top").alias("m"))
        met = cut(tops.join(near, F.col("node") == F.col("a")).select("node", "root", "top", "m"))
        hooks = met.groupBy(F.col("root").alias("n2")).agg(F.min("m").alias("hook"))
        step = cut(met.join(hooks, F.col("node") == F.col("n2"), "left").select("node", F.least("root", "top", "m", "hook").alias("root"), F.col("root").alias("old")))
        moved = step.where("root < old").limit(1).count()
        roots = step.select("node", "root")
        if not moved:
            return roots


def kept(df: DataFrame) -> DataFrame:
    """Persisted to memory and disk; a lost executor's part is made again from its lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def once(rows: DataFrame, row_id: str) -> DataFrame:
    """Each id once; texts are shuffled only if an id does occur twice."""
    if rows.groupBy(row_id).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return rows.dropDuplicates([row_id])
    return rows

"""Problem 6: near-duplicate records with small edits, by multi-index hashing.

Each node (distinct set of three-word shingles) gets a fingerprint of SEGMENTS x SYMBOLS
min-wise symbols; a symbol of two nodes is equal with a chance of their likeness. The
Hamming ball of radius 1 around each segment is enumerated by leaving out one symbol at
a time, every such variant is a table key, nodes that meet in a table are candidates, and
the candidates' complete distance is verified, first on the whole fingerprints, where it
must not exceed what the threshold allows by over four standard deviations, then exactly
on the shingle sets.

With the default 8 segments of 5 symbols, a pair of likeness 0.7 is met with a chance of
0.9975, one of 0.75 with 0.9997, one of 0.8 with 0.99999; no false pair passes the check.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import near
from tessera.llm import wordhash as wh
from tessera.session import cut

SEGMENTS, SYMBOLS = 8, 5


def ball_keys(flat: np.ndarray, offsets: np.ndarray, segments: int = SEGMENTS, symbols: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, key, fingerprint): segments * symbols keys of each non-empty set of ``flat``, and its symbols cut to a byte each."""
    n = len(offsets) - 1
    rng = np.random.default_rng(20240607)
    mult = rng.integers(1, 1 << 63, segments * symbols, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 1 << 63, segments * symbols, dtype=np.uint64)
    out = np.empty((n, segments * symbols), np.uint64)
    prints = np.empty((n, segments * symbols), np.uint8)
    with np.errstate(over="ignore"):
        for s in range(segments):
            marks = []
            for j in range(symbols):
                h = flat * mult[s * symbols + j] + add[s * symbols + j]
                h ^= h >> np.uint64(32)
                h *= np.uint64(0xD6E8FEB86659FD93)
                marks.append(wh.mix(np.minimum.reduceat(h, offsets[:-1]) + np.uint64(s * symbols + j)))
                prints[:, s * symbols + j] = marks[-1] & np.uint64(255)
            whole = np.sum(marks, axis=0, dtype=np.uint64)
            for j in range(symbols):
                out[:, s * symbols + j] = wh.mix((whole - marks[j]) ^ np.uint64(s * symbols + j + 1))
    return np.repeat(np.arange(n), segments * symbols), out.ravel().view(np.int64), prints


def agree(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether fingerprints agree in as many symbols as ``least`` leads to expect, less four standard deviations."""
    n = x.shape[1]
    return (x == y).sum(axis=1) >= n * least - 4 * np.sqrt(n * least * (1 - least))


def _found(df: DataFrame, row_id: str, text: str, *, least: float, least_words: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(members: row_id, node), (links between nodes: a, b, likeness)."""
    rows = near.kept(near.keyed(df, row_id, text, k=k, least_words=least_words, maker=ball_keys))
    members = rows.select(row_id, "node").distinct()
    pairs = cut(near.promising(near.together(cut(near.runs(rows))), rows, lambda x, y: agree(x, y, least)))
    sets = near.sets_of(df, row_id, text, members, near.ends(pairs), k=k)
    return members, cut(near.alike(pairs, sets, least))


def similar_pairs(df: DataFrame, row_id: str = "passage_id", text: str = "text", *, least: float = 0.7, least_words: int = 30, k: int = 3) -> DataFrame:
    """(lo, hi) of all rows whose texts have a likeness of at least ``least``, lo < hi, each once, copies included.

    That is as many rows as there are such pairs, so a group of n copies has n (n - 1) / 2 of them; similar_groups and
    similar_classes tell the same in a row for each text and for each link of different texts. Pairs within a class of copies and across
    linked classes are made by joins on the class alone, which adaptive execution splits where one is large.
    Null and blank texts, and texts under ``least_words`` words, have no pairs; an empty
    table gives an empty result; repeated rows count once; other columns are ignored.
    """
    members, links = _found(df, row_id, text, least=least, least_words=least_words, k=k)
    members = near.kept(members)
    x, y = (members.select("node", F.col(row_id).alias(v)) for v in "xy")
    copies = x.join(y, "node").where("x < y").select("x", "y")
    p, q = x.withColumnRenamed("node", "a"), y.withColumnRenamed("node", "b")
    across = links.select("a", "b").join(p, "a").join(q, "b").select("x", "y")
    return copies.union(across.select(F.least("x", "y"), F.greatest("x", "y"))).where("x < y").toDF("lo", "hi").distinct()


def similar_classes(df: DataFrame, row_id: str = "passage_id", text: str = "text", *, least: float = 0.7, least_words: int = 30, k: int = 3) -> DataFrame:
    """(lo, hi, likeness): the links between classes of rows with one shingle set, each named by its smallest id, lo < hi.

    Linear in groups of copies; similar_groups has the members of each class. Edge cases as in similar_pairs.
    """
    members, links = _found(df, row_id, text, least=least, least_words=least_words, k=k)
    named = near.kept(members.groupBy("node").agg(F.min(row_id).alias("id")))
    both = links.join(named.select(F.col("node").alias("a"), F.col("id").alias("x")), "a").join(named.select(F.col("node").alias("b"), F.col("id").alias("y")), "b")
    return both.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "likeness")


def similar_groups(df: DataFrame, row_id: str = "passage_id", text: str = "text", *, least: float = 0.7, least_words: int = 30, k: int = 3) -> DataFrame:
    """(row_id, class_id, group_id, n_links): one row per row with enough words.

    ``class_id`` is the smallest id with the same shingle set, ``group_id`` the smallest id
    over any chain of links, ``n_links`` the number of other classes directly alike.
    Edge cases as in similar_pairs.
    """
    members, links = _found(df, row_id, text, least=least, least_words=least_words, k=k)
    classes = members.groupBy("node").agg(F.min(row_id).alias("class_id"))
    counts = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    roots = near.components(links)
    at = classes.join(roots, "node", "left").join(counts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = at.groupBy("root").agg(F.min("class_id").alias("group_id"))
    at = at.join(smallest, "root").select("node", "class_id", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members.join(at, "node").select(row_id, "class_id", "group_id", "n_links")

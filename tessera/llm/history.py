"""Problem 4: new batches checked against all accepted history, by a segment index for edit distance.

A document is the ordered string of its distinct three-word shingle hashes. Between two
such strings the edit distance by insertion and deletion is the number of shingles that
only one has, and a likeness of J bounds it by (1 - J) / J times the length of either. The
string is laid out in blocks, as many as its length class says, and each block in segments; both are
ranges of hash values, so they need no shift when probed. If two strings in reach differ by d shingles
in all, some block has no more than its share of them, at most APART: at most so many of its segments differ, so
of each block the t + 1 most telling segments suffice, and the block's parities differ in
at most APART bits. Texts that share a segment by chance grow with the square of the corpus; nearly all are
told by the parities beside the key where the keys meet, and are never shuffled. How telling a segment is comes from
shingle frequencies in a bounded sample; that order changes the speed only, never the result.
A key that very many documents share is settled by its earliest ones first, see _peel.
Candidates are verified, first by a bound from their profiles, then by their exact distance; accepted documents' segments are appended.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import near
from tessera.llm import wordhash as wh
from tessera.session import cut, release, shared_dir

#: Texts read to learn which shingles are common, at most; and the cells of the frequency table.
SAMPLE, CELLS = 8_000, 1 << 22
SHIFT = 64 - 22
#: Upper ends of the length classes.
TOPS = np.unique(np.ceil(1.5 ** np.arange(60)).astype(np.int64))
#: Shingles by which a block of two strings in reach may differ, at most; segments of a block, more than that, and few, so that they are long.
APART, SLOTS = 7, 10
#: Bits of a block's parities; they share 64 bits with a key of 32.
PARITIES = 31
#: The form of the stored segments; an index of another form is refused.
LAYOUT = 2
#: Nodes that share a key and its block's parities and are paired with each other, at most; of more, leaders reject what is alike to them first.
HOT = 500
#: Links that one task may hold to settle what is open.
ALONE = 1_000_000
#: The arrival time, in microseconds, of documents without one.
LAST = (1 << 63) - 1
#: Keys of a batch that are looked up one by one, at most; and rows of a bucket that are held as a hash table, at most.
PROBED, HELD = 1_000, 4_000_000
#: Tasks that make the keys of a text, on average, from which on its keys are brought to one copy; below it the few copies cost less.
COPIES = 1.25
#: Bins of the profile that bounds an edit distance from below.
BINS = 64


def common_shingles(df: DataFrame, text: str, k: int, seed: int = 7) -> np.ndarray:
    """How often shingles fall into each of CELLS cells, in a random sample of about SAMPLE texts at most."""
    n = df.count()
    part = df.select(F.col(text).cast("string").alias("t")).where("t is not null")
    if n > SAMPLE:
        part = part.sample(fraction=SAMPLE / n, seed=seed)
    texts = [r.t for r in part.limit(2 * SAMPLE).collect()]
    counts = np.zeros(CELLS, np.int64)
    for _, some in near.slices(texts):
        flat, _, _ = near.flat_sets(some, k)
        counts += np.bincount((flat >> np.uint64(SHIFT)).astype(np.int64), minlength=CELLS)
    return np.minimum(counts, 255).astype(np.uint8)


def profiles(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each set its size, in four bytes, and how many of its shingles fall into each of BINS bins, at most 255."""
    size = np.diff(offsets)
    owner = np.repeat(np.arange(len(size)), size)
    bins = (flat & np.uint64(BINS - 1)).astype(np.int64)
    counts = np.bincount(owner * BINS + bins, minlength=len(size) * BINS).reshape(len(size), BINS)
    return np.concatenate((size.astype("<u4").view(np.uint8).reshape(len(size), 4), np.minimum(counts, 255).astype(np.uint8)), axis=1)


def in_reach(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether profiles allow a likeness of ``least``: the differences of the bins add up to no more than the edit distance, so nothing alike is lost."""
    sizes = x[:, :4].copy().view("<u4")[:, 0].astype(np.int64) + y[:, :4].copy().view("<u4")[:, 0].astype(np.int64)
    apart = np.abs(x[:, 4:].astype(np.int16) - y[:, 4:].astype(np.int16)).sum(axis=1, dtype=np.int64)
    return apart <= sizes * (1 - least) / (1 + least) + 1e-9


def segment_keys(flat: np.ndarray, offsets: np.ndarray, least: float, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, key, profile) of the segments to store and probe for each non-empty set of ``flat``; a key has its block's parities in its lower 32 bits.

    A string is laid out in its own length class and in each class that a string alike to it can be of.
    """
    size, part = np.diff(offsets), (1 - least) / (1 + least)
    longest = np.floor(size / least + 1e-9).astype(np.int64)
    first = np.searchsorted(TOPS, size)
    n = np.searchsorted(TOPS, longest) - first + 1
    owner = np.repeat(np.arange(len(size)), n)
    level = TOPS[first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)]
    blocks = np.floor(2 * level * part + 1e-9).astype(np.int64) // (APART + 1) + 1
    apart = np.floor((size[owner] + np.minimum(longest[owner], level)) * part + 1e-9).astype(np.int64) // blocks
    base = np.cumsum(blocks) - blocks  # blocks of all copies in a row
    lens = size[owner]
    start = np.concatenate(([0], np.cumsum(lens)))
    at = np.arange(start[-1]) - np.repeat(start[:-1] - offsets[owner], lens)
    values, copy = flat[at], np.repeat(np.arange(len(owner)), lens)
    with np.errstate(over="ignore"):
        slot = ((values >> np.uint64(32)) * (blocks * SLOTS)[copy].astype(np.uint64)) >> np.uint64(32)
        edge = np.flatnonzero(np.concatenate(([True], (slot[1:] != slot[:-1]) | (copy[1:] != copy[:-1])))[: len(slot)])
        content = np.add.reduceat(wh.mix(values), edge) if len(edge) else np.empty(0, np.uint64)
        seg_slot, seg_copy = slot[edge], copy[edge]
        block = base[seg_copy] + seg_slot.astype(np.int64) // SLOTS
        key = wh.mix(content ^ wh.mix(seg_slot + (level[seg_copy].astype(np.uint64) << np.uint64(32))))
        bits = np.uint64(1) << (((values & np.uint64(0xFFFFFFFF)) * np.uint64(PARITIES)) >> np.uint64(32))
        parity = np.zeros(blocks.sum(), np.uint64)
        opens = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))[: len(block)])
        if len(opens):
            parity[block[opens]] = np.bitwise_xor.reduceat(bits, edge[opens])
        rare = (16 - np.log2(counts[(values >> np.uint64(SHIFT)).astype(np.int64)] + 1.0)) * 4096
        telling = np.add.reduceat(rare.astype(np.int64), edge) if len(edge) else np.empty(0, np.int64)
        order = np.lexsort((key, -telling, block))
        have = np.bincount(block, minlength=len(parity))
        rank = np.arange(len(order)) - (np.cumsum(have) - have)[block[order]]
        whose = np.repeat(np.arange(len(owner)), blocks)
        keep = order[rank <= apart[whose[block[order]]]]
        keys, of = key[keep], block[keep]
        short = np.flatnonzero(have < apart[whose] + 1)
        if len(short):  # fewer segments of the block than needed hold anything: empty ones, in their order, fill up
            begin = np.searchsorted(block, short)
            more_k, more_o = [], []
            for g, i in zip(short.tolist(), begin.tolist()):
                c = whose[g]
                used = set(seg_slot[i : i + have[g]].tolist())
                from_ = int(g - base[c]) * SLOTS
                empty = [x for x in range(from_, from_ + SLOTS) if x not in used][: int(apart[c] + 1 - have[g])]
                more_k.append(wh.mix(wh.mix(np.asarray(empty, np.uint64) + (level[c].astype(np.uint64) << np.uint64(32)))))
                more_o.append(np.full(len(empty), g))
            keys, of = np.concatenate([keys, *more_k]), np.concatenate([of, *more_o])
        keys = (keys & np.uint64(0xFFFFFFFF00000000)) | parity[of]
    owners = owner[whose[of]]
    order = np.argsort(owners, kind="stable")
    return owners[order], keys[order].view(np.int64), profiles(flat, offsets)


def _close(x: str, y: str):
    """Whether the parities of two blocks allow the distance; nothing in reach is lost."""
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= APART


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, verdict) of every open node from all links (early, late, ev) to open nodes, one node after another."""
    verdict, before, after = {}, defaultdict(list), defaultdict(list)
    for pdf in batches:
        for early, late, ev in zip(pdf["early"].tolist(), pdf["late"].tolist(), pdf["ev"].tolist()):
            if isinstance(ev, str):
                verdict[early] = ev
            before[late].append(early)
            after[early].append(late)
    waits = {late: sum(e not in verdict for e in some) for late, some in before.items()}
    ready, done = [node for node in {*before, *after} if node not in verdict and not waits.get(node)], []
    while ready:
        node = ready.pop()
        verdict[node] = "out" if any(verdict[e] == "in" for e in before[node]) else "in"
        done.append(node)
        for late in after[node]:
            waits[late] -= 1
            if not waits[late]:
                ready.append(late)
    yield pd.DataFrame({"node": np.asarray(done, np.int64), "verdict": pd.Series([verdict[n] for n in done], dtype=object)})


def _decide(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, verdict) of ``nodes`` (node, accepted) in arrival order: 'in' if accepted before or unless an earlier 'in' is linked.

    links: (early, late), early arrives first. As soon as the links to open nodes are no more
    than ALONE, one task settles them. Before, each round of joins settles every node whose
    earlier neighbours are settled, and every neighbour of a node accepted; the earliest open
    node is always settled, so it ends.
    """
    state = nodes.select("node", F.when(F.col("accepted"), "in").alias("verdict"))
    while True:
        known = state.select(F.col("node").alias("early"), F.col("verdict").alias("ev"))
        rest = links.join(state.where("verdict is null").select(F.col("node").alias("late")), "late").join(known, "early").select("early", "late", "ev")
        if links.limit(ALONE + 1).count() <= ALONE or rest.limit(ALONE + 1).count() <= ALONE:
            last = rest.repartition(1).mapInPandas(_settle, "node long, verdict string").withColumnRenamed("verdict", "last")
            return cut(state.join(last, "node", "left").select("node", F.coalesce("verdict", "last", F.lit("in")).alias("verdict")))
        seen = links.join(known, "early").groupBy("late").agg(F.max(F.col("ev") == "in").alias("hit"), F.sum(F.col("ev").isNull().cast("int")).alias("open"))
        state = cut(
            state.join(seen, state["node"] == seen["late"], "left").select(
                "node",
                F.when(F.col("verdict").isNotNull(), F.col("verdict")).when(F.coalesce("hit", F.lit(False)), "out").when(F.coalesce("open", F.lit(0)) == 0, "in").alias("verdict"),
            )
        )


def _pairs(probes: DataFrame, firsts: DataFrame, out: DataFrame) -> DataFrame:
    """(a, b), a < b: nodes that share a key, but for pairs whose earlier node is in ``out``: it is rejected and can't reject."""
    gone = F.coalesce("gone", F.lit(False))
    known = probes.join(firsts.select("node", "first"), "node").join(out.select("node", F.lit(True).alias("gone")), "node", "left").select("key", "parity", F.struct("first", "node").alias("o"), "node", gone.alias("gone"))
    x = known.where(~F.col("gone")).select("key", F.col("parity").alias("px"), F.col("o").alias("ox"), F.col("node").alias("x"))
    y = known.select("key", F.col("parity").alias("py"), F.col("o").alias("oy"), F.col("node").alias("y"))
    return x.join(y, "key").where(_close("px", "py")).where("ox < oy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _peel(probes: DataFrame, firsts: DataFrame, out: DataFrame, verify: Callable[[DataFrame], DataFrame], *, hot: int, most: int = 100) -> DataFrame:
    """(node): ``out``, what is rejected already, and nodes of hot keys that an accepted node surely rejects, found without pairing the nodes of a hot key with each other.

    Of every block, a key with its parities, with over ``hot`` open nodes the earliest one leads; nodes that share a key by chance have other parities. Leaders are settled by
    what they depend on alone: their earlier alike nodes that aren't in ``out``, those of these, and so on. The
    nodes of the key alike to an accepted leader are rejected; a leader settled is not open
    any more. A family of alike texts is gone after a round, whatever its size; keys that stay hot
    lose their leaders, one a round, up to ``most`` rounds, and what is left is paired in full.
    """
    led = probes.sparkSession.createDataFrame([], "node long")
    placed = probes.join(firsts.select("node", "first"), "node").select("key", "parity", "node", F.struct("first", "node").alias("o"))
    for _ in range(most):
        alive = placed.join(out, "node", "left_anti")  # what is rejected, by history or here, can't reject a leader
        open_ = alive.join(led, "node", "left_anti")
        lead = cut(open_.groupBy("key", "parity").agg(F.count("*").alias("n"), F.min("o").alias("lead")).where(F.col("n") > hot).select("key", F.col("parity").alias("px"), "lead"))
        if not lead.limit(1).count():
            break
        leaders = cut(lead.select(F.col("lead.node").alias("node")).distinct())
        # what the leaders depend on: earlier nodes of their keys that are alike, then theirs
        seen, todo, edges = leaders, leaders, None
        while todo.limit(1).count():
            mine = alive.join(todo, "node", "left_semi").select("key", F.col("parity").alias("py"), F.col("o").alias("oy"), F.col("node").alias("y"))
            met = mine.join(alive.select("key", F.col("parity").alias("px"), F.col("o").alias("ox"), F.col("node").alias("x")), "key").where(_close("px", "py")).where("ox < oy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
            alike = verify(cut(met)).select("a", "b")
            new = cut(near.ends(alike).join(seen, "node", "left_anti"))
            edges = cut(alike if edges is None else edges.union(alike).distinct())
            seen, todo = cut(seen.union(new)), new
        order = firsts.select("node", F.struct("first", "node").alias("o"))
        directed = edges.join(order.select(F.col("node").alias("a"), F.col("o").alias("oa")), "a").join(order.select(F.col("node").alias("b"), F.col("o").alias("ob")), "b")
        directed = cut(directed.select(F.when(F.col("oa") < F.col("ob"), F.col("a")).otherwise(F.col("b")).alias("early"), F.when(F.col("oa") < F.col("ob"), F.col("b")).otherwise(F.col("a")).alias("late")))
        settled = _decide(seen.select("node", F.lit(False).alias("accepted")), directed)
        accepted = leaders.join(settled.where("verdict = 'in'"), "node", "left_semi")
        star = alive.join(lead, "key").where(_close("px", "parity")).where("o > lead").select(F.col("lead.node").alias("x"), F.col("node").alias("y")).join(accepted.withColumnRenamed("node", "x"), "x", "left_semi")
        alike = verify(cut(star.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())).select("a", "b")
        hit = near.ends(alike).join(accepted, "node", "left_anti").union(settled.where("verdict = 'out'").select("node"))
        out, led = cut(out.union(hit).distinct()), cut(led.union(leaders).distinct())
    return out


class History:
    """The accepted documents so far: a segment index in a folder that all executors share.

    ``segments`` has (key, parity, node), in buckets by key; ``arrivals`` (node, at, doc_id, mark) of the
    earliest copy of each accepted text; ``texts`` (doc_id, text, at) of all documents that came. A batch is laid out by
    key once and meets the stored buckets where they lie: history is neither hashed, nor
    sorted, nor shuffled again. A batch of few keys reads only the buckets, and of
    them the parts, that can have its keys. Of arrivals and texts only those of candidates leave the scan.

    ``settings`` has the parameters and the shingle frequencies that choose a text's segments, so
    a folder opened again goes on as before; other parameters than its own are refused. Each
    batch is a part of its own and counts once its mark in ``batches`` is there; a part
    that broke off is written anew.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *, least: float = 0.8, k: int = 3, hot: int = HOT) -> None:
        self.spark, self.least, self.k, self.hot = spark, least, k, hot
        self.path = path or f"{shared_dir(spark).rstrip('/')}/history-{uuid.uuid4().hex}"
        self.batches, self.buckets = 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.counts: np.ndarray | None = None
        while self._marked(self.batches):
            self.batches += 1
        if self.batches:
            kept = spark.read.parquet(f"{self.path}/settings").first()
            if (kept.least, kept.k) != (least, k):
                raise ValueError(f"the index in {self.path} was made with least={kept.least}, k={kept.k}")
            if kept.asDict().get("layout") != LAYOUT:
                raise ValueError(f"the index in {self.path} was made by another version")
            self.counts, self.buckets = np.frombuffer(bytes(kept.counts), np.uint8), kept.buckets

    def _file(self, name: str):
        """(file system, path) of a file or folder of the index."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _marked(self, batch: int) -> bool:
        files, path = self._file(f"batches/{batch}")
        return files.exists(path)

    def remove(self) -> None:
        """Deletes the index."""
        files, path = self._file("")
        files.delete(path, True)

    def _read(self, name: str) -> DataFrame:
        """A table of the index, without parts of batches that broke off."""
        return self.spark.read.parquet(*(f"{self.path}/{name}/batch={i}" for i in range(self.batches)))

    def _segments(self) -> tuple[str, DataFrame]:
        """(name in the catalog, rows) of the stored segments, known to lie in buckets by key."""
        name = f"segments_{uuid.uuid4().hex}"
        self.spark.sql(f"create table {name} (key bigint, parity int, node bigint, batch int) using parquet partitioned by (batch) clustered by (key) into {self.buckets} buckets location '{self.path}/segments'")
        self.spark.sql(f"alter table {name} add if not exists " + " ".join(f"partition (batch={i})" for i in range(self.batches)))
        return name, self.spark.table(name).select("key", "parity", "node")

    def meeting(self, own: DataFrame, segments: DataFrame) -> DataFrame:
        """(a, b): nodes of ``own`` (key, node), laid out in the index's buckets, and stored nodes that share a key; of blocks too far apart only if ``own`` has no parities."""
        n = own.count()
        if n <= PROBED:
            segments = segments.where(F.col("key").isin([r.key for r in own.select("key").collect()]))
        near_by = "parity" in own.columns
        mine = own.select("key", F.col("node").alias("a"), *([F.col("parity").alias("pa")] if near_by else []))
        if n <= HELD * self.buckets:
            mine = mine.hint("shuffle_hash")
        met = segments.select("key", "parity", F.col("node").alias("b")).join(mine, "key")
        return (met.where(_close("pa", "parity")) if near_by else met).select("a", "b").distinct()

    def check(self, batch: DataFrame, row_id: str = "doc_id", text: str = "text", at: str = "ingested_at", *, append: bool = True) -> DataFrame:
        """(doc_id, twin): the rejected documents of the batch, each with the earliest accepted document it is alike to.

        Documents arrive by ``at``, then ``row_id``; a null time arrives last. All of a batch
        arrive after the batches before it. Null and blank texts and texts without a shingle
        (fewer than k words) are left out: neither rejected nor indexed. Ties in time go by
        id; a row given twice counts once; an empty batch gives an empty result; other columns
        are ignored. With ``append`` the accepted documents join the index.
        """
        if self.counts is None:
            self.counts = common_shingles(batch, text, self.k)
        counts, least = self.spark.sparkContext.broadcast(self.counts), self.least
        when = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(LAST))
        texts = batch.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), when.alias("at")).where("doc_id is not null and text is not null")
        if append:  # the batch's texts are copied once, and read from there
            texts.write.mode("overwrite").parquet(f"{self.path}/texts/batch={self.batches}")
            texts = self.spark.read.parquet(f"{self.path}/texts/batch={self.batches}")
        rows = near.kept(near.keyed(texts, "doc_id", "text", k=self.k, least_words=1, at=F.col("at"), maker=lambda flat, offsets: segment_keys(flat, offsets, least, counts.value)))
        nodes = cut(rows.groupBy("node").agg(F.min(F.struct("at", F.col("doc_id").alias("id"))).alias("first"), F.max("mark").alias("mark"), F.sum((F.size("keys") > 0).cast("long")).alias("made")))
        both = rows.select(F.explode("keys").alias("both"), "node")
        own = both.select(F.shiftright("both", 32).alias("key"), F.col("both").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("parity"), "node").repartition(self.buckets, "key")
        if (nodes.agg(F.avg("made")).first()[0] or 0) > COPIES:
            own = own.distinct()
        own = near.kept(own)
        firsts = nodes.select("node", "first", "mark", F.lit(False).alias("accepted"))
        met = None
        if self.batches:
            name, segments = self._segments()
            met = cut(self.meeting(own, segments))
            release(self.spark)
            self.spark.sql(f"drop table {name}")
            asked = cut(met.select(F.col("b").alias("node")).distinct())
            old = self._read("arrivals").join(near.small(asked), "node").select("node", F.struct("at", F.col("doc_id").alias("id")).alias("first"), "mark", F.lit(True).alias("accepted"))
            # an accepted text that arrives again is the accepted one
            firsts = cut(firsts.union(old).groupBy("node").agg(F.max("accepted").alias("accepted"), F.max_by("first", "accepted").alias("first"), F.max("mark").alias("mark")))
            met = met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

        def verify(pairs: DataFrame) -> DataFrame:
            """The pairs that are alike, by profile and then exactly."""
            close = cut(near.promising(pairs, firsts, lambda x, y: in_reach(x, y, least)))
            wanted = near.small(cut(near.ends(close).join(firsts, "node").select("node", F.col("first.id").alias("doc_id"), "accepted")))
            picked = texts.join(wanted.where("not accepted"), "doc_id").select("node", "text")
            if self.batches:
                picked = picked.union(self._read("texts").join(wanted.where("accepted"), "doc_id").select("node", "text"))
            return cut(near.alike(close, near.hashed(picked, "text", self.k), least))

        probes = cut(near.met(own, "parity"))
        hottest = probes.groupBy("key", "parity").count().agg(F.max("count")).first()[0] or 0
        if hottest > self.hot:
            out, known = self.spark.createDataFrame([], "node long"), None
            if met is not None:  # what history rejects can't reject anything
                known = verify(met).select("a", "b")
                out = cut(near.ends(known).join(firsts.where("not accepted"), "node", "left_semi"))
            links = verify(_pairs(probes, firsts, _peel(probes, firsts, out, verify, hot=self.hot))).select("a", "b")
            links = links if known is None else cut(links.union(known).distinct())
        else:
            pairs = probes.select("key", F.col("parity").alias("pa"), F.col("node").alias("a")).join(probes.select("key", F.col("parity").alias("pb"), F.col("node").alias("b")), "key").where(_close("pa", "pb")).where("a < b").select("a", "b").distinct()
            links = verify(pairs if met is None else pairs.union(met).distinct()).select("a", "b")

        release(self.spark)
        order = firsts.select("node", F.struct(~F.col("accepted"), "first", "node").alias("o"), "accepted")
        x, y = (order.select(F.col("node").alias(v), F.col("o").alias(f"o{v}")) for v in "ab")
        ordered = cut(links.join(x, "a").join(y, "b").select(F.when(F.col("oa") < F.col("ob"), F.col("a")).otherwise(F.col("b")).alias("early"), F.when(F.col("oa") < F.col("ob"), F.col("b")).otherwise(F.col("a")).alias("late")))
        verdicts = _decide(near.ends(links).join(firsts.select("node", "accepted"), "node"), ordered)
        accepted = order.join(verdicts.where("verdict = 'in'"), "node").select(F.col("node").alias("early"), F.struct(~F.col("accepted"), "o.first").alias("by"))
        twins = ordered.join(accepted, "early").join(verdicts.where("verdict = 'out'").select(F.col("node").alias("late")), "late").groupBy(F.col("late").alias("node")).agg(F.min("by").alias("by"))
        twins = cut(twins.select("node", F.col("by.first").alias("twin")))

        near_copies = rows.select("doc_id", "node").join(twins, "node").select("doc_id", F.col("twin.id").alias("twin"))
        again = firsts.select("node", "first").join(twins, "node", "left_anti")
        exact = rows.select("doc_id", "node").join(again, "node").where(F.col("doc_id") != F.col("first.id")).select("doc_id", F.col("first.id").alias("twin"))
        found = cut(near_copies.union(exact).distinct()).withColumnRenamed("doc_id", row_id)
        if append:
            self._append(own, firsts, twins)
        for df in (own, rows):
            df.unpersist()
        return found

    def _append(self, own: DataFrame, firsts: DataFrame, twins: DataFrame) -> None:
        """Adds the accepted nodes of the batch; their keys stay in the buckets they lie in."""
        part = f"batch={self.batches}"
        if not self.batches:
            settings = [(self.least, self.k, self.buckets, LAYOUT, self.counts.tobytes())]
            self.spark.createDataFrame(settings, "least double, k int, buckets int, layout int, counts binary").write.mode("overwrite").parquet(f"{self.path}/settings")
        gone = near.small(cut(twins.select("node").union(firsts.where("accepted").select("node"))))
        name = f"part_{uuid.uuid4().hex}"
        own.join(gone, "node", "left_anti").select("key", "parity", "node").write.bucketBy(self.buckets, "key").option("compression", "zstd").option("path", f"{self.path}/segments/{part}").mode("overwrite").saveAsTable(name)
        self.spark.sql(f"drop table {name}")
        new = firsts.join(gone, "node", "left_anti").select("node", F.col("first.at").alias("at"), F.col("first.id").alias("doc_id"), "mark")
        new.write.mode("overwrite").parquet(f"{self.path}/arrivals/{part}")
        files, mark = self._file(f"batches/{self.batches}")
        files.create(mark).close()
        self.batches += 1


def rejected(documents: DataFrame, *, parts: int = 4, least: float = 0.8, k: int = 3, at: str = "ingested_at", path: str | None = None) -> DataFrame:
    """(doc_id, twin) of every document rejected when all arrive in order, in ``parts`` batches of about one size by ``at``.

    Each batch is checked against the index of all accepted before it, opened again for the
    batch, and its accepted documents are appended. The index goes to ``path`` and stays; without
    a path it is deleted at the end.
    """
    spark = documents.sparkSession
    folder = path or f"{shared_dir(spark).rstrip('/')}/history-{uuid.uuid4().hex}"
    when = F.unix_micros(F.col(at).cast("timestamp"))
    edges = documents.select(when.cast("double").alias("t")).approxQuantile("t", [i / parts for i in range(1, parts)], 0.01) if parts > 1 else []
    edges = sorted({int(e) for e in edges})
    number = sum((F.coalesce(when > e, F.lit(True)).cast("int") for e in edges), F.lit(0))
    found = []
    for i in range(len(edges) + 1):
        found.append(History(spark, folder, least=least, k=k).check(documents.where(number == i), at=at))
        release(spark)
    if path is None:
        History(spark, folder, least=least, k=k).remove()
    return reduce(DataFrame.union, found)

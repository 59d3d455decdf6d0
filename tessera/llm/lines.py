"""Problem 3: lines repeated across one source's documents, and texts without them.

Lines are normalized to their letters, lower-cased, and hashed; distinct documents per
source and hash are counted in two steps, each aggregated before it is shuffled; the
threshold is a share of the source's documents; the frequent hashes are joined back to the
lines. All of it is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.near import kept


def text_lines(passages: DataFrame) -> DataFrame:
    """(document_id, passage_id, line_no, h): the lines with letters of each passage, from 1, by the hash of their letters."""
    rows = passages.select(F.col("document_id").cast("long").alias("document_id"), F.col("passage_id").cast("long").alias("passage_id"), F.split(F.col("text").cast("string"), "\n", -1).alias("lines"))
    each = rows.select("document_id", "passage_id", F.posexplode("lines").alias("at", "line"))
    letters = F.regexp_replace(F.lower("line"), r"[^\p{L}]+", "")
    return each.select("document_id", "passage_id", (F.col("at") + 1).alias("line_no"), letters.alias("letters")).where("letters <> ''").select("document_id", "passage_id", "line_no", F.xxhash64("letters").alias("h"))


def repeated_lines(passages: DataFrame, documents: DataFrame, *, least_documents: int = 3, least_share: float = 0.05) -> DataFrame:
    """(passage_id, line_no) of each line that occurs in at least ``least_documents`` documents and ``least_share`` of all documents of its source.

    Lines are split at line feeds and counted from 1. Lines without letters never count. A
    null source is a source of its own; documents count by distinct doc_id, with or without
    text; passages of unknown documents, null and empty texts give no row; repeated rows
    count once; empty tables give an empty result; other columns are ignored.
    """
    sources = documents.select(F.col("doc_id").cast("long").alias("document_id"), F.col("source").cast("string").alias("source")).where("document_id is not null").distinct()
    totals = sources.groupBy("source").agg(F.count_distinct("document_id").alias("total"))
    lines = kept(text_lines(passages).join(sources, "document_id"))
    per = lines.select("source", "h", "document_id").distinct().groupBy("source", "h").agg(F.count("*").alias("n")).where(F.col("n") >= least_documents)
    shares = per.join(totals, per["source"].eqNullSafe(totals["source"])).where(F.col("n") >= F.col("total") * F.lit(least_share) - F.lit(1e-9))
    frequent = shares.select(per["source"].alias("source"), "h")
    hit = lines.join(frequent, lines["source"].eqNullSafe(frequent["source"]) & (lines["h"] == frequent["h"]), "left_semi")
    return hit.select("passage_id", "line_no").distinct()


def without_lines(passages: DataFrame, removed: DataFrame) -> DataFrame:
    """(passage_id, text, n_removed): each passage once, its text rebuilt without the lines of ``removed`` (passage_id, line_no)."""
    gone = removed.groupBy(F.col("passage_id").alias("gone_id")).agg(F.collect_set("line_no").alias("gone"))
    once = passages.select(F.col("passage_id").cast("long").alias("passage_id"), F.col("text").cast("string").alias("text")).dropDuplicates(["passage_id"])
    left = F.filter(F.split("text", "\n", -1), lambda line, at: ~F.array_contains(F.col("gone"), at + 1))
    out = once.join(gone, once["passage_id"] == gone["gone_id"], "left")
    return out.select("passage_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))

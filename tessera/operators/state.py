"""Append-only logs as current state: latest entry wins, partial updates, tombstones, memoised work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by ``order``, all columns kept. One shuffle; rows other than the best so far are dropped before it."""
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("last"))
    return best.select(*keys, *[F.col("last")[c].alias(c) for c in rest])


def folded(log: DataFrame, keys: list[str], order: list[Column], fields: list[str]) -> DataFrame:
    """Per key each field's last value that was set; null means not set. Rows whose fields all stay unset are gone."""
    by = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    out = log.groupBy(*keys).agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), by)).alias(f) for f in fields])
    return out.where(F.coalesce(*[F.col(f).cast("string") for f in fields]).isNotNull())


def merged_answers(log: DataFrame, keys: list[str], *, part: str = "part", answers: str = "answers", order: list[Column]) -> DataFrame:
    """(keys, answers): the newest answers of each part, merged in part order, a later part winning."""
    newest = latest(log.select(*keys, part, answers, *[o.alias(f"_o{i}") for i, o in enumerate(order)]), [*keys, part], [F.col(f"_o{i}") for i in range(len(order))])
    parts = newest.where(F.col(part).isNotNull()).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(part), F.map_entries(answers)))).alias("parts"))  # a key has a few parts
    entries = F.flatten(F.transform(F.array_sort(F.map_keys("parts")), lambda p: F.col("parts")[p]))
    last = F.aggregate(entries, F.create_map().cast(log.schema[answers].dataType), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.map_from_entries(F.array(e))))
    return parts.select(*keys, last.alias(answers))


def all_present(wanted: DataFrame, log: DataFrame, *, id_: str, keys: str, key: str, done: Column) -> DataFrame:
    """(id, n): the rows of ``wanted`` whose every listed key has a finished entry (relational division)."""
    each = wanted.select(id_, F.explode(F.array_distinct(keys)).alias(key))
    have = log.where(done).select(id_, key).distinct().withColumn("there", F.lit(1))
    counted = each.join(have, [id_, key], "left").groupBy(id_).agg(F.count("*").alias("n"), F.count("there").alias("found"))
    return counted.where("n = found").select(id_, "n")


def pending(requests: DataFrame, log: DataFrame, keys: list[str], settled: Column) -> DataFrame:
    """The requests without a settled entry in the log."""
    return requests.join(log.where(settled).select(*keys).distinct(), keys, "left_anti")


def neighbours(rows: DataFrame, group: str, order: list[str], id_: str, text: str) -> DataFrame:
    """(id, previous_id, next_id, context): what stands before and after each row in its group."""
    by = Window.partitionBy(group).orderBy(*order)
    return rows.select(id_, F.lag(id_).over(by).alias("previous_id"), F.lead(id_).over(by).alias("next_id"), F.lag(text).over(by).alias("context"))


def upsert(state: DataFrame, changes: DataFrame, keys: list[str], *, deleted: Column | None = None) -> DataFrame:
    """``state`` with the rows of ``changes`` put in place of those with the same keys; rows marked ``deleted`` are taken out."""
    kept = state.join(changes.select(*keys).distinct(), keys, "left_anti")
    new = changes if deleted is None else changes.where(~F.coalesce(deleted, F.lit(False)))
    return kept.unionByName(new.select(*state.columns))

"""Series of reported figures with guidance and estimates, by metric and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.dates import granularity, period_order


def middle(value: Column, high: Column) -> Column:
    """The middle of a range, or the value."""
    return (value + F.coalesce(high, value)) / 2


def compared(value: Column, low: Column, high: Column) -> Column:
    """'above', 'below' or 'within' a range."""
    return F.when(value > high, "above").when(value < low, "below").otherwise("within")


def tolerance(unit: Column, reference: Column) -> Column:
    """What counts as in line: 0.1 points for percentages, else half a percent of the reference."""
    return F.when(unit.isin("%", "percent", "pct"), F.lit(0.1)).otherwise(F.abs(reference) * 0.005)


def best_per_period(points: DataFrame, keys: list[str], ranks: list[Column]) -> DataFrame:
    """The best point of each metric and period by ``ranks``, the greatest first."""
    rest = [c for c in points.columns if c not in keys]
    got = points.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[r.alias(f"r{i}") for i, r in enumerate(ranks)])).alias("best"))
    return got.select(*keys, *[F.col("best")[c].alias(c) for c in rest])


def with_change(reported: DataFrame, keys: list[str], period: str = "period_key", value: str = "value", higher_is: str = "higher_is") -> DataFrame:
    """Each period with the previous one of the same grain, the change, and whether it is good, bad or flat."""
    by = Window.partitionBy(*keys, "grain").orderBy(period_order(F.col(period)))
    out = reported.withColumn("grain", granularity(F.col(period))).withColumn("previous", F.lag(value).over(by)).withColumn("change", F.round(F.col(value) - F.col("previous"), 6))
    rising = F.when(F.col("change") > 0, "good").when(F.col("change") < 0, "bad").otherwise("flat")
    falling = F.when(F.col("change") > 0, "bad").when(F.col("change") < 0, "good").otherwise("flat")
    return out.withColumn("direction", F.when(F.col("change").isNull(), None).when(F.col(higher_is) == "bad", falling).otherwise(rising))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, order: str) -> DataFrame:
    """``left`` with the last ``value`` of ``right`` at or before its time: an as-of join as one union and one window.

    Nothing is multiplied: each side's rows appear once. Of equal times the greatest ``order`` is last.
    """
    cols = [c for c in left.columns if c not in (*keys, at)]
    a = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[order].dataType).alias("_order"), F.lit(None).cast(right.schema[value].dataType).alias(value), F.struct(*cols).alias("_row"))
    b = right.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(order).alias("_order"), value, F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    by = Window.partitionBy(*keys).orderBy("_at", "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn(f"asof_{value}", F.last(value, ignorenulls=True).over(by)).where("_side = 1")
    return both.select(*keys, F.col("_at").alias(at), *[F.col("_row")[c].alias(c) for c in cols], f"asof_{value}")


def revision(points: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, change): how the last of the revisions differs from the one before: raised, lowered, narrowed, widened, maintained, or first."""
    by = Window.partitionBy(*keys).orderBy(*order)
    back = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    mid, width = middle(F.col("value"), F.col("high")), F.coalesce("high", "value") - F.col("value")
    last = points.withColumn("mid", mid).withColumn("width", width).withColumn("was_mid", F.lag("mid").over(by)).withColumn("was_width", F.lag("width").over(by)).withColumn("back", F.row_number().over(back)).where("back = 1")
    change = F.when(F.col("was_mid").isNull(), "first").when(F.col("mid") > F.col("was_mid"), "raised").when(F.col("mid") < F.col("was_mid"), "lowered").when(F.col("width") < F.col("was_width"), "narrowed").when(F.col("width") > F.col("was_width"), "widened").otherwise("maintained")
    return last.select(*keys, change.alias("change"))


#: Sources of reported figures, the most telling first; any other comes after them (fixed values).
SOURCES = ("filing", "earnings_transcript")


def report(points: DataFrame, keys: list[str], *, order: str = "mention_id") -> DataFrame:
    """(keys, reported, n_guidance, n_estimates, vs_guidance, vs_estimates, guidance_change): each metric and period in one row.

    points: keys, kind ('reported', 'guidance', 'estimate'), day, value, high, unit, source_type, p
    and ``order``, which settles ties. The reported figure is that of the best source, then the
    likeliest, then the newest. It is compared with the last guidance and the mean of the estimates
    up to its day; a null day is before all others. A comparison without both sides is null, as is the
    change of guidance given once. Figures are the middle of their range. Points without a
    value count for nothing.
    """
    first = F.coalesce(F.col("day"), F.lit("0001-01-01").cast("date"))
    rank = F.coalesce(*[F.when(F.col("source_type") == s, F.lit(-i)) for i, s in enumerate(SOURCES)], F.lit(-len(SOURCES)))
    known = points.where("value is not null").withColumn("day", first).withColumn("mid", middle(F.col("value"), F.col("high")))
    best = best_per_period(known.where("kind = 'reported'").select(*keys, "day", "mid", "p", "source_type", order), keys, [rank, F.coalesce("p", F.lit(0.0)), F.col("day"), F.col(order)])
    met = known.join(best.select(*keys, F.col("day").alias("on"), F.col("mid").alias("reported")), keys, "left")
    before = F.col("day") <= F.col("on")
    guided, guessed, when = F.col("kind") == "guidance", F.col("kind") == "estimate", F.struct("day", order)
    per = met.groupBy(*keys).agg(
        F.first("reported").alias("reported"),
        F.count_if(guided).alias("n_guidance"),
        F.count_if(guessed).alias("n_estimates"),
        F.max_by(F.struct("value", F.coalesce("high", "value").alias("high")), F.when(guided & before, when)).alias("g"),
        F.avg(F.when(guessed & before, F.col("mid"))).alias("mean"),
        F.first("unit").alias("unit"),
    )
    value, gap = F.col("reported"), F.col("reported") - F.col("mean")
    in_line = F.abs(gap) <= tolerance(F.lower(F.trim("unit")), F.col("mean"))
    per = per.withColumn("vs_guidance", F.when(value.isNotNull() & F.col("g").isNotNull(), compared(value, F.col("g.value"), F.col("g.high"))))
    per = per.withColumn("vs_estimates", F.when(gap.isNull(), None).when(in_line, "in_line").when(gap > 0, "above").otherwise("below"))
    change = revision(known.where("kind = 'guidance'").select(*keys, "day", order, "value", "high"), keys, ["day", order])
    change = change.select(*keys, F.nullif("change", F.lit("first")).alias("guidance_change"))
    return per.join(change, keys, "left").select(*keys, "reported", "n_guidance", "n_estimates", "vs_guidance", "vs_estimates", "guidance_change")

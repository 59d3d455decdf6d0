"""How well scores agree with labels: weighted precision and recall, thresholds, reliability, intervals, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_W = F.col


def _share(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a, b), 6)


def _decimal(c: str) -> Column:
    return F.col(c).cast("decimal(18,6)")


def _kish(keep: Column) -> Column:
    """Effective sample size: the square of the weights' sum over the sum of their squares."""
    w, square = F.sum(F.when(keep, _decimal("weight"))).cast("double"), F.sum(F.when(keep, (_decimal("weight") * _decimal("weight")).cast("decimal(30,10)"))).cast("double")
    return F.round(F.coalesce(F.try_divide(w * w, square), F.lit(0.0)), 6)


def _total(keep: Column) -> Column:
    return F.coalesce(F.sum(F.when(keep, _decimal("weight"))).cast("double"), F.lit(0.0))


def at_thresholds(pairs: DataFrame, grid: list[float], by: list[str] | None = None) -> DataFrame:
    """(.., threshold, precision, recall, flagged, positives, n_flagged, n_positives) for every threshold of ``grid``.

    pairs: (signal, label, weight). One aggregation: each pair is expanded over the grid, a fixed
    few rows, and combined before the shuffle. Nothing flagged or no positives: null.
    """
    by = by or []
    each = pairs.withColumn("threshold", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    hit = F.col("signal") >= F.col("threshold")
    out = each.groupBy(*by, "threshold").agg(_total(hit & F.col("label")).alias("tp"), _total(hit).alias("flagged"), _total(F.col("label")).alias("positives"), _kish(hit).alias("n_flagged"), _kish(F.col("label")).alias("n_positives"))
    return out.select(*by, "threshold", _share(F.col("tp"), F.col("flagged")).alias("precision"), _share(F.col("tp"), F.col("positives")).alias("recall"), "flagged", "positives", "n_flagged", "n_positives")


def select_thresholds(pairs: DataFrame, grid: list[float], *, precision: float = 0.8, recall: float = 0.9, by: list[str] | None = None) -> DataFrame:
    """(.., for_precision, for_recall): the lowest threshold that reaches the precision, the highest that reaches the recall; null if none does."""
    m = at_thresholds(pairs, grid, by)
    return m.groupBy(*(by or [])).agg(F.min(F.when(F.col("precision") >= precision, F.col("threshold"))).alias("for_precision"), F.max(F.when(F.col("recall") >= recall, F.col("threshold"))).alias("for_recall"))


def reliability(pairs: DataFrame, buckets: int = 5) -> DataFrame:
    """(bucket, low, high, predicted, observed, n): weighted mean score and share of positives in equal bands; the last one includes 1."""
    band = F.least(F.floor(F.col("signal") * buckets), F.lit(buckets - 1)).cast("int")
    w = _decimal("weight")
    out = pairs.where("signal is not null").groupBy(band.alias("bucket")).agg(
        _share(F.sum((w * _decimal("signal")).cast("decimal(30,10)")).cast("double"), F.sum(w).cast("double")).alias("predicted"), _share(F.coalesce(F.sum(F.when(F.col("label"), w)).cast("double"), F.lit(0.0)), F.sum(w).cast("double")).alias("observed"), F.count("*").alias("n"), F.sum(w).cast("double").alias("weight")
    )
    return out.select("bucket", (F.col("bucket") / buckets).alias("low"), ((F.col("bucket") + 1) / buckets).alias("high"), "predicted", "observed", "n", "weight")


def errors(pairs: DataFrame, buckets: int = 10, sure: float = 0.9) -> DataFrame:
    """(brier, ece, sure_but_no, unsure_but_yes): weighted squared error, calibration error over bands, and confident mistakes; one row."""
    w = _decimal("weight")
    miss = F.pow(F.col("signal") - F.col("label").cast("int"), 2).cast("decimal(18,10)")
    whole = pairs.agg(_share(F.sum((w * miss).cast("decimal(36,16)")).cast("double"), F.sum(w).cast("double")).alias("brier"), F.count_if((F.col("signal") >= sure) & ~F.col("label")).alias("sure_but_no"), F.count_if((F.col("signal") <= F.round(F.lit(1 - sure), 6)) & F.col("label")).alias("unsure_but_yes"))
    bands = reliability(pairs, buckets)
    ece = bands.agg(F.round(F.try_divide(F.sum((F.col("weight") * F.abs(F.col("predicted") - F.col("observed"))).cast("decimal(30,10)")).cast("double"), F.sum("weight")), 6).alias("ece"))
    return whole.crossJoin(F.broadcast(ece)).select("brier", "ece", "sure_but_no", "unsure_but_yes")


def wilson(successes: Column, total: Column, z: float = 1.96) -> Column:
    """(low, high) of the Wilson interval, within 0..1; null for an empty sample."""
    p = F.try_divide(successes.cast("double"), total.cast("double"))
    denominator = 1 + z * z / total
    middle = (p + z * z / (2 * total)) / denominator
    half = z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / denominator
    return F.when(total > 0, F.struct(F.round(F.greatest(F.lit(0.0), middle - half), 6).alias("low"), F.round(F.least(F.lit(1.0), middle + half), 6).alias("high")))


def stratified_sample(rows: DataFrame, id_: str, flagged: str, *, n: int, seed: int = 0) -> DataFrame:
    """(id, flagged, weight): half of ``n`` from the flagged rows, the rest from the others, each weighted by stratum over sample size.

    The draw is by the SHA-256 of seed and id, so it is the same on any layout; if one stratum is too
    small the other makes up for it. This is a sampling operator: the limit is its feature.
    """
    order = Window.partitionBy(flagged).orderBy("draw", id_)
    drawn = rows.select(id_, F.coalesce(F.col(flagged), F.lit(False)).alias(flagged)).distinct().withColumn("draw", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id_).cast("string")), 256))
    sizes = drawn.groupBy(flagged).agg(F.count("*").alias("size"))
    placed = drawn.withColumn("place", F.row_number().over(order))
    both = sizes.agg(F.coalesce(F.max(F.when(F.col(flagged), F.col("size"))), F.lit(0)).alias("yes"), F.coalesce(F.max(F.when(~F.col(flagged), F.col("size"))), F.lit(0)).alias("no"))
    yes = F.least("yes", F.greatest(F.lit(n // 2), F.lit(n) - F.col("no")))
    quota = both.select(F.col("yes"), F.col("no"), yes.alias("take_yes"), F.least(F.col("no"), F.lit(n) - yes).alias("take_no"))
    take, size = F.when(F.col(flagged), F.col("take_yes")).otherwise(F.col("take_no")), F.when(F.col(flagged), F.col("yes")).otherwise(F.col("no"))
    return placed.crossJoin(F.broadcast(quota)).where(F.col("place") <= take).select(id_, flagged, F.round(size / take, 6).alias("weight"))

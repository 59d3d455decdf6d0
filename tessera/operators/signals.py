"""Model answers as signals, and the analyses over them: feeds, heat map, running balances, divergence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.dates import iso_week, months_between, recent
from tessera.functions.text import any_of

#: An answer is one of three shapes; absent fields are null.
ANSWERS = "map<string, struct<noul:double, choice:string, score:double, confidence:double, probabilities:map<string,double>>>"
# Weight of each kind of evidence, and whose voice it is.
EVIDENCE = {"reported_result": 1.0, "guidance": 0.8, "channel_or_customer_data": 0.8, "management_commentary": 0.6, "expert_opinion": 0.6, "analyst_opinion": 0.5, "speculation": 0.2}
UNKNOWN_EVIDENCE = 0.5
INSIDE, OUTSIDE = ("guidance", "management_commentary"), ("channel_or_customer_data", "expert_opinion")
WEIGHT_FLOOR, NEUTRAL, MOST_MATERIAL = 0.1, 2.0, 3.0


@dataclass(frozen=True)
class Thresholds:
    """Limits of the analyses, handed on as literals."""

    new_window: int = 30
    contradiction_window: int = 120
    pillar_min: float = 0.5
    boilerplate_max: float = 0.3
    new_info_min: float = 0.6
    maybe_min: float = 0.4
    materiality_min: float = 1.5
    contradicts_min: float = 0.7
    contradiction_materiality: float = 1.0
    contradiction_boilerplate: float = 0.5
    questions_min: float = 0.6
    divergence_window: int = 120
    divergence_gap: float = 1.0
    divergence_least: int = 3
    ledger_min: float = 0.6


def answers(json: Column | str) -> Column:
    """The answers of a JSON text; null where it is broken."""
    return F.from_json(json, ANSWERS)


def _prefixed(a: Column, prefix: str) -> Column:
    return F.transform_keys(F.map_filter(a, lambda k, v: k.startswith(prefix)), lambda k, v: F.substring(k, len(prefix) + 1, 1_000))


def signals(a: Column) -> Column:
    """The signal struct of merged answers; null without answers or without a pillar answer."""
    pillar, fact = a["pillar"], a["updates_fact"]
    chosen = lambda x: F.coalesce(F.try_element_at(x["probabilities"], x["choice"]), x["confidence"], F.lit(0.0))
    p = F.struct(
        pillar["choice"].alias("pillar"),
        chosen(pillar).alias("pillar_p"),
        F.coalesce(a["boilerplate"]["noul"], F.lit(0.0)).alias("boilerplate"),
        F.coalesce(a["new_info"]["noul"], F.lit(0.0)).alias("new_info"),
        F.coalesce(a["materiality"]["score"], F.lit(0.0)).alias("materiality"),
        F.coalesce(a["stance"]["score"], F.lit(NEUTRAL)).alias("stance"),
        a["evidence"]["choice"].alias("evidence"),
        F.coalesce(a["forward_looking"]["noul"], F.lit(0.0)).alias("forward_looking"),
        F.nullif(fact["choice"], F.lit("none")).alias("updates_fact"),
        F.when(fact["choice"] != "none", F.coalesce(F.try_element_at(fact["probabilities"], fact["choice"]), F.lit(0.0))).alias("updates_fact_p"),
        F.transform_values(_prefixed(a, "assumption:"), lambda k, v: F.struct(F.coalesce(F.try_element_at(v["probabilities"], F.lit("supports")), F.lit(0.0)).alias("supports"), F.coalesce(F.try_element_at(v["probabilities"], F.lit("contradicts")), F.lit(0.0)).alias("contradicts"))).alias("assumptions"),
        F.transform_values(_prefixed(a, "question:"), lambda k, v: F.coalesce(v["noul"], F.lit(0.0))).alias("questions"),
    )
    return F.when(pillar.isNotNull(), p)


def classify(p: Column, day: Column, today: Column, triage: Column, t: Thresholds = Thresholds()) -> Column:
    """Which feeds a passage is in: a struct of booleans and the ids of what it contradicts, supports and answers, sorted.

    A null signal is in none; a null boilerplate counts as boilerplate, null scores as 0, a null triage as none.
    """
    contradicts = F.map_keys(F.map_filter(p["assumptions"], lambda k, v: v["contradicts"] >= t.contradicts_min))
    supports = F.map_keys(F.map_filter(p["assumptions"], lambda k, v: (v["supports"] >= t.contradicts_min) & (v["contradicts"] < t.contradicts_min)))
    asked = F.map_keys(F.map_filter(p["questions"], lambda k, v: v >= t.questions_min))
    boilerplate, material, new = F.coalesce(p["boilerplate"], F.lit(1.0)), F.coalesce(p["materiality"], F.lit(0.0)), F.coalesce(p["new_info"], F.lit(0.0))
    raw = (F.size(contradicts) > 0) & (material >= t.contradiction_materiality) & (boilerplate <= t.contradiction_boilerplate)
    on_pillar = p["pillar"].isNotNull() & (p["pillar"] != "off_thesis") & (p["pillar_p"] >= t.pillar_min)
    substantive = on_pillar & (boilerplate <= t.boilerplate_max) & (material >= t.materiality_min)
    eligible = substantive & ~raw & recent(day, today, t.new_window) & ~F.coalesce(triage.isin("dismissed", "absorbed"), F.lit(False))
    no = lambda c: F.coalesce(c, F.lit(False))
    return F.struct(
        F.array_sort(contradicts).alias("contradicts"), F.array_sort(supports).alias("supports"), F.array_sort(asked).alias("questions"),
        no(raw & recent(day, today, t.contradiction_window) & ~triage.eqNullSafe("acknowledged")).alias("in_contradictions"),
        no(eligible & (new >= t.new_info_min)).alias("in_whats_new"), no(eligible & (new >= t.maybe_min) & (new < t.new_info_min)).alias("in_maybe"),
        no(raw | (substantive & (new >= t.maybe_min))).alias("flagged"),
    )


def evidence_weight(evidence: Column) -> Column:
    """The weight of a kind of evidence; unknown kinds and null have UNKNOWN_EVIDENCE."""
    out = F.when(F.lit(False), F.lit(0.0))
    for kind, w in EVIDENCE.items():
        out = out.when(evidence == kind, F.lit(w))
    return out.otherwise(F.lit(UNKNOWN_EVIDENCE))


def heatmap(rows: DataFrame, pillars: list[str], today: Column, weeks: int = 26, *, boilerplate_below: float = 0.5, pillar_min: float = 0.5) -> DataFrame:
    """(pillar, week, net, n): the weighted tone of each pillar and ISO week, on a full grid; null where nothing was said.

    rows: (pillar, pillar_p, boilerplate, materiality, stance, day). Tone is (stance - 2) / 2,
    weighted by materiality + 0.1, within -1..1. Sums are of decimals, so their order doesn't matter.
    """
    spark = rows.sparkSession
    monday = F.trunc(today, "week")
    grid = spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in pillars])).alias("pillar")).crossJoin(spark.range(1).select(F.explode(F.sequence(F.date_sub(monday, 7 * (weeks - 1)), monday, F.expr("interval 7 days"))).alias("monday")))
    used = rows.where(F.col("pillar").isin(*pillars) & (F.col("pillar_p") >= pillar_min) & (F.coalesce("boilerplate", F.lit(1.0)) < boilerplate_below) & F.col("day").isNotNull())
    w = (F.coalesce("materiality", F.lit(0.0)) + WEIGHT_FLOOR).cast("decimal(18,6)")
    tone = (w * ((F.coalesce("stance", F.lit(NEUTRAL)) - NEUTRAL) / NEUTRAL).cast("decimal(18,6)")).cast("decimal(30,12)")
    cells = used.groupBy("pillar", F.trunc("day", "week").alias("monday")).agg((F.sum(tone).cast("double") / F.sum(w).cast("double")).alias("net"), F.count("*").alias("n"))
    out = grid.join(cells, ["pillar", "monday"], "left")
    return out.select("pillar", iso_week("monday").alias("week"), (F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "net")), 3) + F.lit(0.0)).alias("net"), F.coalesce("n", F.lit(0)).alias("n"))


def running_balance(rows: DataFrame, t: Thresholds = Thresholds(), *, least: float = 0.5) -> DataFrame:
    """(id, month, pro, con, balance): evidence for and against each assumption by month, and its running balance, without gaps from the first month to the last.

    rows: (id, day, supports, contradicts, materiality, evidence).
    """
    con = F.col("contradicts") >= t.contradicts_min
    pro = (F.col("supports") >= t.contradicts_min) & ~con
    leans = F.greatest("supports", "contradicts") >= least
    delta = F.when(leans, evidence_weight(F.col("evidence")) * (F.col("supports") - F.col("contradicts")) * F.coalesce("materiality", F.lit(0.0)) / MOST_MATERIAL).otherwise(0.0).cast("decimal(20,9)")
    per = rows.where((con | pro | leans) & F.col("day").isNotNull()).groupBy("id", F.trunc("day", "month").alias("first")).agg(F.count_if(pro).alias("pro"), F.count_if(con).alias("con"), F.sum(delta).alias("delta"))
    grid = per.groupBy("id").agg(F.explode(months_between(F.min("first"), F.max("first"))).alias("first"))
    by = Window.partitionBy("id").orderBy("first").rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(per, ["id", "first"], "left")
    return full.select("id", F.date_format("first", "yyyy-MM").alias("month"), F.coalesce("pro", F.lit(0)).alias("pro"), F.coalesce("con", F.lit(0)).alias("con"), (F.round(F.sum(F.coalesce("delta", F.lit(0).cast("decimal(20,9)"))).over(by).cast("double"), 3) + F.lit(0.0)).alias("balance"))


def divergence(rows: DataFrame, today: Column, t: Thresholds = Thresholds(), *, ids: int = 3) -> DataFrame:
    """(pillar, inside, n_inside, inside_ids, outside, n_outside, outside_ids, gap, flagged): how company and outside voices differ on a pillar, in one aggregation.

    rows: (id, pillar, pillar_p, boilerplate, materiality, stance, evidence, day). A pillar
    without both sides is left out. Order: flagged, then the wider gap, then pillar.
    """
    used = rows.where((F.col("pillar_p") >= t.pillar_min) & (F.coalesce("boilerplate", F.lit(1.0)) <= t.boilerplate_max) & recent(F.col("day"), today, t.divergence_window))
    w = (F.coalesce("materiality", F.lit(0.0)) + WEIGHT_FLOOR).cast("decimal(18,6)")
    stance = (w * F.coalesce("stance", F.lit(NEUTRAL)).cast("decimal(18,6)")).cast("decimal(30,12)")
    side = lambda kinds: F.col("evidence").isin(*kinds)
    mean = lambda k: F.round(F.sum(F.when(side(k), stance)).cast("double") / F.sum(F.when(side(k), w)).cast("double"), 3)
    # the ids come from a ranking, so that no list of all members is ever built
    by = Window.partitionBy("pillar", side(INSIDE)).orderBy(F.desc(F.coalesce("materiality", F.lit(0.0))), F.desc("day"), F.desc("id"))
    ranked = used.where(side(INSIDE + OUTSIDE) & F.col("pillar").isNotNull()).withColumn("place", F.row_number().over(by))
    top = lambda k: F.transform(F.array_sort(F.collect_list(F.when(side(k) & (F.col("place") <= ids), F.struct("place", "id")))), lambda s: s["id"])
    both = ranked.groupBy("pillar").agg(mean(INSIDE).alias("inside"), F.count_if(side(INSIDE)).alias("n_inside"), top(INSIDE).alias("inside_ids"), mean(OUTSIDE).alias("outside"), F.count_if(side(OUTSIDE)).alias("n_outside"), top(OUTSIDE).alias("outside_ids")).where("n_inside > 0 and n_outside > 0")
    gap = F.round(F.col("inside") - F.col("outside"), 3) + F.lit(0.0)
    flagged = (F.col("n_inside") >= t.divergence_least) & (F.col("n_outside") >= t.divergence_least) & (F.abs(gap) >= t.divergence_gap)
    return both.withColumn("gap", gap).withColumn("flagged", flagged).orderBy(F.desc("flagged"), F.desc(F.abs("gap")), "pillar")


def promises(rows: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """The rows that promise something: guidance, or commentary that looks ahead; on a pillar, material and dated."""
    ahead = (F.col("evidence") == "guidance") | ((F.col("evidence") == "management_commentary") & (F.col("forward_looking") >= 0.7))
    return rows.where(ahead & (F.col("forward_looking") >= 0.5) & (F.col("pillar") != "off_thesis") & (F.col("pillar_p") >= t.pillar_min) & (F.col("boilerplate") <= t.boilerplate_max) & (F.col("materiality") >= t.materiality_min) & F.col("day").isNotNull())


def promise_results(promised: DataFrame, rows: DataFrame, *, within: int = 450, least: float = 0.1, most: int = 3) -> DataFrame:
    """(promise_id, result_id, shared, place): for each promise up to ``most`` later results on its pillar and company that share its topic.

    rows: (id, pillar, read_through, evidence, forward_looking, day, words). An equi join on
    pillar and read-through, null matching null, with the days as a residual range.
    """
    a = promised.select(F.col("id").alias("promise_id"), F.col("pillar").alias("p"), F.col("read_through").alias("r"), F.col("day").alias("then"), F.col("words").alias("said"))
    b = rows.where((F.col("evidence") == "reported_result") & (F.col("forward_looking") < 0.5) & F.col("day").isNotNull())
    met = a.join(b, (F.col("p") == F.col("pillar")) & F.col("r").eqNullSafe(F.col("read_through")) & (F.col("day") > F.col("then")) & (F.col("day") <= F.date_add("then", within)))
    shared = F.size(F.array_intersect("said", "words"))
    met = met.withColumn("shared", F.when(shared == 0, 0.0).otherwise(shared / (F.size("said") + F.size("words") - shared))).where(F.col("shared") >= least)
    by = Window.partitionBy("promise_id").orderBy(F.desc("shared"), "day", "id")
    return met.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most).select("promise_id", F.col("id").alias("result_id"), F.round("shared", 6).alias("shared"), "place")


def ledger(pairs: DataFrame, verdicts: DataFrame, days: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """(promise_id, state, result_id): kept, missed or open by the latest result whose newest verdict is sure enough.

    verdicts: (promise_id, result_id, at, seq, confirms, misses); days: (id, day).
    """
    newest = verdicts.groupBy("promise_id", "result_id").agg(F.max_by(F.struct("confirms", "misses"), F.struct("at", "seq")).alias("v"))
    sure = newest.where((F.col("v.confirms") >= t.ledger_min) | (F.col("v.misses") >= t.ledger_min)).join(days.withColumnRenamed("id", "result_id"), "result_id")
    state = F.when(F.col("v.confirms") >= F.col("v.misses"), "kept").otherwise("missed")
    last = sure.groupBy("promise_id").agg(F.max(F.struct("day", F.greatest("v.confirms", "v.misses").alias("p"), "result_id", state.alias("state"))).alias("last"))
    return pairs.select("promise_id").distinct().join(last, "promise_id", "left").select("promise_id", F.coalesce("last.state", F.lit("open")).alias("state"), F.col("last.result_id").alias("result_id"))


def verdict(pro: Column, con: Column, earlier_pro: Column, earlier_con: Column) -> Column:
    """One word for an assumption from evidence of the last half year and the one before: quiet, holding, contradicted, mixed, turning_for or turning_against.

    Holding and contradicted need twice the other side; turning needs the earlier balance to have been the other way.
    """
    now, then = pro - con, earlier_pro - earlier_con
    return F.when(pro + con == 0, "quiet").when((now > 0) & (then < 0), "turning_for").when((now < 0) & (then > 0), "turning_against").when(pro >= 2 * con, "holding").when(con >= 2 * pro, "contradicted").otherwise("mixed")


def shown_because(feeds: Column) -> Column:
    """The names of the feeds a classified passage is in."""
    names = ("in_contradictions", "in_whats_new", "in_maybe", "flagged")
    return F.filter(F.array(*[F.when(feeds[n], F.lit(n)) for n in names]), lambda x: x.isNotNull())


def in_any_feed(feeds: Column) -> Column:
    return any_of([feeds[n] for n in ("in_contradictions", "in_whats_new", "in_maybe")])

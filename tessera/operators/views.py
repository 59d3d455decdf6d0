"""Views composed of the other operators: dereferenced links, predictions, cursors, ranked facts, display fields, spot checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx

#: A prediction is due from so many days before its day.
DUE_DAYS = 14


def seen_links(passages: DataFrame) -> DataFrame:
    """(passage_id, place, seen_id, seen_document): the passages that each ``seen_ids`` list names, in its order; unknown ids are left out."""
    named = passages.select("passage_id", F.posexplode("seen_ids").alias("at", "seen_id")).distinct()
    known = passages.select(F.col("passage_id").alias("seen_id"), F.col("document_id").alias("seen_document")).distinct()
    return named.join(known, "seen_id").select("passage_id", (F.col("at") + 1).alias("place"), "seen_id", "seen_document")


def similar_links(passages: DataFrame) -> DataFrame:
    """(passage_id, similar_to, similar_document, similarity): every passage with the one it is similar to, if any."""
    known = passages.select(F.col("passage_id").alias("similar_to"), F.col("document_id").alias("similar_document")).distinct()
    return passages.select("passage_id", "similar_to", "similarity").distinct().join(known, "similar_to", "left").select("passage_id", "similar_to", "similar_document", "similarity")


def prediction_status(by: Column, today: Column, resolved: Column) -> Column:
    """'resolved', 'overdue' after its day, 'due' within DUE_DAYS before it, else 'open'."""
    left = F.datediff(by, today)
    return F.when(resolved, "resolved").when(left < 0, "overdue").when(left <= DUE_DAYS, "due").otherwise("open")


def predictions(stated: DataFrame, resolutions: DataFrame, today: Column) -> DataFrame:
    """(prediction_id, by, p, outcome, status, error): every prediction with its outcome, if any, and the squared error of its probability."""
    out = stated.join(resolutions.select("prediction_id", "outcome"), "prediction_id", "left")
    status = prediction_status(F.col("by"), today, F.col("outcome").isNotNull())
    return out.select("prediction_id", "by", "p", "outcome", status.alias("status"), F.pow(F.col("p") - F.col("outcome").cast("int"), 2).alias("error"))


def prediction_score(seen: DataFrame) -> DataFrame:
    """(status, n, brier): predictions by status with their mean squared error, null where none is resolved."""
    return seen.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum(F.col("error").cast("decimal(18,10)")).cast("double") / F.count("error"), 4).alias("brier"))


def ranked_facts(text: Column | str, facts: list[str], limit: int) -> Column:
    """The numbers, from 0, of the ``limit`` facts that share most content words with a text, ties by number; all in order if they are few.

    The facts are a dimension of a few dozen, handed on as a literal.
    """
    if len(facts) <= limit:
        return F.array(*[F.lit(i) for i in range(len(facts))])
    mine = tx.content_words(text)
    scored = [F.struct((-tx.jaccard(mine, tx.content_words(F.lit(f)))).alias("s"), F.lit(i).alias("i")) for i, f in enumerate(facts)]
    return F.transform(F.slice(F.array_sort(F.array(*scored)), 1, limit), lambda s: s["i"])


def since_cursor(filings: DataFrame, cursors: DataFrame, *, cutoff: Column, forms: list[str]) -> DataFrame:
    """Filings newer than the last one fetched, oldest first in each ticker.

    filings: (ticker, position, accession, form, filed), position 0 the newest. The first filing
    that is the cursor's or older than ``cutoff`` stops its ticker: it and all behind it are out.
    """
    known = filings.join(cursors.select("ticker", "last_accession"), "ticker", "left")
    stop = (F.col("accession").eqNullSafe(F.col("last_accession")) & F.col("last_accession").isNotNull()) | F.coalesce(F.col("filed") < cutoff, F.lit(True))
    by = Window.partitionBy("ticker").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("ticker").orderBy(F.desc("position"))
    fresh = known.withColumn("stops", F.sum(stop.cast("int")).over(by)).where(F.col("stops") == 0).where(F.col("form").isin(*forms))
    return fresh.withColumn("place", F.row_number().over(back)).select("ticker", "place", "accession", "form", "filed")


def exhibit_names(headers: Column | str) -> Column:
    """File names of the HTML documents whose declared type starts EX-99, from a filing's index headers."""
    each = F.regexp_extract_all(headers, F.lit(r"(?is)<DOCUMENT>(.*?)(?=<DOCUMENT>|</DOCUMENT>|\z)"), F.lit(1))
    named = F.transform(each, lambda d: F.struct(F.regexp_extract(d, r"(?im)^\s*<TYPE>\s*([^\s<]+)", 1).alias("type"), F.regexp_extract(d, r"(?im)^\s*<FILENAME>\s*([^\s<]+)", 1).alias("name")))
    return F.transform(F.filter(named, lambda d: F.upper(d["type"]).startswith("EX-99") & F.lower(d["name"]).rlike(r"\.html?$")), lambda d: d["name"])


# The units, without blanks, that a kind of mention can be given in; any other unit counts things.
UNITS_OF_KIND = {
    "bps": ("bps", "bp", "basispoints", "pp", "pts", "points", "percentagepoints"),
    "percent": ("%", "percent", "pct", "pp", "pts", "points", "percentagepoints"),
    "currency": ("usd", "dollars"),
    "days": ("days", "day"),
    "multiple": ("x", "times", "multiple"),
}


def admissible_kinds(unit: Column) -> Column:
    """The kinds of mention that a metric of this unit can take; a count without one."""
    u = F.lower(F.regexp_replace(unit, r"\s+", ""))
    fit = {kind: u.isin(*units) for kind, units in UNITS_OF_KIND.items()}
    fit["currency"] = fit["currency"] | u.startswith("$")
    kinds = F.array_compact(F.array(*[F.when(is_so, F.lit(kind)) for kind, is_so in fit.items()]))
    return F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.lit("count")))


def shown_value(value: Column, high: Column, unit: Column) -> Column:
    """A figure with its unit: the sign before a currency sign, no trailing zeros, a range with 'to'."""

    def number(v: Column) -> Column:
        plain = F.regexp_replace(F.call_function("format_number", F.abs(v), F.lit("#,##0.######")), r"\.$", "")
        sign = F.when(v < 0, "-").otherwise("")
        return F.when(unit.startswith("$"), F.concat(sign, F.lit("$"), plain, F.substring(unit, 2, 20))).when(unit.isin("%", "x"), F.concat(sign, plain, unit)).otherwise(F.concat(sign, plain, F.lit(" "), unit))

    return F.when(high.isNull(), number(value)).otherwise(F.concat(number(value), F.lit(" to "), number(high)))


def quoted(text: Column, source: Column) -> Column:
    """A text as a Markdown block quote with its source below."""
    return F.concat(F.array_join(F.transform(F.split(text, "\n", -1), lambda line: F.rtrim(F.concat(F.lit("> "), line))), "\n"), F.lit("\n>\n> — "), source)


def number_heavy(text: Column | str, share: float = 0.25) -> Column:
    """Whether digits are at least ``share`` of the characters that are no blanks."""
    solid = F.regexp_replace(text, r"\s", "")
    digits = F.regexp_replace(text, r"[^0-9]", "")
    return F.when(F.length(solid) == 0, F.lit(False)).otherwise(F.length(digits) >= F.length(solid) * share)


def spot_checks(rows: DataFrame, group: str, id_: str, *, day: str, most: int = 20) -> DataFrame:
    """(group, id): a reproducible draw of up to ``most`` rows of each group for a day, by the hash of group, day and id. A sampling operator."""
    drawn = rows.select(group, id_).where(F.col(group).isNotNull()).distinct().withColumn("draw", F.sha2(F.concat_ws(":", F.col(group), F.lit(day), F.col(id_).cast("string")), 256))
    by = Window.partitionBy(group).orderBy("draw", id_)
    return drawn.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most).select(group, id_)


def arrived_since(documents: DataFrame, views: DataFrame, *, at: str = "ingested_at") -> DataFrame:
    """Documents that arrived after the last time the views were looked at; all of them if they never were."""
    last = views.agg(F.max("seen_at").alias("last"))
    return documents.join(F.broadcast(last), (F.col("last").isNull()) | (F.col(at) > F.col("last"))).drop("last")


def looked_up(rows: DataFrame, ids: list[int], key: str) -> DataFrame:
    """``rows`` of ``ids`` with ``place``, the order asked for; an id asked twice counts once, of an unknown one all other columns are null.

    The ids are the caller's own list, so they are broadcast and the rows are not shuffled; repeated rows of an id count once.
    """
    asked = list(dict.fromkeys(ids))
    wanted = rows.sparkSession.createDataFrame(list(enumerate(asked, 1)), f"place int, `{key}` long")
    met = rows.join(F.broadcast(wanted.select(key)), key, "left_semi").dropDuplicates([key])
    return wanted.join(met, key, "left")

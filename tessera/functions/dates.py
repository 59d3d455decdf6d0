"""Date and reporting-period expressions, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_week(day: Column | str) -> Column:
    """'2026-W03': the ISO year and week of a date."""
    d = F.col(day) if isinstance(day, str) else day
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), d).cast("int"), F.weekofyear(d))


def day_of(given: Column, arrived: Column) -> Column:
    """The document's date, else the day it arrived."""
    return F.coalesce(given.cast("date"), F.to_date(arrived))


def recent(day: Column, today: Column, days: int) -> Column:
    """Within ``days`` before ``today``, that day included; later days count too, null doesn't."""
    return F.coalesce(day >= F.date_sub(today, days), F.lit(False))


def parsed_day(text: Column | str) -> Column:
    """The first ten characters as a date, null if they are none."""
    return F.substring(text, 1, 10).try_cast("date")


def normalized_date(text: Column | str) -> Column:
    """One of six ways to write a date as a date; null if it is none of them."""
    t = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(text, r"\.", ""), r"(?i)\bsept\b", "Sep")), r"(\d)(st|nd|rd|th)\b", "$1")
    forms = ("MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "M/d/yyyy", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)).cast("date") for f in forms])


# How dates are written in running text.
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec)"
WRITTEN_DATE = rf"\b(?:\d{{4}}-\d{{2}}-\d{{2}}|{_MONTH}\.? \d{{1,2}}, \d{{4}}|\d{{1,2}} {_MONTH} \d{{4}}|\d{{1,2}}/\d{{1,2}}/\d{{4}})\b"


def date_candidates(text: Column | str, limit: int = 20) -> Column:
    """The dates a text names, as written, each once, in text order, the first ``limit``; what is no day of the calendar is left out. Null for a null text."""
    written = F.array_distinct(F.regexp_extract_all(text, F.lit(WRITTEN_DATE), F.lit(0)))
    return F.slice(F.filter(written, lambda c: normalized_date(c).isNotNull()), 1, limit)


def is_iso_day(text: Column | str) -> Column:
    """Whether a text is a day of the calendar as yyyy-mm-dd; false for null."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(col.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & col.try_cast("date").isNotNull(), F.lit(False))


def week_labels(today: Column, weeks: int) -> Column:
    """The last ``weeks`` ISO weeks, ending with today's."""
    monday = F.trunc(today, "week")
    return F.transform(F.sequence(F.date_sub(monday, 7 * (weeks - 1)), monday, F.expr("interval 7 days")), iso_week)


def months_between(first: Column, last: Column) -> Column:
    """The first days of all months from ``first`` to ``last``."""
    return F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))


# A period key is '2026-Q3', '2026-H2', 'FY2026' or '2026-09'.


def granularity(key: Column) -> Column:
    """'year', 'quarter', 'half' or 'month'."""
    return F.when(key.startswith("FY"), "year").when(key.rlike(r"-Q\d$"), "quarter").when(key.rlike(r"-H\d$"), "half").when(key.rlike(r"-\d\d$"), "month")


def period_order(key: Column) -> Column:
    """A struct that sorts periods by when they end; at the same end a month, quarter, half, fiscal year."""
    year = F.regexp_extract(key, r"(\d{4})", 1).try_cast("int")
    part = F.regexp_extract(key, r"(\d+)$", 1).try_cast("int")
    kind = granularity(key)
    end = F.when(kind == "year", 12).when(kind == "quarter", part * 3).when(kind == "half", part * 6).otherwise(part)
    rank = F.when(kind == "year", 3).when(kind == "half", 2).when(kind == "quarter", 1).otherwise(0)
    return F.struct(year.alias("year"), end.alias("end_month"), rank.alias("rank"))


def period_label(key: Column) -> Column:
    """'Q3 2026', 'H2 2026', 'FY 2026', 'Sep 2026'."""
    year = F.regexp_extract(key, r"(\d{4})", 1)
    part = F.regexp_extract(key, r"-(.+)$", 1)
    kind = granularity(key)
    month = F.date_format(F.to_date(F.concat(year, F.lit("-"), part, F.lit("-01"))), "MMM")
    return F.when(kind == "year", F.concat(F.lit("FY "), year)).when(kind == "month", F.concat_ws(" ", month, year)).otherwise(F.concat_ws(" ", part, year))


def last_completed_quarter(day: Column) -> Column:
    """The key of the quarter that ended before the date's own quarter."""
    before = F.date_sub(F.trunc(day, "quarter"), 1)
    return F.format_string("%d-Q%d", F.year(before), F.quarter(before))


def nearest_year(end_month: Column, day: Column) -> Column:
    """Of the year before, of and after ``day``, the one whose period ending in ``end_month`` ends nearest; the earlier in a tie."""
    gaps = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.struct(F.abs(F.datediff(F.make_date(F.year(day) + i, end_month, F.lit(28)), day)).alias("gap"), (F.year(day) + i).alias("year")))
    return F.array_min(gaps)["year"]

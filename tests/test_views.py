"""Views on small fixtures."""

import datetime

from pyspark.sql import functions as F

from tessera.operators import views


def test_display_fields(spark):
    df = spark.createDataFrame([(1200.5, None, "$M"), (-3.0, None, "$"), (20.0, 21.25, "%"), (2.5, None, "x"), (-41000.0, None, "units")], "v double, h double, u string")
    assert [r.s for r in df.select(views.shown_value(F.col("v"), F.col("h"), F.col("u")).alias("s")).collect()] == ["$1,200.5M", "-$3", "20% to 21.25%", "2.5x", "-41,000 units"]
    q = spark.createDataFrame([("a\n\nb", "Doc, p. 1")], "t string, s string").select(views.quoted(F.col("t"), F.col("s")).alias("q")).first().q
    assert q == "> a\n>\n> b\n>\n> — Doc, p. 1"


def test_exhibits(spark):
    head = "<DOCUMENT>\n<TYPE>8-K\n<FILENAME>main.htm\n</DOCUMENT>\n<DOCUMENT>\n<TYPE>EX-99.1\n<FILENAME>release.htm\n</DOCUMENT>\n<DOCUMENT><TYPE>EX-99.2\n<FILENAME>deck.pdf\n</DOCUMENT><DOCUMENT>\n<TYPE>ex-99\n<FILENAME>x.HTML\n"
    got = spark.createDataFrame([(head,), ("",), (None,)], "h string").select(views.exhibit_names("h").alias("n")).collect()
    assert [r.n for r in got] == [["release.htm", "x.HTML"], [], None]


def test_predictions(spark):
    d = datetime.date
    stated = spark.createDataFrame([("a", d(2026, 9, 30), 0.8), ("b", d(2026, 10, 14), 0.5), ("c", d(2026, 10, 15), 0.5), ("e", d(2026, 9, 29), 0.5), ("f", d(2026, 1, 1), 0.9)], "prediction_id string, by date, p double")
    done = spark.createDataFrame([("f", True), ("zz", False)], "prediction_id string, outcome boolean")
    seen = views.predictions(stated, done, F.lit("2026-09-30").cast("date"))
    assert {r.prediction_id: r.status for r in seen.collect()} == {"a": "due", "b": "due", "c": "open", "e": "overdue", "f": "resolved"}
    assert {r.status: r.brier for r in views.prediction_score(seen).collect()}["resolved"] == 0.01


def test_arrivals(spark):
    docs = spark.createDataFrame([(1, datetime.datetime(2026, 1, 1)), (2, datetime.datetime(2026, 1, 3))], "doc_id int, ingested_at timestamp")
    seen = spark.createDataFrame([(datetime.datetime(2026, 1, 2),)], "seen_at timestamp")
    assert [r.doc_id for r in views.arrived_since(docs, seen).collect()] == [2]
    assert views.arrived_since(docs, seen.limit(0)).count() == 2


def test_facts(spark):
    df = spark.createDataFrame([("gross margin rose",), (None,), ("",)], "t string")
    facts = ["margin of error", "gross margin", "rose garden", "other"]
    assert [r.f for r in df.select(views.ranked_facts("t", facts, 2).alias("f")).collect()][0] == [1, 0]
    assert [r.f for r in df.select(views.ranked_facts("t", facts[:2], 2).alias("f")).collect()] == [[0, 1]] * 3

"""Operators on small fixtures with hand-computed results, and every query against its oracle."""

import collections
import datetime
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import calibration as cal
from tessera.functions import dates
from tessera.operators import kpi, linking, retrieval, state, units, views
from tessera.operators import signals as sg
from tessera.plans import slate
from tessera.sources import extract
from tessera.streaming import pipeline

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 5) + 0.0 if isinstance(v, float) or hasattr(v, "as_tuple") else str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(slate.oracle_sql()))
def test_query_equals_its_oracle(spark, duck, name):
    df = slate.queries()[name](spark, SF)
    rel = duck.sql(slate.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    want = collections.Counter(tuple(plain(dict(zip(rel.columns, r))[c]) for c in columns) for r in rel.fetchall())
    assert collections.Counter(tuple(plain(v) for v in r) for r in df.select(*columns).collect()) == want


@pytest.mark.parametrize("name", sorted(set(slate.queries()) - set(slate.oracle_sql())))
def test_query_without_oracle_runs(spark, name):
    assert slate.queries()[name](spark, SF).count() >= 0


M = "mention_id long, accession string, metric_id string, period_key string, text string, kind string, value double, high double, unit string, sentence string"


def test_same_amounts(spark):
    metrics = spark.createDataFrame([("len", "km", "good"), ("temp", "degC", "bad"), ("odd", "furlongs", None), (None, "km", None)], "metric_id string, unit string, higher_is string")
    said = [
        (1, "a", "len", "p", "5 km", None, 5.0, None, "km", None),
        (2, "a", "len", "p", "5,000 m", None, 5000.0, None, "m", None),
        (3, "a", "len", "p", "3.1069 miles", None, None, None, None, "It was 3.1069 miles."),
        (3, "a", "len", "p", "3.1069 miles", None, None, None, None, "It was 3.1069 miles."),
        (4, "a", "len", "p", "5.2", None, 5.2, None, None, "Length (in kilometres): 5.2."),
        (5, "b", "len", "p", "5 km", None, 5.0, None, "km", None),
        (6, None, "len", "p", "5 km", None, 5.0, None, "km", None),
        (7, "c", "temp", "p", "212 °F", None, 212.0, None, "°F", None),
        (8, "c", "temp", "p", "100", None, 100.0, None, None, "Temperature stood at 100 in degrees Celsius."),
        (9, "c", "temp", "p", None, None, None, None, None, None),
        (10, "d", "odd", "p", "1", None, 1.0, None, "km", None),
        (11, "e", "len", "p", "0 km", None, 0.0, None, "km", None),
        (12, "e", "len", "p", "nil", None, None, None, "m", "0 metres"),
    ]
    m = spark.createDataFrame(said, M).withColumn("band", F.lit(1)).withColumn("target", F.lit("x"))
    assert rows(units.same_amounts(m, metrics)) == [(1, 2), (1, 3), (2, 3), (7, 8)]
    got = {r.mention_id: r.amount for r in units.amounts(m, metrics).collect()}
    assert len(got) == 12 and got[7] == pytest.approx(100) and got[9] is None and got[10] is None
    assert rows(units.same_amounts(m.limit(0), metrics)) == [] and rows(units.same_amounts(m, metrics.limit(0))) == []


def test_classify_edges(spark):
    p = "pillar string, pillar_p double, boilerplate double, new_info double, materiality double, assumptions map<string,struct<supports:double,contradicts:double>>, questions map<string,double>"
    day = datetime.date(2026, 9, 24)
    ok, con = {"a": (0.1, 0.2)}, {"z": (0.9, 0.8), "b": (0.8, 0.1)}
    cases = [
        (1, ("p1", 0.5, 0.3, 0.6, 1.5, ok, {"q": 0.6}), day - datetime.timedelta(30), None),
        (2, ("p1", 0.5, 0.3, 0.6, 1.5, ok, {}), day - datetime.timedelta(31), None),
        (3, ("p1", 0.5, None, 0.6, 1.5, ok, {}), day, None),
        (4, ("p1", 0.5, 0.5, 0.0, 1.0, con, {}), day, None),
        (5, ("p1", 0.5, 0.5, 0.0, 1.0, con, {}), day, "acknowledged"),
        (6, ("off_thesis", 0.9, 0.0, 0.9, 3.0, ok, {}), day, None),
        (7, ("p1", 0.5, 0.1, 0.4, 2.0, ok, {}), day + datetime.timedelta(900), None),
        (8, ("p1", 0.5, 0.1, 0.9, 2.0, ok, {}), day, "dismissed"),
        (9, None, day, None),
    ]
    df = spark.createDataFrame(cases, f"id int, p struct<{p.replace(' string', ':string').replace(' double', ':double').replace(' map', ':map')}>, day date, triage string")
    got = {r.id: r.c for r in df.select("id", sg.classify(F.col("p"), F.col("day"), F.lit(day), F.col("triage")).alias("c")).collect()}
    feeds = {i: tuple(bool(c[n]) for n in ("in_contradictions", "in_whats_new", "in_maybe", "flagged")) for i, c in got.items()}
    assert feeds[1] == (False, True, False, True) and got[1].questions == ["q"]
    assert feeds[2] == (False, False, False, True)
    assert feeds[3] == (False, False, False, False)
    assert feeds[4] == (True, False, False, True) and got[4].contradicts == ["z"] and got[4].supports == ["b"]
    assert feeds[5] == (False, False, False, True)
    assert feeds[6] == feeds[9] == (False, False, False, False)
    assert feeds[7] == (False, False, True, True)
    assert feeds[8] == (False, False, False, True)


def test_signals_from_json(spark):
    texts = ['{"pillar": {"choice": "p1", "probabilities": {"p1": 0.7}}, "assumption:a": {"probabilities": {"supports": 0.8}}, "question:q": {"noul": 0.4}, "updates_fact": {"choice": "none"}}', '{"boilerplate": {"noul": 0.2}}', "{broken", None]
    got = [r.p for r in spark.createDataFrame([(t,) for t in texts], "t string").select(sg.signals(sg.answers("t")).alias("p")).collect()]
    assert got[0].pillar_p == 0.7 and got[0].stance == 2.0 and got[0].assumptions["a"].supports == 0.8 and got[0].assumptions["a"].contradicts == 0.0 and got[0].questions == {"q": 0.4} and got[0].updates_fact is None
    assert got[1:] == [None, None, None]


def test_state(spark):
    log = spark.createDataFrame([(1, 1, "x", None), (1, 2, None, True), (2, 1, None, None), (1, 3, "y", None)], "k int, t int, status string, starred boolean")
    assert rows(state.latest(log, ["k"], [F.col("t")]).select("k", "t")) == [(1, 3), (2, 1)]
    assert rows(state.folded(log, ["k"], [F.col("t")], ["status", "starred"])) == [(1, "y", True)]
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", False), (1, "z", True), (3, "d", None)], "k int, v string, gone boolean")
    assert rows(state.upsert(old, new, ["k"], deleted=F.col("gone"))) == [(2, "c"), (3, "d")]


def test_links_and_redlines(spark):
    old = [f"The company made {n} widgets in plant {n} and shipped them to customer {n} overseas last season." for n in range(100, 140)]
    new = list(old)
    for i in range(0, 10):
        new[i] = new[i].replace("last season", "this winter")
    new.append("An entirely unrelated disclosure concerning litigation.")
    docs = spark.createDataFrame([(1, "T", "10-K", datetime.date(2025, 1, 1)), (2, "T", "10-K/A", datetime.date(2026, 1, 1)), (3, "T", "8-K", datetime.date(2026, 2, 1))], "doc_id long, ticker string, form string, doc_date date")
    docs = docs.withColumns({c: F.lit(None).cast("string") for c in ("title", "source_type", "source", "path", "origin", "status")}).withColumn("ingested_at", F.lit(None).cast("timestamp"))
    passages = spark.createDataFrame([(i, 1, i, t) for i, t in enumerate(old)] + [(100 + i, 2, i, t) for i, t in enumerate(new)], "passage_id long, document_id long, seq int, text string")
    pairs = linking.latest_two(docs)
    assert rows(pairs) == [("T", "10-K", 2, 1)]
    kinds = collections.Counter(r.kind for r in linking.redlines(passages, pairs).collect())
    assert kinds == {"changed": 10, "added": 1}
    got = {r.passage_id: r for r in linking.links(linking.passage_rows(passages, docs)).collect()}
    assert all(got[100 + i].repeat_of == i for i in range(10, 40)) and all(got[i].repeat_of is None for i in range(40))
    assert got[100].similar_to == 0 and got[100].similarity > 0.7 and 0 in got[100].seen_ids and got[140].similar_to is None


def test_ranking_matches_the_formula(spark):
    texts = ["gross margin rose", "margin call and gross error", "nothing here", "Gross MARGIN margin", None, ""]
    index = retrieval.build_index(spark.createDataFrame(list(enumerate(texts)), "passage_id long, text string"))
    got = {r.passage_id: r.score for r in retrieval.rank(index, retrieval.parse('"gross margin" OR error')).collect()}
    words = [(t or "").lower().split() for t in texts]
    avg = sum(map(len, words)) / 6
    idf = lambda n: max(math.log((6 - n + 0.5) / (n + 0.5)), 1e-6)
    want = lambda i, n: -idf(n) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(words[i]) / avg))
    assert got == {0: pytest.approx(want(0, 2)), 3: pytest.approx(want(3, 2)), 1: pytest.approx(want(1, 1))}
    assert retrieval.rank(index, []).count() == 0


def test_series(spark):
    points = spark.createDataFrame([("m", "2025-Q1", 1.0, 2.0, 1), ("m", "2025-Q1", 1.5, 2.5, 2), ("n", "2025-Q1", 1.0, None, 1), ("o", "2025-Q1", 1.0, 3.0, 1), ("o", "2025-Q1", 1.5, 2.5, 2)], "metric string, period string, value double, high double, id int")
    assert rows(kpi.revision(points, ["metric", "period"], ["id"])) == [("m", "2025-Q1", "raised"), ("n", "2025-Q1", "first"), ("o", "2025-Q1", "narrowed")]
    v = spark.createDataFrame([(2.5, 2.0, 3.0), (1.0, 2.0, 3.0), (4.0, 2.0, 3.0)], "v double, lo double, hi double")
    assert [r.c for r in v.select(kpi.compared(F.col("v"), F.col("lo"), F.col("hi")).alias("c")).collect()] == ["within", "below", "above"]


def test_calibration_edges(spark):
    none = spark.createDataFrame([], "signal double, label boolean, weight double")
    assert cal.at_thresholds(none, [0.5]).count() == 0
    one = spark.createDataFrame([(1.0, True, 2.0), (0.0, False, 1.0)], "signal double, label boolean, weight double")
    r = cal.at_thresholds(one, [0.5]).first()
    assert (r.precision, r.recall, r.n_flagged) == (1.0, 1.0, 1.0)
    assert [b.bucket for b in cal.reliability(one).orderBy("bucket").collect()] == [0, 4]
    i = spark.range(1).select(cal.wilson(F.lit(0), F.lit(10)).alias("a"), cal.wilson(F.lit(0), F.lit(0)).alias("b")).first()
    assert i.a.low == 0.0 and i.a.high == pytest.approx(0.2775, abs=1e-3) and i.b is None


def test_html():
    got = extract.html_text("<html><head><title>x</title></head><body><p>One&nbsp; two<br>three</p><table><tr><td>a</td><td>b</td></tr></table><div style='display: none'>no<div>no</div></div><span hidden>no</span><ix:header>no</ix:header><script>no</script>end</body></html>")
    assert got == "One two\nthree\n\na | b\n\nend"


def test_passages_keep_their_place():
    page = "First para\nline two.\n\n" + "Long sentence number one. " * 90 + "\n\n" + "x" * 4000 + "\n\nlast"
    got = extract.passages_of([page, "", "Second page"])
    for p in got[:-1]:
        assert page[p["char_start"] : p["char_end"]].split() == p["text"].split() and len(p["text"]) <= 1600
    assert "".join("".join(p["text"].split()) for p in got) == "".join((page + "Second page").split())
    assert [p["seq"] for p in got] == list(range(len(got))) and got[-1]["page"] == 3
    call = extract.passages_of(["Operator: Welcome all.\nplease listen\nJane Roe - CFO: Thanks.\nNote: not a label\n"], True)
    assert [(p["speaker"], p["text"]) for p in call] == [("Operator", "Welcome all. please listen"), ("Jane Roe - CFO", "Thanks. Note: not a label")]


def test_folder_of_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>Same text</p>")
    (tmp_path / "b.txt").write_text("Same   text")
    (tmp_path / "c.md").write_text("# Title line\nbody")
    (tmp_path / "d.exe").write_bytes(b"x")
    (tmp_path / "e.txt").write_text("  ")
    got = {os.path.basename(r.path): r for r in extract.read_folder(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.html", "c.md", "d.exe", "e.txt"}
    assert got["c.md"].title == "Title line" and got["e.txt"].text_sha256 is None and got["e.txt"].title == "e" and "exe" in got["d.exe"].error


def test_streams(spark, tmp_path):
    merged = {(r.key, r.week_start): r for r in slate.streamed_tone(spark, SF).collect()}
    whole = {(r.key, r.week_start): r for r in slate.tone_by_week(spark, SF).collect()}
    assert merged and merged == whole
    spark.createDataFrame([(1, "A  b"), (2, "a b"), (3, "c")], "id int, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id int, text string").parquet(str(tmp_path / "in"))
    run = pipeline.first_arrivals(source).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(pipeline.upsert_batches(spark, str(tmp_path / "out"), ["id"], [])).start()
    run.awaitTermination()
    assert sorted(r.id for r in pipeline.current(spark, str(tmp_path / "out")).collect()) == [1, 3]


def test_upserts_keep_the_last_row_of_each_key(spark, tmp_path):
    path = str(tmp_path / "state")
    assert pipeline.current(spark, path) is None
    write = pipeline.upsert_batches(spark, path, ["id"], [F.col("at")])
    batches = [[(1, 5, "a"), (2, 1, "b")], [(1, 4, "late"), (2, 1, "tie goes to the later batch"), (3, 1, "new")], [(3, 2, "newer")]]
    for n in (0, 1, 1, 2):  # one batch is run again
        write(spark.createDataFrame(batches[n], "id long, at int, said string"), n)
    assert {(r.id, r.said) for r in pipeline.current(spark, path).collect()} == {(1, "a"), (2, "tie goes to the later batch"), (3, "newer")}
    assert len(list((tmp_path / "state").glob("version=*"))) == 2


def test_searches_without_a_hit_or_an_index(spark):
    rows = spark.createDataFrame([(1, "Alpha beta", None), (2, "beta  BETA gamma", "2024-01-01"), (3, None, "2025-01-01"), (3, None, "2025-01-01")], "passage_id long, text string, doc_date string")
    assert retrieval.find(rows, '"" !!').columns == ["passage_id", "text", "doc_date", "score", "snippet"] and retrieval.find(rows, "!!").count() == 0
    assert [(r.passage_id, r.snippet, r.score) for r in retrieval.find(rows, "beta").collect()] == [(2, "[beta]  BETA gamma", None), (1, "Alpha [beta]", None)]
    index = retrieval.build_index(rows)
    assert {(r.passage_id, r.snippet) for r in retrieval.find(rows.dropDuplicates(["passage_id"]), "gamma OR alpha", index=index).collect()} == {(1, "[Alpha] beta"), (2, "beta  BETA [gamma]")}
    assert [tuple(r) for r in retrieval.related_by_words(rows, "The alpha and the beta").collect()] == [(1, 2), (2, 1)]
    assert retrieval.related_by_words(rows, "the").count() == 0
    got = views.looked_up(rows, [3, 9, 1, 3], "passage_id").orderBy("place").collect()
    assert [(r.place, r.passage_id, r.text) for r in got] == [(1, 3, None), (2, 9, None), (3, 1, "Alpha beta")]


def test_metric_report_of_a_hand_made_series(spark):
    day = __import__("datetime").date
    points = [
        (1, "guidance", day(2026, 1, 1), 20.0, 21.0, "filing", 0.9), (2, "guidance", day(2026, 3, 1), 21.0, 22.0, "filing", 0.9), (3, "guidance", day(2026, 9, 1), 30.0, 31.0, "filing", 0.9),
        (4, "reported", day(2026, 7, 1), 21.5, None, "news", 0.9), (5, "reported", day(2026, 6, 1), 22.4, None, "filing", 0.5), (6, "reported", None, None, None, "filing", 1.0),
        (7, "estimate", day(2026, 2, 1), 22.2, None, "sell_side", 0.9), (8, "estimate", day(2026, 2, 2), 22.45, None, "sell_side", 0.9), (9, "estimate", day(2026, 8, 1), 90.0, None, "sell_side", 0.9),
    ]
    df = spark.createDataFrame(points, "mention_id long, kind string, day date, value double, high double, source_type string, p double").withColumns({"metric": F.lit("m"), "unit": F.lit("%")})
    got = kpi.report(df, ["metric"]).collect()
    assert [tuple(r) for r in got] == [("m", 22.4, 3, 3, "above", "in_line", "raised")]
    assert kpi.report(df.limit(0), ["metric"]).count() == 0
    assert [tuple(r)[1:] for r in kpi.report(df.where("mention_id in (4, 9)"), ["metric"]).collect()] == [(21.5, 0, 1, None, None, None)]


def test_stored_postings_rank_as_the_index_does(spark, tmp_path):
    rows = frame_of_passages(spark)
    index, path = retrieval.build_index(rows), str(tmp_path / "postings")
    assert retrieval.Postings(spark, path).rank(retrieval.parse("a")).count() == 0
    for part in ("passage_id < 50", "passage_id >= 50", "passage_id < 0"):
        retrieval.Postings(spark, path).add(rows.where(part))
    store = retrieval.Postings(spark, path)
    assert store.batches == 3
    for text in ('revenue OR margin "compared with"', "rev* growth", '"the rev*" OR unheard', "the", "!!"):
        groups = retrieval.parse(text)
        want = {r.passage_id: round(r.score, 6) for r in retrieval.rank(index, groups).collect()}
        assert {r.passage_id: round(r.score, 6) for r in store.rank(groups).collect()} == want, text
    plan = store.of(["revenue", "growth"])._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :]
    assert "part#" in filters.split("PushedFilters")[0] and "In(word" in filters
    store.remove()
    assert retrieval.Postings(spark, path).batches == 0


def frame_of_passages(spark):
    return spark.read.parquet(f"{SF}/passages.parquet").select("passage_id", "text").dropDuplicates(["passage_id"]).where("passage_id is not null")


def test_dates_in_text(spark):
    text = "On Sept. 5, 2024 and 2024-02-30, then 3/4/2025, 7 March 2023, Sept. 5, 2024 and Feb 29, 2023."
    row = spark.range(1).select(dates.date_candidates(F.lit(text)).alias("d"), dates.date_candidates(F.lit(None).cast("string")).alias("n"), *[dates.is_iso_day(F.lit(x)).alias(f"i{i}") for i, x in enumerate(("2024-02-29", "2023-02-29", "2024-2-9", "x"))]).first()
    assert row.d == ["Sept. 5, 2024", "3/4/2025", "7 March 2023"] and row.n is None
    assert [row.i0, row.i1, row.i2, row.i3] == [True, False, False, False]


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["passage_id", "score", "doc_ticker"] and df.count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_number_mentions_read_whole_passages(spark, tmp_path):
    from tessera.functions import pyfuncs as py

    figures = " ".join(f"It grew {i}.5%." for i in range(50))
    texts = [
        (1, "Sales rose to $1.5 billion. Margin was 20% to 21%,\nafter costs fell by 25 bps.\n| (1.2%) | 30 days |"),
        (1, "Sales rose to $1.5 billion. Margin was 20% to 21%,\nafter costs fell by 25 bps.\n| (1.2%) | 30 days |"),
        (2, "No figures here."),
        (3, None),
        (4, ""),
        (5, "filler words only " * 2000 + "then 41,000 units were sold at 2.5x cover."),
        (6, figures),
    ]
    spark.createDataFrame(texts, "passage_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/passages.parquet")
    told = [(1, 2, "$1.5 billion", "Sales rose to $1.5 billion.")]  # an earlier cut must not be what is read
    spark.createDataFrame(told, "mention_id long, passage_id long, text string, sentence string").coalesce(1).write.parquet(f"{tmp_path}/mentions.parquet")
    got = slate.number_mentions(spark, str(tmp_path))
    assert got.columns == ["passage_id", "id", "text", "kind", "value", "high"]
    want = [
        (1, "m1", "$1.5 billion", "currency", 1.5e9, None),
        (1, "m2", "20% to 21%", "percent", 20.0, 21.0),
        (1, "m3", "25 bps", "bps", -25.0, None),
        (1, "m4", "(1.2%)", "percent", -1.2, None),
        (1, "m5", "30 days", "days", 30.0, None),
        (5, "m1", "41,000 units", "count", 41000.0, None),
        (5, "m2", "2.5x", "multiple", 2.5, None),
    ]
    want += [(6, f"m{i + 1}", f"{i}.5%", "percent", i + 0.5, None) for i in range(40)]  # the finder's limit
    assert rows(got) == sorted(want, key=str)
    plain_texts = duckdb.sql(f"select distinct passage_id, text from '{SF}/passages.parquet' where text is not null").fetchall()
    want = [(i, m["id"], m["text"], m["kind"], m["value"], m["high"]) for i, t in plain_texts for m in py.mentions_of(t)]
    assert rows(slate.number_mentions(spark, SF)) == sorted(want, key=str) and want

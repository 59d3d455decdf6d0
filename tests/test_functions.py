"""Native expressions and Python functions against plain definitions and hand-computed values."""

import datetime
import difflib
import hashlib
import json
import math
import re

import pytest

from tessera.functions import dates as dt
from tessera.functions import pyfuncs as py
from tessera.functions import text as tx
from tessera.operators import retrieval, units

TEXTS = ["", "Revenue grew 12.5% to $1,200 in Q3; it's year-over-year up", "a b", "The THE the 7 é été", None, "x" * 5000 + " end", "same same words words here 41,000 units", "  spaced \t\n out text "]


def test_text_expressions_equal_python(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r.i: r for r in df.select("i", tx.normalize("t").alias("n"), tx.tokens("t").alias("k"), tx.content_words("t").alias("w"), tx.shingles("t").alias("s"), tx.query_terms("t").alias("q"), tx.sha256("t").alias("h"), tx.estimated_tokens("t").alias("e"), tx.half("i").alias("half"), F.array_join(tx.tokens("t"), " ").alias("j")).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert r.half == int(hashlib.sha256(str(i).encode()).hexdigest(), 16) % 2
        if t is None:
            assert r.n is None and r.k is None
            continue
        k = re.findall(tx.TOKEN, t.lower())
        w = list(dict.fromkeys(x for x in k if x not in tx.STOPWORDS and (len(x) > 2 or any(c.isdigit() for c in x))))
        assert r.n == " ".join(t.lower().split()) and r.k == k and r.w == w
        assert set(r.s) == ({" ".join(k[j : j + 3]) for j in range(len(k) - 2)} if len(k) >= 3 else {" ".join(k)} if k else set())
        assert r.q == sorted(w, key=lambda x: (-len(x), w.index(x)))[:14]
        assert r.h == hashlib.sha256(t.encode()).hexdigest() and r.e == max(1, math.ceil(len(t) / 4))


def test_dates(spark):
    from pyspark.sql import functions as F

    days = [datetime.date(y, m, d) for y in (2020, 2021, 2026) for m, d in ((1, 1), (1, 4), (3, 31), (12, 28), (12, 31))]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    for r in df.select("d", dt.iso_week("d").alias("w"), dt.last_completed_quarter(F.col("d")).alias("q"), dt.nearest_year(F.lit(3), F.col("d")).alias("y")).collect():
        y, w, _ = r.d.isocalendar()
        assert r.w == f"{y:04d}-W{w:02d}"
        q = (r.d.month - 1) // 3
        assert r.q == (f"{r.d.year}-Q{q}" if q else f"{r.d.year - 1}-Q4")
        assert r.y == min((r.d.year - 1, r.d.year, r.d.year + 1), key=lambda y: abs((datetime.date(y, 3, 28) - r.d).days))
    written = ["March 5, 2026", "Sept. 5, 2026", "5 March 2026", "3/5/2026", "2026-03-05", "Mar 5, 2026", "soon", None, "2026-13-40"]
    got = [r.x for r in spark.createDataFrame([(w,) for w in written], "t string").select(dt.normalized_date("t").alias("x")).collect()]
    m = datetime.date(2026, 3, 5)
    assert got == [m, datetime.date(2026, 9, 5), m, m, m, m, None, None, None]
    keys = ["FY2026", "2026-Q4", "2026-12", "2026-H2", "2026-Q3", "2027-01"]
    order = spark.createDataFrame([(k,) for k in keys], "k string").orderBy(dt.period_order(F.col("k"))).select("k", dt.granularity(F.col("k")).alias("g"), dt.period_label(F.col("k")).alias("l")).collect()
    assert [r.k for r in order] == ["2026-Q3", "2026-12", "2026-Q4", "2026-H2", "FY2026", "2027-01"]
    assert [r.l for r in order] == ["Q3 2026", "Dec 2026", "Q4 2026", "H2 2026", "FY 2026", "Jan 2027"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Sales were $1.5 billion.", [("currency", 1.5e9, None)]),
        ("between $7.0-7.4 billion", [("currency", 7.0e9, 7.4e9)]),
        ("a loss of $(10) million", [("currency", -1e7, None)]),
        ("margin of 20% to 21%", [("percent", 20, 21)]),
        ("rates fell by 25 bps to 4.5%", [("bps", -25, None), ("percent", 4.5, None)]),
        ("fell to 20.6%", [("percent", 20.6, None)]),
        ("an 8% decline", [("percent", -8, None)]),
        ("| (1.2%) | 3.4% |", [("percent", -1.2, None), ("percent", 3.4, None)]),
        ("Europe (25%) led", [("percent", 25, None)]),
        ("30 to 45 days and 2.5x cover", [("days", 30, 45), ("multiple", 2.5, None)]),
        ("1,200 fewer units in 2026 than the 41,000 units of 2025", [("count", -1200, None), ("count", 41000, None)]),
        ("3 new models, 12 of them", []),
        ("", []),
    ],
)
def test_mentions(text, want):
    assert [(m["kind"], pytest.approx(m["value"]), m["high"]) for m in py.mentions_of(text)] == want


def test_mention_ids_sentences_and_limit():
    got = py.mentions_of("First 10%. Then 20% came. " + "5% " * 60)
    assert [m["id"] for m in got[:2]] == ["m1", "m2"] and got[1]["sentence"] == "Then 20% came." and len(got) == 40


@pytest.mark.parametrize(
    "text, want",
    [
        ("third quarter of fiscal 2026 and Q1 '25", ["2026-Q3", "2025-Q1"]),
        ("Q3 was good", ["2026-Q3"]),
        ("the first half, FY27 and full-year 2025", ["2026-H1", "FY2027", "FY2025"]),
        ("we may see; on September 18, 2026; in March 2026", ["2026-03"]),
        ("h1 2026 but H1 2026", ["2026-H1"]),
        ("Q4", ["2026-Q4"]),
    ],
)
def test_periods(text, want):
    assert [p["key"] for p in py.periods_of(text, datetime.date(2026, 9, 24))] == want


def test_ratio_and_diff():
    a, b = "the quick brown fox jumps", "the slow brown fox leaps high"
    x, y = (re.findall(tx.TOKEN, t) for t in (a, b))
    assert py.ratio_of(a, b) == difflib.SequenceMatcher(a=x, b=y, autojunk=False).ratio()
    steps = py.diff_of(a, b)
    assert "".join(s["text"] for s in steps if s["op"] != "+").split() == a.split()
    assert "".join(s["text"] for s in steps if s["op"] != "-").split() == b.split()
    assert all(p["op"] != q["op"] for p, q in zip(steps, steps[1:]))
    assert py.diff_of("", "") == []


def test_canonical_key(spark):
    df = spark.createDataFrame([('{"b": 1, "a": "é"}',), ("{broken",), (None,)], "p string")
    got = [r.k for r in df.select(py.canonical_key("p").alias("k")).collect()]
    assert got == [hashlib.sha256(json.dumps({"a": "é", "b": 1}, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest(), None, None]


@pytest.mark.parametrize(
    "query, want",
    [
        ("a b", [["a"], ["b"]]),
        ("a OR b c", [["a", "b"], ["c"]]),
        ('"two words" x*', [["two words"], ["x*"]]),
        ("OR a", [["a"]]),
        ("a AND b", [["a"], ["b"]]),
        ("--- !!", []),
        ("(gross) margin:", [["gross"], ["margin"]]),
        ("", []),
        ("a\x00b", [["a"], ["b"]]),
        ("or and", [["or"], ["and"]]),
    ],
)
def test_query_grammar(query, want):
    assert [[t.text + "*" * t.prefix for t in g] for g in retrieval.parse(query)] == want


def test_query_grammar_never_fails():
    import random

    rnd = random.Random(1234)
    parts = ['"', "*", "OR", "AND", " ", "a", "é", "(", ")", "\x00", "-", "NEAR(", "x*", ":", "\ud800", "^"]
    for _ in range(400):
        retrieval.parse("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))))


@pytest.mark.parametrize(
    "said, want",
    [("$ 000", "kUSD"), ("USD bn", "BUSD"), ("Mrd. Dollar", "BUSD"), ("mil millones de dólares", "BUSD"), ("thousands of tonnes", "kt"), ("K", "K"), ("$K", "kUSD"), ("m", "m"), ("miles", "mi"), ("miles de unidades", "kunit"), ("basis points", "bp"), ("°F", "degF"), ("sq ft", "ft2"), ("nonsense", None), ("", None), (None, None)],
)
def test_unit_spellings(said, want):
    assert units.read_unit(said) == want


@pytest.mark.parametrize(
    "text, sentence, want",
    [("5 009 millions de dollars", None, 5009), ("0,4249 Mrd. Dollar", None, 0.4249), ("1,234.5", None, 1234.5), ("1.234,5", None, 1234.5), ("4,303 km", "It stood at 4,303 km.", 4303), ("4,884 Hektar", "Für 2023 lag es bei 4,884 Hektar.", 4.884), ("(12.5)", None, -12.5), ("-7", None, -7), ("9.999.999", None, 9999999), ("0.876", None, 0.876)],
)
def test_number_styles(text, sentence, want):
    assert units.read_number(text, sentence)[0] == pytest.approx(want)


def test_conversions():
    paths = units.compositions()
    k, c, _ = paths["degF", "degC"]
    assert k * 212 + c == pytest.approx(100)
    k, c, n = paths["kt", "lb"]
    assert k == pytest.approx(1e6 / 0.45359237) and n == 3
    for (a, b), (k, c, _) in paths.items():
        kk, cc, _ = paths[b, a]
        assert kk * (k * 3.7 + c) + cc == pytest.approx(3.7)
    with pytest.raises(ValueError):
        units.compositions([("a", "b", 2, 0), ("b", "c", 3, 0), ("a", "c", 7, 0)])
    with pytest.raises(ValueError):
        units.compositions([("a", "b", 0, 0)])

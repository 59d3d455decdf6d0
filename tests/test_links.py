"""Candidates of passages, against brute force."""

from __future__ import annotations

import collections
import datetime
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.pyfuncs import ratio_of
from tessera.operators import linking
from tessera.operators.retrieval import index_words

WORDS = ["margin", "café", "don't", "3.5%", "warehouse-site", "İstanbul", "ΟΔΟΣ", "company", "revenue", "Ångström", "q3", "x", "²", "1,250", "naïve"] + [f"term{i}" for i in range(40)]


@pytest.fixture(scope="module")
def texts(spark):
    dice = random.Random(1)
    docs = spark.createDataFrame([(d, "AB"[d % 5 == 0], datetime.date(2025, 1, 1 + d // 3)) for d in range(40)], "document_id long, doc_ticker string, day date")
    passages = [(p, dice.randrange(40), " ".join(dice.choices(WORDS, k=dice.randrange(0, 25)))) for p in range(300)]
    return spark.createDataFrame(passages, "passage_id long, document_id long, text string").join(docs, "document_id").withColumn("seq", F.lit(1)).cache()


def _brute(rows, most):
    asked = F.array_distinct(F.flatten(F.transform(tx.query_terms("text"), index_words)))
    base = rows.select("passage_id", "doc_ticker", "day", "document_id", index_words("text").alias("words"), asked.alias("asked"), tx.content_words("text").alias("content")).collect()
    avg = sum(len(r.words) for r in base) / len(base)
    n = collections.Counter(w for r in base for w in set(r.words))
    out = set()
    for a in base:
        scores = []
        for b in base:
            if b.doc_ticker == a.doc_ticker and (b.day, b.document_id) < (a.day, a.document_id) and set(a.asked) & set(b.words):
                f = collections.Counter(b.words)
                idf = {w: math.log((len(base) - n[w] + 0.5) / (n[w] + 0.5)) for w in a.asked if n[w]}
                score = sum((i if i > 0 else 1e-6) * f[w] * 2.2 / (f[w] + 1.2 * (0.25 + 0.75 * len(b.words) / avg)) for w, i in idf.items())
                scores.append((-round(score, 6), b.passage_id, len(set(a.content) & set(b.content)) / max(1, len(set(a.content) | set(b.content)))))
        out |= {(a.passage_id, c, place, round(shared, 9)) for place, (_, c, shared) in enumerate(sorted(scores)[:most], 1)}
    return out


@pytest.mark.parametrize("tile, broadcast", [(8192, 10**6), (16, 10**6), (16, 3)])
def test_candidates(texts, monkeypatch, tile, broadcast):
    monkeypatch.setattr(linking, "TILE", tile)
    monkeypatch.setattr(linking, "CHUNK", tile)
    got = linking.candidates(texts, 5, broadcast=broadcast)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join Inner.*word", plan)  # no passage meets another in a shuffle
    assert {(r.passage_id, r.candidate_id, r.place, round(r.shared, 9)) for r in got.collect()} == _brute(texts, 5)


def test_words_are_those_of_the_expressions(texts):
    for r in texts.select("text", index_words("text").alias("w"), tx.content_words("text").alias("c"), F.array_distinct(F.flatten(F.transform(tx.query_terms("text"), index_words))).alias("a")).collect():
        assert linking.analysed(r.text) == (r.w, r.c, r.a)


def test_no_rows(texts):
    assert linking.candidates(texts.where("false")).count() == 0
    assert linking.links(texts.where("false")).count() == 0


def test_ratio_above_a_bound():
    assert ratio_of("a b c d", "a b c e", 0.7) == 0.75 and ratio_of("a b c d", "a b e f", 0.7) is None and ratio_of("d c b a", "a b c d", 0.7) == 0.25

"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest

from tessera.llm import cuts, encode, history, leaks, lines, neardup, subjects, turns

CLASH = ["node", "key", "keys", "mark", "a", "b", "h", "n", "source", "lo", "hi", "x", "y", "rank", "seq", "page", "at", "first", "words", "total"]
BODY = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 3


def with_clash(df):
    from pyspark.sql import functions as F

    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("clash"))
    return df


def docs(spark, rows):
    return with_clash(spark.createDataFrame(rows, "doc_id long, text string, source string, ingested_at timestamp"))


def passages(spark, rows):
    return with_clash(spark.createDataFrame(rows, "passage_id long, document_id long, seq int, page int, char_start int, char_end int, speaker string, text string"))


@pytest.fixture(scope="module")
def odd_docs(spark):
    long_ = " ".join(f"w{i}" for i in range(60_000))
    return docs(spark, [(1, BODY, "s", None), (2, BODY, "s", None), (2, BODY, "s", None), (3, None, None, None), (4, "", "s", None), (5, " \n\t", None, None), (6, long_, "s", None), (7, long_ + " end", "s", None), (None, BODY, "s", None), (8, "two words", "s", None), (9, "x" * 50_000, None, None)])


@pytest.fixture(scope="module")
def odd_passages(spark):
    return passages(spark, [(1, 1, 0, 1, 0, 10, None, BODY), (1, 1, 0, 1, 0, 10, None, BODY), (2, 1, 0, 1, 10, 20, "A B", BODY), (3, 2, None, None, None, None, "", None), (4, 3, 1, 1, 0, 0, None, ""), (5, None, 1, 1, 0, 5, "x", "alone"), (6, 2, 2, 9, 0, 99, None, "y" * 5000), (None, 2, 2, 1, 0, 1, None, BODY)])


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_near_duplicates(spark, odd_passages):
    assert rows(neardup.similar_pairs(odd_passages)) == [(1, 2)]
    assert {r.passage_id: (r.class_id, r.group_id, r.n_links) for r in neardup.similar_groups(odd_passages).collect()} == {1: (1, 1, 0), 2: (1, 1, 0)}
    assert rows(neardup.similar_pairs(odd_passages.limit(0))) == []


def test_a_hot_group_of_copies_stays_linear(spark):
    many = passages(spark, [(i, i, 0, 1, 0, 1, None, BODY) for i in range(200)] + [(1000, 1, 0, 1, 0, 1, None, BODY + "and one more")])
    assert [(r.lo, r.hi) for r in neardup.similar_classes(many).collect()] == [(0, 1000)]
    assert {(r.class_id, r.group_id, r.n_links) for r in neardup.similar_groups(many).collect()} == {(0, 0, 1), (1000, 0, 1)}


def test_history(spark, odd_docs):
    assert rows(history.rejected(odd_docs)) == [(2, 1), (7, 6)]
    assert rows(history.rejected(odd_docs.limit(0))) == []


def test_lines(spark, odd_docs):
    text = "Share this\nbody %d\n\n--- 1 ---\nSHARE this!"
    some = passages(spark, [(i, i, 0, 1, 0, 1, None, text % i) for i in range(4)] + [(9, None, 0, 1, 0, 1, None, text), (10, 77, 0, 1, 0, 1, None, text), (3, 3, 0, 1, 0, 1, None, text % 3), (11, 2, 0, 1, 0, 1, None, None)])
    known = docs(spark, [(i, None, None, None) for i in range(4)])
    assert rows(lines.repeated_lines(some, known)) == sorted([(i, n) for i in range(4) for n in (1, 2, 5)], key=str)
    assert rows(lines.repeated_lines(some.limit(0), known)) == []
    cleaned = {r.passage_id: r.text for r in lines.without_lines(some, lines.repeated_lines(some, known)).collect()}
    assert cleaned[0] == "\n--- 1 ---" and cleaned[11] is None and cleaned[10] == text


def test_leaks(spark, odd_docs):
    items = spark.createDataFrame([(1, BODY), (2, None), (3, ""), (4, "short text"), (1, BODY), (5, BODY.upper())], "item_id long, text string")
    assert rows(leaks.leaks(odd_docs, items)) == [(1, 1), (1, 5), (2, 1), (2, 5)]
    assert rows(leaks.leaks(odd_docs, items.limit(0))) == [] and rows(leaks.leaks(odd_docs.limit(0), items)) == []


def test_encode(spark, odd_docs):
    got = {r.doc_id: r.ids for r in encode.encode(odd_docs).collect()}
    assert set(got) == set(range(1, 10)) and got[3] == [] and got[4] == [] and got[1] == got[2]
    assert rows(encode.encode(odd_docs.limit(0))) == []


def test_subjects(spark, odd_docs):
    names = spark.createDataFrame([(1, "law"), (2, None)], "subject_id int, subject string")
    labels = spark.createDataFrame([(1, "LAW ", "a", None), (99, "law", "a", None), (1, "chess", "a", None), (None, "law", None, None)], "doc_id long, subject string, labeler string, labeled_at timestamp")
    assert isinstance(rows(subjects.subjects_of(odd_docs, labels, names)), list)
    assert rows(subjects.subjects_of(odd_docs, labels.limit(0), names)) == []
    assert rows(subjects.subjects_of(odd_docs.limit(0), labels, names)) == []


def test_cuts(spark, odd_passages):
    assert rows(cuts.cut_kinds(odd_passages)) == [(6, "inside")]
    pieces = cuts.cut_pieces(odd_passages).orderBy("piece_no").collect()
    assert [len(p.text) for p in pieces][0] == 1600 and pieces[-1].char_end == 5000
    assert rows(cuts.cut_pieces(odd_passages.limit(0))) == []


def test_turns(spark, odd_passages):
    people = spark.createDataFrame([(1, 1, None, None, None), (2, None, "A B", "x", "y"), (None, 1, "A B", None, None), (3, 1, "A B", "", "")], "document_id long, participant_no int, full_name string, job_title string, firm string")
    got = turns.turns(odd_passages, people, words=False)
    assert rows(got) == [(1, 1, 0, 1)]
    assert rows(turns.turns(odd_passages.limit(0), people)) == [] and rows(turns.turns(odd_passages, people.limit(0))) == []


@pytest.mark.parametrize("order", ["back", "shuffled"])
def test_components_of_long_chains(spark, order):
    import random

    from tessera.llm import near

    n = 300
    chain = [0, *range(n, 0, -1)]
    if order == "shuffled":
        random.Random(3).shuffle(chain)
    pairs = [(min(p), max(p)) for p in zip(chain, chain[1:])] + [(1000, 1001)]
    got = rows(near.components(spark.createDataFrame(pairs, "a long, b long")))
    assert got == sorted([(i, 0) for i in range(n + 1)] + [(1000, 1000), (1001, 1000)], key=str)


def test_a_passage_revised_step_by_step_is_one_group(spark):
    words = [f"w{i}" for i in range(5 * 400 + 40)]
    some = passages(spark, [(i, i, 0, 1, 0, 1, None, " ".join(words[5 * i : 5 * i + 40])) for i in range(400)])
    got = neardup.similar_groups(some).collect()
    assert len(got) == 400 and {r.group_id for r in got} == {0} and {r.n_links for r in got} == {1, 2}


def test_variants_with_one_shingle_set_are_one_class(spark):
    variants = [BODY + "." * i for i in range(12)]
    some = passages(spark, [(i, i, 0, 1, 0, 1, None, t) for i, t in enumerate(variants)] + [(1000, 1, 0, 1, 0, 1, None, BODY + "and one more")])
    want = {(i, j) for i in range(12) for j in range(i + 1, 12)} | {(i, 1000) for i in range(12)}
    assert set(rows(neardup.similar_pairs(some))) == want
    assert [(r.lo, r.hi) for r in neardup.similar_classes(some).collect()] == [(0, 1000)]


def test_all_pairs_of_a_large_group_of_copies(spark):
    some = passages(spark, [(i, i, 0, 1, 0, 1, None, BODY) for i in range(40)])
    assert len(rows(neardup.similar_pairs(some))) == 780
    assert rows(neardup.similar_classes(some)) == []
    assert {(r.class_id, r.group_id, r.n_links) for r in neardup.similar_groups(some).collect()} == {(0, 0, 0)}

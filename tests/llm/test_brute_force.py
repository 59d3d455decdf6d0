"""Each operator against a plain definition, on the smallest data."""

import collections
import random
import re

import duckdb
import pytest

from tessera.llm import cuts, encode, history, leaks, lines, near, neardup, subjects, turns

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\W_]+")


def read(name, columns):
    return duckdb.sql(f"select distinct {columns} from '{SF}/{name}.parquet'").fetchall()


def frame(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def shingles(text, k=3):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def like(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def test_near_duplicates_equal_all_pairs(spark):
    sets = {i: shingles(t) for i, t in read("passages", "passage_id, text") if t and len(WORD.findall(t.lower())) >= 30}
    index = collections.defaultdict(set)
    for i, s in sets.items():
        for x in s:
            index[x].add(i)
    want = set()
    for i, s in sets.items():
        for j in {j for x in s for j in index[x] if j > i}:
            if like(s, sets[j]) >= 0.7:
                want.add((i, j))
    got = {tuple(r) for r in neardup.similar_pairs(frame(spark, "passages")).collect()}
    assert got == want
    groups = {r.passage_id: r.group_id for r in neardup.similar_groups(frame(spark, "passages")).collect()}
    assert set(groups) == set(sets)
    assert all(groups[a] == groups[b] for a, b in want)


def arrivals():
    rows = [(i, t, at) for i, t, at in read("documents", "doc_id, text, ingested_at") if t and shingles(t)]
    return sorted(rows, key=lambda r: (r[2] is None, r[2], r[0]))


def wanted_rejections():
    accepted, want = [], set()
    for i, t, _ in arrivals():
        s = shingles(t)
        twin = next((j for j, o in accepted if like(s, o) >= 0.8), None)
        if twin is None:
            accepted.append((i, s))
        else:
            want.add((i, twin))
    return want


@pytest.mark.parametrize("parts", [1, 3])
def test_history_equals_sequential_rule(spark, parts):
    assert {tuple(r) for r in history.rejected(frame(spark, "documents"), parts=parts).collect()} == wanted_rejections()


def test_history_in_batches_equals_one_batch(spark):
    docs = frame(spark, "documents")
    order = [i for i, *_ in arrivals()]
    known, got = history.History(spark), set()
    for part in (order[:40], order[40:41], order[41:]):
        batch = docs.where(docs.doc_id.isin(part))
        got |= {tuple(r) for r in known.check(batch).collect()}
    assert got == wanted_rejections()


def test_history_settles_hot_families_first(spark, monkeypatch):
    import random

    rnd = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    rows, n = [], 0
    for _ in range(4):  # families of different texts that are nearly all alike
        base = rnd.sample(words, 120)
        for _ in range(60):
            t = list(base)
            for _ in range(rnd.randint(0, 3)):
                t[rnd.randrange(120)] = rnd.choice(words)
            rows.append((n, " ".join(t)))
            n += 1
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").selectExpr("*", "cast(null as timestamp) as ingested_at")
    accepted, want = [], set()
    for i, t in sorted(rows):
        s = shingles(t)
        twin = next((j for j, o in accepted if like(s, o) >= 0.8), None)
        if twin is None:
            accepted.append((i, s))
        else:
            want.add((i, twin))
    made = []
    whole = history._pairs
    monkeypatch.setattr(history, "_pairs", lambda *a: made.append(whole(*a)) or made[-1])
    for hot in (10, 500):
        got = {tuple(r) for r in history.History(spark, hot=hot).check(docs, append=False).collect()}
        assert got == want
    assert len(made) == 1 and made[0].count() < 240 * len(accepted)
    known, got = history.History(spark, hot=10), set()
    for part in ("doc_id < 50", "doc_id >= 50"):
        got |= {tuple(r) for r in known.check(docs.where(part)).collect()}
    assert got == want


def test_repeated_lines_equal_sql(spark):
    d = SF
    sql = f"""with l as (select distinct p.passage_id, p.document_id, source, unnest(string_split(p.text, chr(10))) line, generate_subscripts(string_split(p.text, chr(10)), 1) line_no from '{d}/passages.parquet' p join '{d}/documents.parquet' d on d.doc_id = p.document_id),
    n as (select *, regexp_replace(lower(line), '[^\\p{{L}}]', '', 'g') k from l), t as (select source, count(distinct doc_id) total from '{d}/documents.parquet' group by 1),
    f as (select source, k from n where k <> '' group by 1, 2 having count(distinct document_id) >= 3 and count(distinct document_id) >= 0.05 * (select total from t where t.source = n.source))
    select distinct passage_id, line_no from n join f using (source, k)"""
    removed = lines.repeated_lines(frame(spark, "passages"), frame(spark, "documents"))
    want = set(duckdb.sql(sql).fetchall())
    assert {tuple(r) for r in removed.collect()} == want and want
    texts = dict(read("passages", "passage_id, text"))
    gone = collections.defaultdict(set)
    for p, n in want:
        gone[p].add(n)
    for r in lines.without_lines(frame(spark, "passages"), removed).collect():
        t = texts[r.passage_id]
        assert r.text == (t if r.passage_id not in gone else "\n".join(x for n, x in enumerate(t.split("\n"), 1) if n not in gone[r.passage_id]))


def test_leaks_equal_scan(spark):
    index = collections.defaultdict(set)
    for i, t in read("eval_items", "item_id, text"):
        for x in shingles(t or "", 13):
            index[x].add(i)
    want = {(d, i) for d, t in read("documents", "doc_id, text") if t for x in shingles(t, 13) for i in index.get(x, ())}
    docs, items = frame(spark, "documents"), frame(spark, "eval_items")
    assert {tuple(r) for r in leaks.leaks(docs, items).collect()} == want and want
    assert {tuple(r) for r in leaks.leaks(docs, items, block=900).collect()} == want


def test_ids_equal_the_public_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    extra = [(900001, ""), (900002, None), (900003, "<|endoftext|> x y  z \U0001f600\U00010400a 12½ é́ don't'll"), (900004, "a" * 20000), (900005, " \n\n  \t"), (900006, "x\x1cy\x85z")]
    docs = frame(spark, "documents").select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    for size in (5, 50_000):
        got = {r.doc_id: r.ids for r in encode.encode(docs, lexicon=size).collect()}
        for r in docs.collect():
            assert got[r.doc_id] == t.encode(r.text or "", add_special_tokens=False).ids, r.doc_id


def test_lexicon_round_trip_and_sharing():
    words = {w.encode(): [i, i + 1][: 1 + i % 2] for i, w in enumerate(sorted({a + b + c for a in ("un", "re", "") for b in ("load", "pack", "tie") for c in ("", "s", "ed", "ing")}))}
    block = encode.compile_lexicon(words)
    lex = encode.Lexicon(None, block)
    assert all(lex.get(w) == tuple(ids) for w, ids in words.items())
    assert lex.get(b"loa") is None and lex.get(b"loadx") is None and lex.get(b"") is None
    assert len(lex.final) < 25  # a trie of these 36 words has over 60 states


def test_subjects_agree_with_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels, names = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "subject_labels", "subjects"))
    hidden = labels.where("doc_id % 3 = 0").join(docs.selectExpr("doc_id", "lower(lang) as lang"), "doc_id").collect()  # propagation never sees these
    got = collections.defaultdict(set)
    for r in subjects.subjects_of(docs, labels.where("doc_id % 3 <> 0"), names).collect():
        got[r.doc_id].add(r.subject)
    want = collections.defaultdict(set)
    for r in hidden:
        want[r.lang].add((r.doc_id, " ".join(r.subject.lower().split())))
    for lang in ("en", "de", "fr", "es"):
        share = sum(s in got[d] for d, s in want[lang]) / len(want[lang])
        assert share >= 0.85, (lang, share)
    every = set().union(*want.values())
    assert sum(s in got[d] for d, s in every) >= 0.93 * len(every)  # a few hand-given labels are wrong
    assert sum(len(got[d]) for d in {d for d, _ in every}) <= 1.25 * len(every)


@pytest.mark.parametrize("wrong", range(1, 5))
def test_subjects_come_from_every_document_that_is_alike(spark, wrong):
    # five documents that share all their words; one of the four labels is wrong, whichever it is
    text = "\n".join(f"anchor ballast capstan derrick fairlead gunwale {k}." for k in range(4))
    docs = [(i, f"s{i}", text) for i in range(5)]
    labels = [(i, "mines" if i == wrong else "ships", "x") for i in range(1, 5)]
    docs, labels, names = spark.createDataFrame(docs, "doc_id long, source string, text string"), spark.createDataFrame(labels, "doc_id long, subject string, labeler string"), spark.createDataFrame([("ships",), ("mines",)], "subject string")
    assert (0, "ships") in {tuple(r) for r in subjects.subjects_of(docs, labels, names, rounds=0).collect()}


@pytest.mark.parametrize("chunk, wanted", [(768, False), (7, False), (7, True)])
@pytest.mark.parametrize("rare", [0, 3, 10**9])
def test_every_two_documents_with_enough_in_common_are_linked(spark, monkeypatch, chunk, wanted, rare):
    rng = random.Random(5)
    monkeypatch.setattr(subjects, "CHUNK", chunk)
    monkeypatch.setattr(subjects, "RARE", rare)
    sets = {i: sorted(rng.sample(range(40), rng.choice([1, 2, 3, 8, 30]))) for i in range(120)} | {i: [3, 4, 9] for i in range(120, 130)}
    given = {(i, rng.choice("abc")): rng.choice([1.0, 0.5]) for i in range(0, 130, 2)}
    full = collections.defaultdict(float)
    for a, x in sets.items():
        for (b, subject), w in given.items():
            shared = len({*x} & {*sets[b]})
            if a != b and shared >= 2 and shared >= 0.15 * min(len(x), len(sets[b])):
                full[a, subject] += w * (shared / len({*x} | {*sets[b]})) ** 2
    docs, nodes = subjects._nodes(spark.createDataFrame([*sets.items()], "doc_id long, words array<int>"))
    labels = spark.createDataFrame([(*k, w) for k, w in given.items()], "doc_id long, subject string, weight double")
    asked = spark.createDataFrame([(i, s) for i in range(0, 130, 3) for s in "ab"], "doc_id long, subject string")
    got = {(r.doc_id, r.subject): r.s for r in subjects.neighbours(docs, nodes, labels, [*"abc"], asked if wanted else None).collect()}
    if wanted:
        assert {k for k in full if k[0] % 3 == 0 and k[1] != "c"} == {k for k in got if k[0] % 3 == 0 and k[1] != "c"}
    else:
        assert got == pytest.approx(full, rel=1e-5) and len({len(x) for x in sets.values()}) > 4


@pytest.mark.parametrize("tile", [131_072, 20])
def test_two_labelled_documents_are_compared_once_for_both(spark, monkeypatch, tile):
    rng = random.Random(6)
    monkeypatch.setattr(subjects, "CHUNK", 7)
    monkeypatch.setattr(subjects, "TILE", tile)
    sets = {i: sorted(rng.sample(range(40), rng.choice([2, 3, 8, 30]))) for i in range(120)} | {i: [3, 4, 9] for i in range(120, 130)}
    given = {(i, rng.choice("abc")): rng.choice([1.0, 0.5]) for i in range(128)}
    full = collections.defaultdict(float)
    for a, x in sets.items():
        for (b, subject), w in given.items():
            shared = len({*x} & {*sets[b]})
            if a != b and shared >= 2 and shared >= 0.15 * min(len(x), len(sets[b])):
                full[a, subject] += w * (shared / len({*x} | {*sets[b]})) ** 2
    docs, nodes = subjects._nodes(spark.createDataFrame([*sets.items()], "doc_id long, words array<int>"))
    labels = spark.createDataFrame([(*k, w) for k, w in given.items()], "doc_id long, subject string, weight double")
    assert {(r.doc_id, r.subject): r.s for r in subjects.neighbours(docs, nodes, labels, [*"abc"]).collect()} == pytest.approx(full, rel=1e-5)
    per = nodes.selectExpr("node", "array(0) as subjects", "array(1D) as weights")
    dealt, mutual = subjects._dealt(nodes, per, None, 3)
    compared, count = [], subjects._count
    monkeypatch.setattr(subjects, "_count", lambda *x: (compared.append(x[-1].size), count(*x)))
    assert list(subjects._tiled(iter(dealt.toArrow().to_batches()), 3, False, mutual))
    assert sum(compared) <= 0.6 * nodes.count() ** 2


def test_sentence_ends_are_those_of_the_rules():
    rng = random.Random(7)
    words, marks = ["a", "no", "i.e", "p.ex", "n°", "İ", "Σ", "x_y", "Art", "max", "langes", "1", "12"], [*".!?…\"'”»)] \n\f\x1c“„(-", "..", " ", " ", " "]
    texts = ["".join(rng.choice(words if rng.random() < 0.45 else marks) for _ in range(rng.randint(0, 40))).lower() for _ in range(3000)] + ["", ".", "." * 50, ")" * 50, 'a."."', "x" * 30 + "."]
    for some in (texts, [""], ["."], ["ab."]):
        laid = subjects.wh.laid_out(some)
        h, owner, start, end = subjects.wh.words(some, laid)
        want = [laid[1][i] + m.end() for i, t in enumerate(some) for m in subjects._END.finditer(t) if subjects._ends_here(t, m)]
        assert subjects._sentence_ends(some, laid, h, laid[1][owner] + start, laid[1][owner] + end).tolist() == want


def test_subjects_with_many_telling_words_are_joined(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    docs, labels, names = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "subject_labels", "subjects"))
    sent = {tuple(r) for r in subjects.subjects_of(docs, labels, names).collect()}
    monkeypatch.setattr(near, "BROADCAST_IDS", 3)
    assert {tuple(r) for r in subjects.subjects_of(docs, labels, names).collect()} == sent and sent


def test_cuts_cover_the_text_within_the_limit(spark):
    for _, t in read("passages", "passage_id, text"):
        if not t:
            continue
        for limit, overlap in ((1600, 200), (120, 30), (40, 0)):
            ps = cuts.pieces(t, limit, overlap)
            assert "".join(t[own:end] for _, end, own, _ in ps) == t
            assert all(len(t[a:b].rstrip()) <= limit and 0 <= own - a <= overlap for a, b, own, _ in ps)
    docs = dict(read("documents", "doc_id, text"))
    for r in cuts.cut_pieces(frame(spark, "passages"), frame(spark, "documents"), limit=300, overlap=40).collect():
        page = docs[r.document_id].split("\f")[r.page - 1]
        raw = page[r.char_start : r.char_end]
        assert len(r.text) <= 300 and (raw.split() == r.text.split() or len(page) < r.char_end)


def test_cut_kinds():
    long_ = "word " * 400
    assert cuts.cut_kind("A b. " * 400) == "boundary"
    assert cuts.cut_kind(long_) == "inside"
    assert cuts.cut_kind("line of words\n" * 200) == "boundary"
    assert cuts.cut_kind(("word " * 100 + "approx. " + "No. 5 i.e. x ") * 4) == "inside"
    assert cuts.cut_kind("x" * 1601) == "inside"
    assert cuts.cut_kind("A. " * 30_000) == "inside"  # initials, none of which ends a sentence
    assert cuts.cut_kind("5 A. " * 30_000) == "boundary"
    text, raw = "ab  c\nd", "ab c \n d"
    assert cuts.places(text, raw) == [0, 1, -1, -1, 3, -1, 7] and cuts.places(text, "abx") is None
    assert cuts.place(cuts.places(text, raw), 10, 2, 7) == (13, 18) and cuts.place(None, 10, 2, 7) == (12, 17)


def test_turns_of_a_hand_made_call(spark):
    people = [(7, 1, "Operator", "Conference Operator", None), (7, 2, "Ada Brook", "Chief Financial Officer", "Acme"), (7, 3, "Cyd Dorn", "Analyst", "Peak"), (7, 3, "Cyd Dorn", "Analyst", None)]
    said = [
        (1, 7, 0, "OPERATOR", "Welcome."),
        (2, 7, 1, "brook, ada", "[00:01] Um, thanks.\nGuidance: up."),
        (3, 7, 2, "Dorn", "(laughter) uh,"),
        (4, 7, 3, None, "We grew."),
        (5, 7, 4, None, "And more.\n>> C. Dorn: You know, why?\nUnknown Speaker: Because."),
        (6, 7, 5, "Speaker 2", "Right."),
        (7, 7, 6, "CFO", "Still me."),
        (8, 7, 7, "Cyd Donr", "Typo."),
        (9, 9, 0, "Nobody", "No participants here."),
    ]
    got = turns.turns(spark.createDataFrame(said, "passage_id long, document_id long, seq int, speaker string, text string"), spark.createDataFrame(people, "document_id long, participant_no int, full_name string, job_title string, firm string"))
    assert [tuple(r) for r in got.orderBy("turn_no").collect()] == [
        (7, 1, 1, 1, "Welcome."),
        (7, 2, 2, 2, "thanks.\nGuidance: up.\nWe grew.\nAnd more."),
        (7, 3, 3, 5, "why?"),
        (7, 4, 0, 5, "Because."),
        (7, 5, 2, 6, "Right.\nStill me."),
        (7, 6, 3, 8, "Typo."),
    ]


def drifting(spark, families=3, n=60, step=5, length=100):
    """(documents, expected pairs, documents of the first batch): families whose texts move on word by word; every ninth one arrives in the first batch."""
    import random

    rnd = random.Random(11)
    texts = [" ".join(f"f{f}w{step * i + j}" for j in range(length)) for f in range(families) for i in range(n)]
    first = [t for i, t in enumerate(texts) if i % n % 9 == 0]
    later = [t for i, t in enumerate(texts) if i % n % 9]
    rnd.shuffle(later)
    docs = list(enumerate(first + later))
    accepted, want = [], set()
    for i, t in docs:
        s = shingles(t)
        twin = next((j for j, o in accepted if like(s, o) >= 0.8), None)
        if twin is None:
            accepted.append((i, s))
        else:
            want.add((i, twin))
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "timestamp_micros(doc_id * 1000000) as ingested_at"), want, len(first)


def test_history_remembers_rejections_while_it_settles_hot_families(spark):
    docs, want, n = drifting(spark)
    known = history.History(spark, hot=5)
    got = {tuple(r) for r in known.check(docs.where(f"doc_id < {n}")).collect()}
    got |= {tuple(r) for r in known.check(docs.where(f"doc_id >= {n}"), append=False).collect()}
    assert got == want


def test_history_is_opened_again(spark, tmp_path):
    docs = frame(spark, "documents")
    order, got = [i for i, *_ in arrivals()], set()
    for part in (order[:40], order[40:70], order[70:]):
        got |= {tuple(r) for r in history.History(spark, str(tmp_path / "index")).check(docs.where(docs.doc_id.isin(part))).collect()}
    assert got == wanted_rejections()
    again = history.History(spark, str(tmp_path / "index"))
    assert again.batches == 3 and again.counts.any()
    with pytest.raises(ValueError):
        history.History(spark, str(tmp_path / "index"), least=0.7)


def test_history_in_batches_by_time_equals_sequential_rule(spark):
    from tessera.llm import queries

    want = {(min(p), max(p)) for p in wanted_rejections()}
    assert {tuple(r) for r in queries.p4_found(spark, SF).collect()} == want and want


@pytest.mark.parametrize("alone", [1_000_000, 1_080])
def test_verdicts_of_a_long_chain(spark, monkeypatch, alone):
    monkeypatch.setattr(history, "ALONE", alone)  # with 1,080, some rounds of joins come first
    n = 1100
    nodes = spark.createDataFrame([(i, i == 0) for i in range(n)], "node long, accepted boolean")
    links = [(i, i + 1) for i in range(n - 1)] + [(i, i + 7) for i in range(0, n - 7, 50)]
    before = {}
    for a, b in links:
        before.setdefault(b, []).append(a)
    want = {}
    for i in range(n):
        want[i] = "out" if any(want[e] == "in" for e in before.get(i, ())) else "in"
    got = history._decide(nodes, spark.createDataFrame(links, "early long, late long")).collect()
    assert len(got) == n and {r.node: r.verdict for r in got} == want


def test_history_is_read_where_it_lies(spark, tmp_path):
    docs = frame(spark, "documents")
    index = history.History(spark, str(tmp_path / "index"))
    index.check(docs.where("doc_id < 60"))
    index = history.History(spark, str(tmp_path / "index"))
    name, segments = index._segments()
    try:
        many = spark.range(5000).selectExpr("id as key", "id as node").repartition(index.buckets, "key").cache()
        plan = index.meeting(many, segments)._jdf.queryExecution().optimizedPlan().toString()
        joined = segments.join(many.withColumnRenamed("node", "a").hint("shuffle_hash"), "key")._jdf.queryExecution().executedPlan().toString()
        scan = joined[joined.index("Scan parquet") :]
        assert "Join" in plan and "Exchange hashpartitioning(key" not in joined.split("InMemoryRelation")[0] and "Bucketed: true" in scan
        few = spark.createDataFrame([(segments.first().key, -1)], "key long, node long").repartition(index.buckets, "key").cache()
        pruned = index.meeting(few, segments)
        assert pruned.count() >= 1
        assert f"SelectedBucketsCount: 1 out of {index.buckets}" in pruned._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sql(f"drop table {name}")


def test_history_part_that_broke_off_is_written_anew(spark, tmp_path):
    docs = frame(spark, "documents")
    order, got = [i for i, *_ in arrivals()], set()
    path = str(tmp_path / "index")
    for n, part in enumerate((order[:50], order[50:])):
        batch = docs.where(docs.doc_id.isin(part))
        history.History(spark, path).check(batch)
        (tmp_path / "index" / "batches" / str(n)).unlink()  # as if it had ended before its mark
        got |= {tuple(r) for r in history.History(spark, path).check(batch).collect()}
    assert got == wanted_rejections()


def test_history_tells_chance_meetings_where_keys_meet(spark, monkeypatch):
    import random

    rnd = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    stock = [" ".join(rnd.choices(words, k=12)) for _ in range(60)]
    texts = [" ".join(rnd.sample(stock, 20)) for _ in range(300)]  # any two share about a fifth of their shingles
    texts += [t.replace(" w1", " x1", 1) for t in texts[:20]] + texts[:5] * 3  # alike ones, and copies
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "cast(null as timestamp) as ingested_at").repartition(4)
    accepted, want = [], set()
    for i, t in enumerate(texts):
        s = shingles(t)
        twin = next((j for j, o in accepted if like(s, o) >= 0.8), None)
        if twin is None:
            accepted.append((i, s))
        else:
            want.add((i, twin))
    checked, whole = [], near.promising
    monkeypatch.setattr(history, "COPIES", 0)  # keys made by several tasks are brought to one copy
    monkeypatch.setattr(near, "promising", lambda pairs, *a: checked.append(pairs.count()) or whole(pairs, *a))
    known, got = history.History(spark), set()
    for part in ("doc_id < 200", "doc_id >= 200"):
        got |= {tuple(r) for r in known.check(docs.where(part)).collect()}
    assert got == want and len(want) >= 35
    assert sum(checked) < 0.05 * 300 * 299 / 2

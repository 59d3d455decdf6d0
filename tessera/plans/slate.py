"""The query slate of the engine's own operators: each query on the whole tables, with its oracle in SQL where SQL can state it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dates as dt
from tessera.functions import pyfuncs as py
from tessera.functions import text as tx
from tessera.operators import calibration as cal
from tessera.operators import kpi, linking, retrieval, state, units, views
from tessera.operators import signals as sg
from tessera.session import cut, shared_dir, spread, table
from tessera.sources import extract
from tessera.streaming import pipeline

TODAY = "2026-09-30"
PILLARS = ["p1", "p2", "p3", "p4", "p5"]
GRID = [round(0.05 * i, 2) for i in range(1, 20)]
SEARCH = 'turbine OR reactor OR substation "working capital"'
PREFIX = "sub* grid"
PLAIN_SEARCH = '"offshore" "working capital" OR headcount'
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


# Pieces of SQL that several oracles share.
_BLANK = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_NORM = lambda c: f"trim(regexp_replace(lower({c}), '{_BLANK}', ' ', 'g'))"
_SQUEEZE = lambda c: f"trim(regexp_replace({c}, '{_BLANK}', ' ', 'g'))"
_TOKEN = tx.TOKEN.replace("'", "''")
_TOKENS = lambda c: f"regexp_extract_all(lower({c}), '{_TOKEN}')"
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in tx.STOPWORDS)
_CONTENT = lambda c: f"list_filter({_TOKENS(c)}, lambda w: w not in ({_STOP}) and (length(w) > 2 or regexp_matches(w, '[0-9]')))"
_INDEX = lambda c: f"regexp_extract_all(translate(lower(coalesce({c}, '')), '{retrieval.MARKED}', '{retrieval.PLAIN}'), '[\\p{{L}}\\p{{N}}]+')"
_LATEST = "select * from (select *, row_number() over (partition by passage_id, part order by created_at desc, cache_key desc) k from (select distinct * from judgments where status = 'judged' and answers_json is not null)) where k = 1"
_SIGNALS = f"""select passage_id, answers_json ->> '$.pillar.choice' pillar, (answers_json ->> '$.pillar.confidence')::double pillar_p, coalesce((answers_json ->> '$.boilerplate.noul')::double, 0) boilerplate,
 coalesce((answers_json ->> '$.new_info.noul')::double, 0) new_info, coalesce((answers_json ->> '$.materiality.score')::double, 0) materiality
 from (select *, row_number() over (partition by passage_id order by part desc) m from ({_LATEST})) where m = 1 and answers_json ->> '$.pillar.choice' is not null"""
_EVIDENCE = "case source_type when 'filing' then 'reported_result' when 'earnings_transcript' then 'guidance' when 'expert_call' then 'expert_opinion' when 'sell_side' then 'analyst_opinion' end"
_ROWS = f"""select s.*, d.doc_id, d.ticker, coalesce(d.doc_date, d.ingested_at::date) as day, {_EVIDENCE} as evidence, s.new_info * 4 as stance, p.txt as txt from ({_SIGNALS}) s
 join (select passage_id, any_value(document_id) document_id, any_value(text) txt from passages group by 1) p using (passage_id) join documents d on d.doc_id = p.document_id"""


def merged(spark: SparkSession, d: str) -> DataFrame:
    """(passage_id, p): the signals of the newest judged answers of every passage."""
    log = table(spark, d, "judgments").where("status = 'judged' and answers_json is not null").withColumn("answers", sg.answers("answers_json"))
    return state.merged_answers(log, ["passage_id"], order=[F.col("created_at"), F.col("cache_key")]).select("passage_id", sg.signals(F.col("answers")).alias("p")).where("p is not null")


def rows(spark: SparkSession, d: str) -> DataFrame:
    """Signals with their document; evidence is read off the source type and stance off the novelty, as the data has neither."""
    kind = F.when(F.col("source_type") == "filing", "reported_result").when(F.col("source_type") == "earnings_transcript", "guidance").when(F.col("source_type") == "expert_call", "expert_opinion").when(F.col("source_type") == "sell_side", "analyst_opinion")
    joined = linking.passage_rows(table(spark, d, "passages"), table(spark, d, "documents")).join(merged(spark, d), "passage_id")
    return joined.select(F.col("passage_id").alias("id"), F.col("document_id").alias("doc_id"), F.col("doc_ticker").alias("ticker"), "day", "text", kind.alias("evidence"), *[F.col(f"p.{c}") for c in ("pillar", "pillar_p", "boilerplate", "new_info", "materiality")], (F.col("p.new_info") * 4).alias("stance"))


def today():
    return F.to_date(F.lit(TODAY))


# Units (problem 5).


@query()
def p5_found(spark, d):
    return units.same_amounts(table(spark, d, "mentions"), table(spark, d, "metrics")).toDF("mention_lo", "mention_hi")


@query()
def p5_amounts(spark, d):
    return units.amounts(table(spark, d, "mentions"), table(spark, d, "metrics"))


# Projections, joins, counts.


@query("""select p.passage_id, d.ticker as doc_ticker, coalesce(d.doc_date, d.ingested_at::date) as day, d.title, p.page from (select distinct passage_id, document_id, page from passages) p join documents d on d.doc_id = p.document_id where d.status = 'sorted' and d.ticker is not null""")
def sorted_passages(spark, d):
    return linking.passage_rows(table(spark, d, "passages"), table(spark, d, "documents")).where("doc_status = 'sorted' and doc_ticker is not null").select("passage_id", "doc_ticker", "day", "title", "page")


@query("select d.ticker, count(distinct d.doc_id) as n_documents, count(p.passage_id) as n_passages from documents d left join (select distinct passage_id, document_id from passages) p on p.document_id = d.doc_id group by 1")
def counts_by_ticker(spark, d):
    p = table(spark, d, "passages").select("passage_id", "document_id").distinct()
    docs = table(spark, d, "documents")
    return docs.join(p, docs["doc_id"] == p["document_id"], "left").groupBy("ticker").agg(F.count_distinct("doc_id").alias("n_documents"), F.count("passage_id").alias("n_passages"))


@query("select status, origin, count(*) as n, count(distinct ticker) as n_tickers from documents group by 1, 2")
def documents_by_status(spark, d):
    return table(spark, d, "documents").groupBy("status", "origin").agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("n_tickers"))


@query("""select model, count(*) as n, coalesce(sum(input_tokens), 0)::bigint as tokens from (select model, input_tokens from judgments where status = 'judged' and created_at >= timestamp '2025-01-01' union all select model, input_tokens from judgments where status <> 'judged' and created_at >= timestamp '2025-01-01') group by 1""")
def usage_since(spark, d):
    log = table(spark, d, "judgments").where("created_at >= timestamp_ntz '2025-01-01'")
    both = log.where("status = 'judged'").select("model", "input_tokens").unionByName(log.where("status <> 'judged'").select("model", "input_tokens"))
    return both.groupBy("model").agg(F.count("*").alias("n"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("tokens"))


@query("select passage_id, lag(passage_id) over w as previous_id, lead(passage_id) over w as next_id, sha256(lag(text) over w) as context_sha from (select distinct passage_id, document_id, seq, text from passages) window w as (partition by document_id order by seq nulls first, passage_id)")
def neighbours(spark, d):
    once = table(spark, d, "passages").select("passage_id", "document_id", "seq", "text").distinct()
    return state.neighbours(once, "document_id", ["seq", "passage_id"], "passage_id", "text").select("passage_id", "previous_id", "next_id", tx.sha256("context").alias("context_sha"))


@query(f"select sha256({_NORM('text')}) as text_hash, count(*) as n, min(doc_id) as first_id from documents where text is not null group by 1")
def exact_dedup(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(tx.sha256(tx.normalize("text")).alias("text_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("select passage_id, repeat_of from (select passage_id, document_id, first_value(passage_id) over w as repeat_of, first_value(document_id) over w as first_doc from (select p.passage_id, p.document_id, p.seq, d.ticker, coalesce(d.doc_date, d.ingested_at::date) as day, sha256(p.text) as h from (select distinct passage_id, document_id, seq, text from passages where text is not null) p join documents d on d.doc_id = p.document_id where d.ticker is not null and coalesce(d.doc_date, d.ingested_at::date) is not null) window w as (partition by ticker, h order by day, document_id, seq nulls first, passage_id)) where first_doc <> document_id")
def exact_repeats(spark, d):
    return linking.exact_repeats(linking.passage_rows(table(spark, d, "passages"), table(spark, d, "documents")))


@query()
def passage_links(spark, d):
    return linking.links(linking.passage_rows(table(spark, d, "passages"), table(spark, d, "documents")))


# Text functions.


def _similar(spark, d):
    p = table(spark, d, "passages").select("passage_id", "similar_to", "text").distinct()
    old = p.select(F.col("passage_id").alias("similar_to"), F.col("text").alias("old")).distinct()
    return p.where("similar_to is not null").join(old, "similar_to")


@query(
    f"""with p as (select distinct passage_id, similar_to, text from passages), x as (select a.passage_id, list_distinct({_CONTENT('a.text')}) w, list_distinct({_CONTENT('b.text')}) v, {_TOKENS('a.text')} s, {_TOKENS('b.text')} t from p a join p b on b.passage_id = a.similar_to where a.text is not null and b.text is not null),
 y as (select *, list_distinct(case when len(s) = 0 then [] when len(s) < 3 then [array_to_string(s, ' ')] else [array_to_string(s[i:i+2], ' ') for i in range(1, len(s) - 1)] end) ss, list_distinct(case when len(t) = 0 then [] when len(t) < 3 then [array_to_string(t, ' ')] else [array_to_string(t[i:i+2], ' ') for i in range(1, len(t) - 1)] end) tt from x)
 select passage_id, round(case when len(w) = 0 or len(v) = 0 then 0 else len(list_intersect(w, v))::double / (len(w) + len(v) - len(list_intersect(w, v))) end, 6) as topic, round(case when len(ss) = 0 or len(tt) = 0 then 0 else len(list_intersect(ss, tt))::double / (len(ss) + len(tt) - len(list_intersect(ss, tt))) end, 6) as wording from y"""
)
def similarity_of_links(spark, d):
    return _similar(spark, d).where("text is not null and old is not null").select("passage_id", F.round(tx.jaccard(tx.content_words("text"), tx.content_words("old")), 6).alias("topic"), F.round(tx.jaccard(tx.shingles("text"), tx.shingles("old")), 6).alias("wording"))


@query()
def sequence_ratios(spark, d):
    return _similar(spark, d).select("passage_id", "similar_to", F.round(py.sequence_ratio("old", "text"), 4).alias("ratio"))


@query()
def word_diffs(spark, d):
    return _similar(spark, d).select("passage_id", "similar_to", F.explode(py.word_diff("old", "text")).alias("step")).groupBy("passage_id", "similar_to", F.col("step.op").alias("op")).agg(F.sum(F.length("step.text")).alias("chars"))


@query(f"select item_id, unnest(list_transform(list_sort(list_transform(list_distinct(w), lambda x: {{'size': -length(x), 'at': list_position(w, x), 'word': x}}))[1:14], lambda s: s.word)) as word from (select item_id, {_CONTENT('text')} w from eval_items)")
def query_terms(spark, d):
    return table(spark, d, "eval_items").select("item_id", F.explode(tx.query_terms("text")).alias("word"))


@query("select doc_id, (case when right(sha256(doc_id::varchar), 1) in ('0','2','4','6','8','a','c','e') then 0 else 1 end)::int as half, greatest(1, ceil(length(text) / 4.0))::bigint as tokens, substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) as slug from documents where text is not null")
def document_fields(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", tx.half("doc_id").alias("half"), tx.estimated_tokens("text").alias("tokens"), tx.slug("title").alias("slug"))


# Retrieval.


def _index(spark, d):
    return retrieval.build_index(spread(table(spark, d, "passages").select("passage_id", "text")))


def _bm25(frequencies: str, groups: str, where: str) -> str:
    return f"""with i as (select passage_id, {_INDEX('text')} w from (select passage_id, any_value(text) as text from passages where passage_id is not null group by 1)), c as (select count(*) n, avg(len(w)) a from i),
 m as (select passage_id, len(w) as l, {frequencies} from i), u as (select passage_id, l, term, f, groups from m, lateral (values {groups}) v(term, f, groups) where f > 0),
 r as (select term, count(*) k from u group by 1), s as (select passage_id, -sum(case when ln((n - k + 0.5) / (k + 0.5)) > 0 then ln((n - k + 0.5) / (k + 0.5)) else 1e-6 end * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a))) score, count(distinct groups) g from u join r using (term), c group by 1)
 select s.passage_id, round(score, 6) as score, d.ticker as doc_ticker from s join (select distinct passage_id, document_id from passages) p on p.passage_id = s.passage_id join documents d on d.doc_id = p.document_id where d.status = 'sorted' and {where} order by score, s.passage_id limit 50"""


def _hits(spark, d, text):
    hits = retrieval.search(_index(spark, d), linking.passage_rows(table(spark, d, "passages"), table(spark, d, "documents")).where("doc_status = 'sorted'").select("passage_id", "doc_ticker"), text)
    return hits.select("passage_id", F.round("score", 6).alias("score"), "doc_ticker")


@query(_bm25("len(list_filter(w, lambda x: x = 'turbine')) f1, len(list_filter(w, lambda x: x = 'reactor')) f2, len(list_filter(w, lambda x: x = 'substation')) f3, len([i for i in range(1, len(w)) if w[i] = 'working' and w[i + 1] = 'capital']) f4", "(1, f1, 1), (2, f2, 1), (3, f3, 1), (4, f4, 2)", "g = 2"))
def bm25_search(spark, d):
    return _hits(spark, d, SEARCH)


@query(_bm25("len(list_filter(w, lambda x: starts_with(x, 'sub'))) f1, len(list_filter(w, lambda x: x = 'grid')) f2", "(1, f1, 1), (2, f2, 2)", "g = 2"))
def prefix_search(spark, d):
    return _hits(spark, d, PREFIX)


@query(f"""select passage_id, doc_date from (select p.passage_id, d.doc_date, {_NORM('p.text')} t from (select distinct passage_id, document_id, text from passages) p join documents d on d.doc_id = p.document_id) where contains(t, 'offshore') and (contains(t, 'working capital') or contains(t, 'headcount')) order by doc_date desc nulls last, passage_id desc limit 50""")
def substring_search(spark, d):
    found = retrieval.substring_search(linking.passage_rows(table(spark, d, "passages"), table(spark, d, "documents")), PLAIN_SEARCH)
    return found.select("passage_id", "doc_date")


_SNIPPET = lambda text, needles: f"""(select case when m.pos > 81 then '… ' else '' end || substring({text}, greatest(m.pos - 80, 1), m.pos - greatest(m.pos - 80, 1)) || '[' || substring({text}, m.pos, m.size) || ']' || substring({text}, m.pos + m.size, 80) || case when m.pos + m.size + 80 <= length({text}) then ' …' else '' end
 from (select list_sort(list_filter([{', '.join(f"{{'pos': strpos(lower({text}), '{n}'), 'size': {len(n)}}}" for n in needles)}], lambda s: s.pos > 0))[1] m))"""  # noqa: E731


@query(f"""with h as (select p.passage_id, any_value(p.text) as body, any_value(d.doc_date) as day, any_value({_NORM('p.text')}) t from passages p join documents d on d.doc_id = p.document_id where d.status = 'sorted' and p.text is not null group by 1)
 select passage_id, coalesce({_SNIPPET('body', ['offshore', 'working capital', 'headcount'])}, substring(body, 1, 160)) as snippet from h where contains(t, 'offshore') and (contains(t, 'working capital') or contains(t, 'headcount')) order by day desc nulls last, passage_id desc limit 50""")
def found_without_index(spark, d):
    return retrieval.find(linking.passage_rows(table(spark, d, "passages"), table(spark, d, "documents")).where("doc_status = 'sorted'"), PLAIN_SEARCH).select("passage_id", "snippet")


@query(_SQL["bm25_search"].replace("select s.passage_id,", f"select s.passage_id, coalesce({_SNIPPET('p.body', ['turbine', 'reactor', 'substation', 'working capital'])}, substring(p.body, 1, 160)) as snippet,").replace("(select distinct passage_id, document_id from passages) p", "(select passage_id, any_value(document_id) as document_id, any_value(text) as body from passages group by 1) p"))
def found_by_index(spark, d):
    rows = linking.passage_rows(table(spark, d, "passages"), table(spark, d, "documents")).where("doc_status = 'sorted'").select("passage_id", "doc_ticker", "text")
    return retrieval.find(rows, SEARCH, index=_index(spark, d)).select("passage_id", F.round("score", 6).alias("score"), "doc_ticker", "snippet")


def _stored(spark, d, parts: int) -> retrieval.Postings:
    """The passages' stored index, added in ``parts`` batches of whole documents."""
    path = f"{shared_dir(spark).rstrip('/')}/postings-{uuid.uuid4().hex}"
    passages = table(spark, d, "passages").select("passage_id", "document_id", "text").where("passage_id is not null")
    for i in range(parts):
        retrieval.Postings(spark, path).add(passages.where(F.pmod(F.xxhash64("passage_id"), F.lit(parts)) == i))
    return retrieval.Postings(spark, path)


def _found_in_store(spark, d, text):
    index = _stored(spark, d, 2)
    rows = linking.passage_rows(table(spark, d, "passages"), table(spark, d, "documents")).where("doc_status = 'sorted'").select("passage_id", "doc_ticker")
    found = cut(index.search(rows, text).select("passage_id", F.round("score", 6).alias("score"), "doc_ticker"))
    index.remove()
    return found


@query(_SQL["bm25_search"])
def stored_search(spark, d):
    return _found_in_store(spark, d, SEARCH)


@query(_SQL["prefix_search"])
def stored_prefix_search(spark, d):
    return _found_in_store(spark, d, PREFIX)


LOOKED_UP = [40, 7, 40, 1000003, 12, 999999999, 7]


@query("select a.place, a.passage_id::bigint as passage_id, coalesce(p.document_id, -1) as document_id, p.passage_id is not null as known from (values (1, 40), (2, 7), (3, 1000003), (4, 12), (5, 999999999)) a(place, passage_id) left join (select distinct passage_id, document_id from passages) p on p.passage_id = a.passage_id")
def looked_up_passages(spark, d):
    rows = table(spark, d, "passages").select("passage_id", "document_id", F.lit(True).alias("known"))
    return views.looked_up(rows, LOOKED_UP, "passage_id").select("place", "passage_id", F.coalesce("document_id", F.lit(-1)).alias("document_id"), F.coalesce("known", F.lit(False)).alias("known"))


@query()
def snippets(spark, d):
    found = table(spark, d, "passages").dropDuplicates(["passage_id"]).where(F.contains(F.lower("text"), F.lit("working capital")))
    return found.select("passage_id", retrieval.snippet(F.col("text"), ["working capital"]).alias("snippet"))


@query(
    f"""with i as (select passage_id, {_INDEX('text')} w from (select passage_id, any_value(text) as text from passages where passage_id is not null group by 1)), c as (select count(*) n, avg(len(w)) a from i),
 q0 as (select item_id, list_transform(list_sort(list_transform(list_distinct(w), lambda x: {{'size': -length(x), 'at': list_position(w, x), 'word': x}}))[1:14], lambda s: s.word) ws from (select item_id, {_CONTENT('text')} w from eval_items)),
 q as (select distinct item_id, unnest(list_distinct(flatten(list_transform(ws, lambda x: {_INDEX('x')})))) word from q0), e as (select passage_id, len(w) l, unnest(w) word from i), f as (select passage_id, l, word, count(*) f from e where word in (select word from q) group by all), r as (select word, count(*) k from f group by 1),
 p as (select passage_id, word, case when ln((n - k + 0.5) / (k + 0.5)) > 0 then ln((n - k + 0.5) / (k + 0.5)) else 1e-6 end * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a)) part from f join r using (word), c), s as (select item_id, passage_id, round(-sum(part), 6) score from q join p using (word) group by 1, 2)
 select item_id as query_id, passage_id, score, place::int as place from (select *, row_number() over (partition by item_id order by score, passage_id) place from s) where place <= 5"""
)
def related_passages(spark, d):
    return retrieval.related(_index(spark, d), table(spark, d, "eval_items"), query_id="item_id", text="text")


_KEYS = "ticker, metric_id, metric_unit, period_key"


@query(f"""with m as (select distinct mention_id, document_id, ticker, metric_id, unit as metric_unit, period_key, value, high from mentions where value is not null and unit is not null and ticker is not null and metric_id is not null and period_key is not null and mention_id is not null),
 p as (select m.*, coalesce(high, value) as top, (value + coalesce(high, value)) / 2 as mid, coalesce(d.doc_date, date '0001-01-01') as came, coalesce(d.source_type_p, 0) as pr, case when high is not null then 'guidance' when d.source_type = 'sell_side' then 'estimate' else 'reported' end as kind,
 case d.source_type when 'filing' then 0 when 'earnings_transcript' then 1 else 2 end as rk from m join (select distinct doc_id, doc_date, source_type, source_type_p from documents) d on d.doc_id = m.document_id),
 r as (select {_KEYS}, came as rday, mid as rmid from (select *, row_number() over (partition by {_KEYS} order by rk, pr desc, came desc, mention_id desc) k from p where kind = 'reported') where k = 1),
 j as (select p.*, rday, rmid, strftime(came, '%Y%m%d') || lpad(mention_id::varchar, 15, '0') as seq from p left join r using ({_KEYS})),
 a as (select {_KEYS}, any_value(rmid) as reported, count(*) filter (kind = 'guidance') as n_guidance, count(*) filter (kind = 'estimate') as n_estimates, arg_max(value, seq) filter (kind = 'guidance' and came <= rday) as low, arg_max(top, seq) filter (kind = 'guidance' and came <= rday) as high,
 avg(mid) filter (kind = 'estimate' and came <= rday) as mean, list(mid order by seq) filter (kind = 'guidance') as mids, list(top - value order by seq) filter (kind = 'guidance') as widths from j group by {_KEYS})
 select {_KEYS}, round(reported, 6) as reported, n_guidance, n_estimates, case when reported is null or low is null then null when reported > high then 'above' when reported < low then 'below' else 'within' end as vs_guidance,
 case when reported - mean is null then null when abs(reported - mean) <= (case when lower(trim(metric_unit)) in ('%', 'percent', 'pct') then 0.1 else abs(mean) * 0.005 end) then 'in_line' when reported > mean then 'above' else 'below' end as vs_estimates,
 case when len(mids) > 1 then case when mids[-1] > mids[-2] then 'raised' when mids[-1] < mids[-2] then 'lowered' when widths[-1] < widths[-2] then 'narrowed' when widths[-1] > widths[-2] then 'widened' else 'maintained' end end as guidance_change from a""")
def metric_report(spark, d):
    """Stand-ins: a range is guidance, a broker's figure an estimate, any other figure is reported; its probability is that of its document's type."""
    m = table(spark, d, "mentions").select("mention_id", "document_id", "ticker", "metric_id", F.col("unit").alias("metric_unit"), "period_key", "value", "high").where("mention_id is not null and unit is not null and ticker is not null and metric_id is not null and period_key is not null").distinct()
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("doc_date").alias("day"), "source_type", F.col("source_type_p").alias("p")).distinct()
    kind = F.when(F.col("high").isNotNull(), "guidance").when(F.col("source_type") == "sell_side", "estimate").otherwise("reported")
    points = m.join(docs, "document_id").withColumn("kind", kind).withColumn("unit", F.col("metric_unit"))
    return kpi.report(points, ["ticker", "metric_id", "metric_unit", "period_key"]).withColumn("reported", F.round("reported", 6))


# Dates and periods.


_WRITTEN = dt.WRITTEN_DATE.replace("'", "''")


@query(f"""with t as (select doc_id, any_value(text) as body from documents group by 1), c as (select doc_id, unnest(regexp_extract_all(body, '{_WRITTEN}')) as written, generate_subscripts(regexp_extract_all(body, '{_WRITTEN}'), 1) k from t),
 n as (select doc_id, written, min(k) k, any_value(try_strptime(regexp_replace(replace(written, '.', ''), '\\bSept\\b', 'Sep'), ['%Y-%m-%d', '%B %d, %Y', '%b %d, %Y', '%d %B %Y', '%d %b %Y', '%m/%d/%Y']))::date as "day" from c group by 1, 2), r as (select *, row_number() over (partition by doc_id order by k) as place from n where "day" is not null)
 select doc_id, place::int as place, written, "day" from r where place <= 20""")
def date_candidates(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text").dropDuplicates(["doc_id"])
    each = rows.select("doc_id", F.posexplode(dt.date_candidates("text")).alias("k", "written"))
    return each.select("doc_id", (F.col("k") + 1).alias("place"), "written", dt.normalized_date(F.col("written")).alias("day"))


@query("select strftime(coalesce(doc_date, ingested_at::date), '%G-W%V') as week, count(*) as n from documents where coalesce(doc_date, ingested_at::date) is not null group by 1")
def documents_by_week(spark, d):
    day = dt.day_of(F.col("doc_date"), F.col("ingested_at"))
    return table(spark, d, "documents").where(day.isNotNull()).groupBy(dt.iso_week(day).alias("week")).agg(F.count("*").alias("n"))


@query("""with k as (select distinct period_key from mentions where period_key is not null union select distinct strftime(doc_date, '%Y-%m') from documents where doc_date is not null union select distinct strftime(doc_date, '%Y') || '-H' || (case when month(doc_date) < 7 then 1 else 2 end) from documents where doc_date is not null union select distinct 'FY' || strftime(doc_date, '%Y') from documents where doc_date is not null),
 g as (select period_key, case when period_key like 'FY%' then 'year' when regexp_matches(period_key, '-Q[0-9]$') then 'quarter' when regexp_matches(period_key, '-H[0-9]$') then 'half' when regexp_matches(period_key, '-[0-9][0-9]$') then 'month' end as grain, try_cast(regexp_extract(period_key, '([0-9]+)$', 1) as int) as n, regexp_extract(period_key, '([0-9]{4})', 1) as y from k)
 select period_key, grain, case grain when 'year' then 'FY ' || y when 'month' then strftime(make_date(y::int, n, 1), '%b') || ' ' || y else period_key[6:] || ' ' || y end as label, (case grain when 'year' then 12 when 'quarter' then 3 * n when 'half' then 6 * n else n end)::int as end_month from g where grain is not null""")
def period_fields(spark, d):
    """All keys of the mentions, and the months, halves and years of the documents' dates."""
    day = table(spark, d, "documents").select("doc_date").where("doc_date is not null")
    half = F.concat(F.year("doc_date").cast("string"), F.lit("-H"), F.when(F.month("doc_date") < 7, "1").otherwise("2"))
    keys = table(spark, d, "mentions").select("period_key").union(day.select(F.date_format("doc_date", "yyyy-MM"))).union(day.select(half)).union(day.select(F.concat(F.lit("FY"), F.year("doc_date").cast("string")))).distinct()
    key = F.col("period_key")
    return keys.where(dt.granularity(key).isNotNull()).select("period_key", dt.granularity(key).alias("grain"), dt.period_label(key).alias("label"), dt.period_order(key)["end_month"].alias("end_month"))


@query("select doc_id, year(b)::varchar || '-Q' || quarter(b)::varchar as quarter, doc_date as read_back from (select doc_id, doc_date, (date_trunc('quarter', doc_date) - interval 1 day)::date b from documents where doc_date is not null)")
def last_quarters(spark, d):
    forms = F.element_at(F.array(*[F.date_format("doc_date", f) for f in ("MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "M/d/yyyy", "yyyy-MM-dd")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, d, "documents").where("doc_date is not null").select("doc_id", dt.last_completed_quarter(F.col("doc_date")).alias("quarter"), dt.normalized_date(forms).alias("read_back"))


# Signals and analyses.


@query(f"select passage_id, part, cache_key, model from ({_LATEST})")
def latest_judgments(spark, d):
    log = table(spark, d, "judgments").where("status = 'judged' and answers_json is not null")
    return state.latest(log, ["passage_id", "part"], [F.col("created_at"), F.col("cache_key")]).select("passage_id", "part", "cache_key", "model")


@query(_SIGNALS)
def judged_signals(spark, d):
    return merged(spark, d).select("passage_id", *[F.col(f"p.{c}").alias(c) for c in ("pillar", "pillar_p", "boilerplate", "new_info", "materiality")])


@query(
    f"""with r as ({_ROWS}), g as (select pillar, m::date as monday from (select unnest(['p1','p2','p3','p4','p5']) as pillar) a, (select unnest(range(date_trunc('week', date '{TODAY}')::timestamp - interval 175 days, date_trunc('week', date '{TODAY}')::timestamp + interval 1 day, interval 7 days)) m) b),
 c as (select pillar, date_trunc('week', day)::date monday, sum((((materiality + 0.1)::decimal(18,6)) * (((stance - 2.0) / 2.0)::decimal(18,6)))::decimal(30,12))::double / sum((materiality + 0.1)::decimal(18,6))::double net, count(*) n from r where pillar_p >= 0.5 and boilerplate < 0.5 and day is not null and pillar in ('p1','p2','p3','p4','p5') group by 1, 2)
 select g.pillar, strftime(g.monday, '%G-W%V') as week, round(greatest(-1.0, least(1.0, net)), 3) + 0.0 as net, coalesce(n, 0)::bigint as n from g left join c on c.pillar = g.pillar and c.monday = g.monday"""
)
def heatmap_weekly(spark, d):
    return sg.heatmap(rows(spark, d), PILLARS, today())


@query(
    f"""with e as (select pillar as id, day, new_info as supports, boilerplate as contradicts, materiality, case evidence when 'reported_result' then 1.0 when 'guidance' then 0.8 when 'expert_opinion' then 0.6 when 'analyst_opinion' then 0.5 else 0.5 end ew from ({_ROWS}) where day is not null),
 f as (select id, date_trunc('month', day)::date as first, contradicts >= 0.7 as con, supports >= 0.7 and contradicts < 0.7 as pro, greatest(supports, contradicts) >= 0.5 as leans, ew * (supports - contradicts) * materiality / 3.0 delta from e),
 p as (select id, first, count(*) filter (pro) pro, count(*) filter (con) con, sum((case when leans then delta else 0 end)::decimal(20,9)) delta from f where con or pro or leans group by 1, 2), g as (select id, unnest(range(min(first)::timestamp, max(first)::timestamp + interval 1 day, interval 1 month))::date as first from p group by id)
 select g.id, strftime(g.first, '%Y-%m') as month, coalesce(pro, 0)::bigint as pro, coalesce(con, 0)::bigint as con, round(sum(coalesce(delta, 0)) over (partition by g.id order by g.first rows unbounded preceding)::double, 3) + 0.0 as balance from g left join p on p.id = g.id and p.first = g.first"""
)
def evidence_balance(spark, d):
    r = rows(spark, d)
    return sg.running_balance(r.select(F.col("pillar").alias("id"), "day", F.col("new_info").alias("supports"), F.col("boilerplate").alias("contradicts"), "materiality", "evidence"))


@query(
    f"""with r as (select *, (materiality + 0.1)::decimal(18,6) w from ({_ROWS}) where pillar_p >= 0.5 and boilerplate <= 0.3 and day >= date '{TODAY}' - 120 and evidence in ('guidance', 'expert_opinion')),
 s as (select pillar, round(sum((w * stance::decimal(18,6))::decimal(30,12)) filter (evidence = 'guidance')::double / sum(w) filter (evidence = 'guidance')::double, 3) as inside, count(*) filter (evidence = 'guidance') as n_inside, round(sum((w * stance::decimal(18,6))::decimal(30,12)) filter (evidence = 'expert_opinion')::double / sum(w) filter (evidence = 'expert_opinion')::double, 3) as outside, count(*) filter (evidence = 'expert_opinion') as n_outside from r group by 1)
 select pillar, inside, n_inside, outside, n_outside, round(inside - outside, 3) + 0.0 as gap, n_inside >= 3 and n_outside >= 3 and abs(round(inside - outside, 3)) >= 1.0 as flagged from s where n_inside > 0 and n_outside > 0"""
)
def divergence(spark, d):
    return sg.divergence(rows(spark, d), today()).select("pillar", "inside", "n_inside", "outside", "n_outside", "gap", "flagged")


@query(
    f"""with r as (select *, 1 - new_info as contradicts from ({_ROWS})), c as (select passage_id, day, new_info, contradicts >= 0.7 and materiality >= 1.0 and boilerplate <= 0.5 as raw, pillar <> 'off_thesis' and pillar_p >= 0.5 and boilerplate <= 0.3 and materiality >= 1.5 as sub from r)
 select passage_id, raw and coalesce(day >= date '{TODAY}' - 120, false) as in_contradictions, sub and not raw and coalesce(day >= date '{TODAY}' - 30, false) and new_info >= 0.6 as in_whats_new, sub and not raw and coalesce(day >= date '{TODAY}' - 30, false) and new_info >= 0.4 and new_info < 0.6 as in_maybe, raw or (sub and new_info >= 0.4) as flagged from c"""
)
def classify_feeds(spark, d):
    both = F.struct(F.col("new_info").alias("supports"), (1 - F.col("new_info")).alias("contradicts"))
    p = F.struct("pillar", "pillar_p", "boilerplate", "new_info", "materiality", F.create_map(F.lit("a"), both).alias("assumptions"), F.create_map().cast("map<string,double>").alias("questions"))
    got = rows(spark, d).withColumn("p", p).select("id", sg.classify(F.col("p"), F.col("day"), today(), F.lit(None).cast("string")).alias("c"))
    return got.select(F.col("id").alias("passage_id"), "c.in_contradictions", "c.in_whats_new", "c.in_maybe", "c.flagged")


@query(
    f"""with w as (select date '{TODAY}' - day as age, pillar, new_info >= 0.7 as pro, new_info <= 0.3 as con from ({_ROWS}) where day is not null and day <= date '{TODAY}'), s as (select pillar, count(*) filter (pro and age <= 182) a, count(*) filter (con and age <= 182) b, count(*) filter (pro and age between 183 and 364) x, count(*) filter (con and age between 183 and 364) y from w group by 1)
 select pillar, a as pro, b as con, case when a + b = 0 then 'quiet' when a > b and x < y then 'turning_for' when a < b and x > y then 'turning_against' when a >= 2 * b then 'holding' when b >= 2 * a then 'contradicted' else 'mixed' end as verdict from s"""
)
def verdict_windows(spark, d):
    age = F.datediff(today(), "day")
    pro, con, now, then = F.col("new_info") >= 0.7, F.col("new_info") <= 0.3, age <= 182, age.between(183, 364)
    per = rows(spark, d).where(F.col("day").isNotNull() & (age >= 0)).groupBy("pillar").agg(F.count_if(pro & now).alias("pro"), F.count_if(con & now).alias("con"), F.count_if(pro & then).alias("x"), F.count_if(con & then).alias("y"))
    return per.select("pillar", "pro", "con", sg.verdict(F.col("pro"), F.col("con"), F.col("x"), F.col("y")).alias("verdict"))


def _promised(spark, d):
    r = rows(spark, d).select("id", "pillar", F.col("ticker").alias("read_through"), "evidence", F.when(F.col("evidence") == "guidance", 1.0).otherwise(0.0).alias("forward_looking"), "pillar_p", "boilerplate", "materiality", "day", tx.content_words("text").alias("words"))
    return r, sg.promises(r, sg.Thresholds(pillar_min=0.3, boilerplate_max=0.8, materiality_min=1.0))


@query(
    f"""with r as (select passage_id, pillar, ticker, evidence, pillar_p, boilerplate, materiality, day, list_distinct({_CONTENT('txt')}) w from ({_ROWS}) where day is not null), a as (select * from r where evidence = 'guidance' and pillar <> 'off_thesis' and pillar_p >= 0.3 and boilerplate <= 0.8 and materiality >= 1), b as (select * from r where evidence = 'reported_result'),
 m as (select a.passage_id promise_id, b.passage_id result_id, b.day, case when len(a.w) = 0 or len(b.w) = 0 then 0 else len(list_intersect(a.w, b.w))::double / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) end shared from a join b on a.pillar = b.pillar and a.ticker is not distinct from b.ticker and b.day > a.day and b.day <= a.day + 450)
 select promise_id, result_id, round(shared, 6) as shared, place::int as place from (select *, row_number() over (partition by promise_id order by shared desc, day, result_id) place from m where shared >= 0.1) where place <= 3"""
)
def promise_result_pairs(spark, d):
    r, promised = _promised(spark, d)
    return sg.promise_results(promised, r)


@query()
def promise_ledger(spark, d):
    r, promised = _promised(spark, d)
    pairs = sg.promise_results(promised, r)
    judged = pairs.join(r.select(F.col("id").alias("result_id"), "day", "pillar_p"), "result_id").select("promise_id", "result_id", F.col("day").alias("at"), F.col("place").alias("seq"), F.col("pillar_p").alias("confirms"), (1 - F.col("pillar_p")).alias("misses"))
    open_ = promised.select(F.col("id").alias("promise_id"))
    return sg.ledger(open_, judged, r.select("id", "day"))


# State, memo, work.


@query("select passage_id, n::bigint as n from (select passage_id, count(distinct cache_key) n, count(distinct cache_key) filter (status = 'judged') k from judgments group by 1) where n = k")
def all_keys_present(spark, d):
    log = table(spark, d, "judgments")
    wanted = log.groupBy("passage_id").agg(F.collect_set("cache_key").alias("keys"))  # a passage has a few keys
    return state.all_present(wanted, log, id_="passage_id", keys="keys", key="cache_key", done=F.col("status") == "judged")


@query("select distinct passage_id from passages p where text is not null and not exists (select 1 from judgments j where j.passage_id = p.passage_id and j.part = 'p0' and j.status = 'judged')")
def pending_requests(spark, d):
    wanted = table(spark, d, "passages").where("text is not null").select("passage_id").distinct().withColumn("part", F.lit("p0"))
    return state.pending(wanted, table(spark, d, "judgments"), ["passage_id", "part"], F.col("status") == "judged").select("passage_id")


@query("select user_id, event_type, arg_max(event_id, struct_pack(ts := ts, i := event_id)) as event_id, arg_max(value, struct_pack(ts := ts, i := event_id)) as value from events group by 1, 2")
def latest_events(spark, d):
    return state.latest(table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query()
def request_keys(spark, d):
    return table(spark, d, "judgments").where("answers_json is not null").select("passage_id", "cache_key", py.canonical_key("answers_json").alias("canonical"))


# Filings compared.

_TWO = "select ticker, family, max(case when k = 1 then doc_id end) as new_id, max(case when k = 2 then doc_id end) as old_id from (select *, row_number() over (partition by ticker, family order by day desc, doc_id desc) k from (select doc_id, ticker, case when form in ('10-K', '10-K/A', '20-F', '40-F') then '10-K' when form in ('10-Q', '10-Q/A') then '10-Q' end family, coalesce(doc_date, ingested_at::date) as day from documents where ticker is not null) where family is not null and day is not null) where k <= 2 group by 1, 2 having max(case when k = 2 then doc_id end) is not null"


@query(_TWO)
def latest_two_filings(spark, d):
    return linking.latest_two(table(spark, d, "documents"))


@query()
def filing_redlines(spark, d):
    return linking.redlines(table(spark, d, "passages"), linking.latest_two(table(spark, d, "documents")))


@query(f"with t as ({_TWO}), p as (select distinct passage_id, document_id, {_NORM('text')} n from passages where text is not null) select t.ticker, t.family, count(distinct a.passage_id) filter (exists (select 1 from p b where b.document_id = t.old_id and b.n = a.n)) as unchanged, count(distinct a.passage_id) as n from t join p a on a.document_id = t.new_id group by 1, 2")
def unchanged_passages(spark, d):
    pairs = linking.latest_two(table(spark, d, "documents"))
    p = spread(table(spark, d, "passages").where("text is not null").select("passage_id", "document_id", "text")).select("passage_id", "document_id", tx.normalize("text").alias("norm")).distinct()
    new = pairs.join(p.withColumnRenamed("document_id", "new_id"), "new_id")
    old = p.select(F.col("document_id").alias("old_id"), "norm").distinct().withColumn("hit", F.lit(1))
    return new.join(old, ["old_id", "norm"], "left").groupBy("ticker", "family").agg(F.count_distinct(F.when(F.col("hit") == 1, F.col("passage_id"))).alias("unchanged"), F.count_distinct("passage_id").alias("n"))


# Series of figures.


@query(
    """with m as (select distinct mention_id, ticker, metric_id, unit, period_key, value, accession from mentions where value is not null and unit is not null and ticker is not null and period_key is not null), b as (select * from (select *, row_number() over (partition by ticker, metric_id, unit, period_key order by accession desc nulls last, mention_id desc) k from m) where k = 1),
 c as (select b.*, x.higher_is, lag(value) over (partition by ticker, b.metric_id, b.unit, case when period_key like 'FY%' then 'year' when period_key like '%-Q_' then 'quarter' when period_key like '%-H_' then 'half' else 'month' end order by substr(period_key, 1, 4), substr(period_key, 6)) previous from b join metrics x using (metric_id))
 select ticker, metric_id, unit, period_key, value, previous, round(value - previous, 6) as change, case when previous is null then null when round(value - previous, 6) = 0 then 'flat' when (round(value - previous, 6) > 0) = (higher_is <> 'bad') then 'good' else 'bad' end as direction from c"""
)
def metric_series(spark, d):
    points = table(spark, d, "mentions").where("value is not null and unit is not null and ticker is not null and period_key is not null").select("ticker", "metric_id", "unit", "period_key", "value", "accession", "mention_id")
    keys = ["ticker", "metric_id", "unit"]
    best = kpi.best_per_period(points, [*keys, "period_key"], [F.coalesce("accession", F.lit("")), F.col("mention_id")]).join(table(spark, d, "metrics").select("metric_id", "higher_is"), "metric_id")
    return kpi.with_change(best, keys).select(*keys, "period_key", "value", "previous", "change", "direction")


@query(
    """with m as (select distinct mention_id, metric_id, unit, accession, value, coalesce(high, value) high from mentions where value is not null and unit is not null and accession is not null), o as (select *, (value + high) / 2 mid, high - value width, lag((value + high) / 2) over w was_mid, lag(high - value) over w was_width, row_number() over (partition by accession, metric_id, unit order by mention_id desc) k from m window w as (partition by accession, metric_id, unit order by mention_id))
 select accession, metric_id, unit, case when was_mid is null then 'first' when mid > was_mid then 'raised' when mid < was_mid then 'lowered' when width < was_width then 'narrowed' when width > was_width then 'widened' else 'maintained' end as change from o where k = 1"""
)
def revisions(spark, d):
    m = table(spark, d, "mentions").where("value is not null and unit is not null and accession is not null").select("mention_id", "metric_id", "unit", "accession", "value", "high").distinct()
    return kpi.revision(m, ["accession", "metric_id", "unit"], ["mention_id"])


@query("select a.event_id, a.user_id, b.value as asof_value from (select * from events where event_type = 'purchase') a asof left join (select user_id, ts, max_by(value, event_id) as value from events where event_type <> 'purchase' group by 1, 2) b on a.user_id = b.user_id and a.ts >= b.ts")
def as_of_events(spark, d):
    e = table(spark, d, "events")
    left, right = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), e.where("event_type <> 'purchase'").select("user_id", "ts", "value", "event_id")
    return kpi.as_of(left, right, ["user_id"], "ts", "value", "event_id").select("event_id", "user_id", "asof_value")


@query()
def number_mentions(spark, d):
    p = table(spark, d, "passages").where("text is not null").select("passage_id", "text").dropDuplicates(["passage_id"])
    return p.select("passage_id", F.explode(py.find_mentions("text")).alias("m")).select("passage_id", "m.id", "m.text", "m.kind", "m.value", "m.high")


@query()
def period_mentions(spark, d):
    p = linking.passage_rows(table(spark, d, "passages"), table(spark, d, "documents")).where("text is not null and day is not null")
    return p.select("passage_id", F.explode(py.find_periods("text", "day")).alias("p")).select("passage_id", "p.key", "p.label", "p.written")


# Calibration.

_PAIRS = f"(select passage_id, new_info as signal, materiality >= 2 as label, round(1 + boilerplate, 3) as weight from ({_SIGNALS}))"
_D = "weight::decimal(18,6)"


def _pairs(spark, d):
    p = merged(spark, d)
    return p.select("passage_id", F.col("p.new_info").alias("signal"), (F.col("p.materiality") >= 2).alias("label"), F.round(1 + F.col("p.boilerplate"), 3).alias("weight"))


_AT = f"""select threshold, round(tp / nullif(flagged, 0), 6) as precision, round(tp / nullif(positives, 0), 6) as recall, flagged, positives, n_flagged, n_positives from (select threshold, coalesce(sum({_D}) filter (hit and label)::double, 0) tp, coalesce(sum({_D}) filter (hit)::double, 0) flagged, coalesce(sum({_D}) filter (label)::double, 0) positives,
 round(coalesce((sum({_D}) filter (hit)::double) * (sum({_D}) filter (hit)::double) / nullif(sum(({_D} * {_D})::decimal(30,10)) filter (hit)::double, 0), 0), 6) n_flagged, round(coalesce((sum({_D}) filter (label)::double) * (sum({_D}) filter (label)::double) / nullif(sum(({_D} * {_D})::decimal(30,10)) filter (label)::double, 0), 0), 6) n_positives
 from (select *, signal >= threshold hit from {_PAIRS}, (select unnest({GRID})::double threshold)) group by 1)"""


@query(_AT)
def threshold_metrics(spark, d):
    return cal.at_thresholds(_pairs(spark, d), GRID)


@query(f"select min(threshold) filter (precision >= 0.5) as for_precision, max(threshold) filter (recall >= 0.6) as for_recall from ({_AT})")
def chosen_thresholds(spark, d):
    return cal.select_thresholds(_pairs(spark, d), GRID, precision=0.5, recall=0.6)


_REL = lambda n: f"select b::int as bucket, b / {n}.0 as low, (b + 1) / {n}.0 as high, round(sum(({_D} * signal::decimal(18,6))::decimal(30,10))::double / sum({_D})::double, 6) as predicted, round(coalesce(sum({_D}) filter (label)::double, 0) / sum({_D})::double, 6) as observed, count(*) as n, sum({_D})::double as weight from (select *, least(floor(signal * {n}), {n} - 1) b from {_PAIRS}) group by b"


@query(_REL(5).replace("b / 5.0", "(b / 5.0)::double").replace("(b + 1) / 5.0", "((b + 1) / 5.0)::double"))
def reliability_bands(spark, d):
    return cal.reliability(_pairs(spark, d))


@query(
    f"""select round(sum(({_D} * (power(signal - label::int, 2)::decimal(18,10)))::decimal(36,16))::double / sum({_D})::double, 6) as brier, (select round(sum((weight * abs(predicted - observed))::decimal(30,10))::double / sum(weight), 6) from ({_REL(10)})) as ece, count(*) filter (signal >= 0.9 and not label) as sure_but_no, count(*) filter (signal <= 0.1 and label) as unsure_but_yes from {_PAIRS}"""
)
def probability_errors(spark, d):
    return cal.errors(_pairs(spark, d))


@query(
    """with s as (select part, count(*) filter (status = 'judged')::double k, count(*)::double n from (select distinct * from judgments) group by 1), w as (select part, k, n, k / n p from s) select part, round(greatest(0, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) as low, round(least(1, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n)), 6) as high from w"""
)
def judged_intervals(spark, d):
    per = table(spark, d, "judgments").distinct().groupBy("part").agg(F.count_if(F.col("status") == "judged").alias("k"), F.count("*").alias("n"))
    return per.select("part", cal.wilson(F.col("k"), F.col("n")).alias("i")).select("part", "i.low", "i.high")


@query(
    f"""with s as (select passage_id, flagged, row_number() over (partition by flagged order by sha256('7:' || passage_id::varchar), passage_id) k, count(*) over (partition by flagged) size from (select passage_id, new_info >= 0.8 as flagged from ({_SIGNALS}))), q as (select coalesce(max(size) filter (flagged), 0) yes, coalesce(max(size) filter (not flagged), 0) no from s), t as (select *, least(yes, greatest(100, 200 - no)) ty from q), u as (select *, least(no, 200 - ty) tn from t)
 select passage_id, flagged, round(size::double / (case when flagged then ty else tn end), 6) as weight from s, u where k <= (case when flagged then ty else tn end)"""
)
def labelling_sample(spark, d):
    return cal.stratified_sample(merged(spark, d).select("passage_id", (F.col("p.new_info") >= 0.8).alias("flagged")), "passage_id", "flagged", n=200, seed=7)


# Views.


@query("select p.passage_id, p.place::int as place, p.seen_id, q.document_id as seen_document from (select distinct passage_id, unnest(seen_ids) seen_id, generate_subscripts(seen_ids, 1) place from passages where len(seen_ids) > 0) p join (select distinct passage_id, document_id from passages) q on q.passage_id = p.seen_id")
def seen_links(spark, d):
    return views.seen_links(table(spark, d, "passages"))


@query("select p.passage_id, p.similar_to, q.document_id as similar_document, p.similarity from (select distinct passage_id, similar_to, similarity from passages) p left join (select distinct passage_id, document_id from passages) q on q.passage_id = p.similar_to")
def similar_links(spark, d):
    return views.similar_links(table(spark, d, "passages"))


@query(f"select case when outcome is not null then 'resolved' when b < date '{TODAY}' then 'overdue' when b <= date '{TODAY}' + 14 then 'due' else 'open' end as status, count(*) as n, round(sum((power(new_info - outcome::int, 2))::decimal(18,10))::double / nullif(count(outcome), 0), 4) as brier from (select (day + 90)::date b, new_info, case when materiality <> 1 then materiality >= 2 end outcome from ({_ROWS}) where day is not null) group by 1")
def prediction_scores(spark, d):
    r = rows(spark, d).where("day is not null")
    stated = r.select(F.col("id").alias("prediction_id"), F.date_add("day", 90).alias("by"), F.col("new_info").alias("p"))
    done = r.where("materiality <> 1").select(F.col("id").alias("prediction_id"), (F.col("materiality") >= 2).alias("outcome"))
    return views.prediction_score(views.predictions(stated, done, today()))


FACTS = ["Order backlog and gross margin rose", "Net leverage and free cash flow", "Customer churn widened in the export channel", "Lead time and inventory days fell", "Working capital, headcount and overhead", "Renewal rate of the subscription seat"]


@query(
    "with f as (select unnest([" + ", ".join(f"'{f}'" for f in FACTS) + "]) fact, unnest(range(" + str(len(FACTS)) + f")) i), w as (select item_id, list_distinct({_CONTENT('text')}) w from eval_items), x as (select item_id, i, case when len(w) = 0 then 0 else len(list_intersect(w, v))::double / (len(w) + len(v) - len(list_intersect(w, v))) end s from w, (select i, list_distinct({_CONTENT('fact')}) v from f)) select item_id, i::int as fact, place::int as place from (select *, row_number() over (partition by item_id order by s desc, i) place from x) where place <= 3"
)
def ranked_facts(spark, d):
    best = table(spark, d, "eval_items").select("item_id", F.posexplode(views.ranked_facts("text", FACTS, 3)).alias("at", "fact"))
    return best.select("item_id", "fact", (F.col("at") + 1).alias("place"))


@query(
    """with f as (select ticker, accession, form, doc_date as filed, (row_number() over (partition by ticker order by doc_date desc, doc_id desc) - 1)::int as position from documents where accession is not null and ticker is not null and doc_date is not null), c as (select ticker, accession as last_accession from f where position = 3),
 s as (select f.*, sum(case when f.accession = c.last_accession or f.filed < date '2025-06-01' then 1 else 0 end) over (partition by f.ticker order by position) stops from f left join c on c.ticker = f.ticker)
 select ticker, (row_number() over (partition by ticker order by position desc))::int as place, accession, form, filed from s where stops = 0 and form in ('10-K', '10-Q', '8-K')"""
)
def filings_since_cursor(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("ticker").orderBy(F.desc("doc_date"), F.desc("doc_id"))
    filed = table(spark, d, "documents").where("accession is not null and ticker is not null and doc_date is not null").select("ticker", "accession", "form", F.col("doc_date").alias("filed"), (F.row_number().over(by) - 1).alias("position"))
    cursors = filed.where("position = 3").select("ticker", F.col("accession").alias("last_accession"))
    return views.since_cursor(filed, cursors, cutoff=F.lit("2025-06-01").cast("date"), forms=["10-K", "10-Q", "8-K"])


@query("select x.metric_id, m.kind, count(*) as n from (select distinct mention_id, metric_id, kind from mentions) m join metrics x using (metric_id) where list_contains(case when lower(replace(x.unit, ' ', '')) in ('%', 'percent', 'pct') then ['percent'] when lower(replace(x.unit, ' ', '')) in ('bps', 'bp', 'basispoints') then ['bps'] when lower(replace(x.unit, ' ', '')) in ('pp', 'pts', 'points', 'percentagepoints') then ['bps', 'percent'] when x.unit like '$%' or lower(x.unit) in ('usd', 'dollars') then ['currency'] when lower(x.unit) in ('day', 'days') then ['days'] when lower(x.unit) in ('x', 'times', 'multiple') then ['multiple'] else ['count'] end, m.kind) group by 1, 2")
def compatible_mentions(spark, d):
    m = table(spark, d, "mentions").select("mention_id", "metric_id", "kind").distinct()
    kinds = table(spark, d, "metrics").select("metric_id", views.admissible_kinds(F.col("unit")).alias("kinds"))
    return m.join(kinds, "metric_id").where(F.array_contains("kinds", F.col("kind"))).groupBy("metric_id", "kind").agg(F.count("*").alias("n"))


@query("select ticker, doc_id from (select ticker, doc_id, row_number() over (partition by ticker order by sha256(ticker || ':2026-09-30:' || doc_id::varchar), doc_id) k from documents where ticker is not null) where k <= 20")
def spot_checks(spark, d):
    return views.spot_checks(table(spark, d, "documents"), "ticker", "doc_id", day=TODAY)


@query("select heavy, count(*) as n from (select distinct passage_id, length(regexp_replace(text, '[^0-9]', '', 'g')) >= length(regexp_replace(text, '[\t\n\x0b\f\r ]', '', 'g')) * 0.25 and length(regexp_replace(text, '[\t\n\x0b\f\r ]', '', 'g')) > 0 as heavy from passages where text is not null) group by 1")
def number_heavy_passages(spark, d):
    p = table(spark, d, "passages").where("text is not null").dropDuplicates(["passage_id"])
    return p.groupBy(views.number_heavy("text").alias("heavy")).agg(F.count("*").alias("n"))


# Sources and streams.


@query(f"select doc_id, length(regexp_replace(text, '[\\x{{1c}}-\\x{{1f}}]|{_BLANK}', '', 'g'))::bigint as n_chars from documents where text is not null and (source_type is null or source_type not in ('earnings_transcript', 'expert_call')) and length(regexp_replace(text, '[\\x{{1c}}-\\x{{1f}}]|{_BLANK}', '', 'g')) > 0")
def split_keeps_text(spark, d):
    docs = spread(table(spark, d, "documents").where("source_type is null or source_type not in ('earnings_transcript', 'expert_call')"))
    return extract.split_passages(docs).groupBy(F.col("document_id").alias("doc_id")).agg(F.sum(F.length(F.regexp_replace("text", r"(?U)[\x1c-\x1f\s]+", ""))).alias("n_chars"))


@query()
def split_transcripts(spark, d):
    return extract.split_passages(table(spark, d, "documents").where("source_type in ('earnings_transcript', 'expert_call')"))


@query(
    "select event_type as key, (date_trunc('week', ts))::date as week_start, round(sum(value::decimal(18,4))::double / count(*), 3) as net, count(*) as n from events group by 1, 2"
)
def tone_by_week(spark, d):
    return pipeline.tone_by_week(table(spark, d, "events"))


@query(_SQL["tone_by_week"])
def streamed_tone(spark, d):
    """The stream's updates of each week, open ones too, merged by key; at the end of the input it equals the batch."""
    events = table(spark, d, "events")
    root = f"{shared_dir(spark)}/tone-{uuid.uuid4().hex}"
    source = spark.readStream.schema(events.schema).parquet(_as_folder(spark, events, root))
    sink = pipeline.upsert_batches(spark, f"{root}/out", ["key", "week_start"], [])
    run = pipeline.tone_by_week(source).writeStream.outputMode("update").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).foreachBatch(sink).start()
    run.awaitTermination()
    return pipeline.current(spark, f"{root}/out")


def _as_folder(spark: SparkSession, df: DataFrame, root: str) -> str:
    """A file source reads folders; the table is laid into one of the shared folder."""
    df.write.parquet(f"{root}/in")
    return f"{root}/in"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

"""The queries of the training-data operators and, where SQL can state them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import cuts, encode, history, leaks, lines, neardup, subjects, turns
from tessera.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.turns(table(spark, sf_dir, "passages"), table(spark, sf_dir, "participants"), words=False)


def p1_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.turns(table(spark, sf_dir, "passages"), table(spark, sf_dir, "participants"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuts.cut_kinds(table(spark, sf_dir, "passages"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuts.cut_pieces(table(spark, sf_dir, "passages"), table(spark, sf_dir, "documents"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_lines(table(spark, sf_dir, "passages"), table(spark, sf_dir, "documents"))


def p3_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = table(spark, sf_dir, "passages")
    return lines.without_lines(passages, lines.repeated_lines(passages, table(spark, sf_dir, "documents")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.rejected(table(spark, sf_dir, "documents"), least=0.8)
    return found.select(F.least("doc_id", "twin").alias("doc_lo"), F.greatest("doc_id", "twin").alias("doc_hi"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neardup.similar_pairs(table(spark, sf_dir, "passages"), least=0.7, least_words=30)
    return pairs.toDF("passage_lo", "passage_hi")


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_groups(table(spark, sf_dir, "passages"), least=0.7, least_words=30)


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_classes(table(spark, sf_dir, "passages"), least=0.7, least_words=30).select("lo", "hi")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(p8_found(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subjects_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects"))


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.composition(p9_found(spark, sf_dir), table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_SETS = f"""with t as (select id, {_WORDS} w from (select distinct passage_id as id, text from passages where passage_id is not null and text is not null)), s as (select id, unnest(list_distinct([hash(w[i], w[i + 1], w[i + 2]) for i in range(1, len(w) - 1)])) h from t where len(w) >= 30),
 n as (select id, count(*) n from s group by 1), m as (select a.id x, b.id y, count(*) k from s a join s b on a.h = b.h and a.id < b.id group by 1, 2)"""


def oracle_sql() -> dict[str, str]:
    """Oracles of the queries that SQL can state; the others are tested against brute force."""
    return {
        "p3_found": """with l as (select distinct p.passage_id, p.document_id, d.source, unnest(string_split(p.text, chr(10))) line, generate_subscripts(string_split(p.text, chr(10)), 1) line_no from passages p join documents d on d.doc_id = p.document_id),
 n as (select *, regexp_replace(lower(line), '[^\\p{L}]', '', 'g') k from l), t as (select source, count(distinct doc_id) total from documents group by 1),
 f as (select n.source, k from n join t on t.source is not distinct from n.source where k <> '' group by 1, 2 having count(distinct document_id) >= 3 and count(distinct document_id) >= 0.05 * any_value(total))
 select distinct passage_id, line_no::int as line_no from n join f on f.k = n.k and f.source is not distinct from n.source""",
        "p4_found": f"""with recursive t as (select doc_id id, min(ingested_at) came, any_value({_WORDS}) w from documents where doc_id is not null and text is not null group by 1), s as (select id, unnest(list_distinct([hash(w[i], w[i + 1], w[i + 2]) for i in range(1, len(w) - 1)])) h from t),
 n as (select id, count(*) n from s group by 1), o as (select n.id, n, row_number() over (order by came nulls last, n.id) k from n join t using (id)),
 l as (select a.id e, b.id l, a.k ek, b.k lk from (select x.id x, y.id y, count(*) c from s x join s y on x.h = y.h and x.id <> y.id group by 1, 2) m join o a on a.id = m.x join o b on b.id = m.y where a.k < b.k and c >= 0.8 * (a.n + b.n - c)),
 q as (select l, row_number() over (order by lk) i, es from (select l, lk, list(e) es from l group by 1, 2)),
 r(i, outs) as (select 0::bigint, []::bigint[] union all select q.i, case when len([x for x in q.es if not list_contains(r.outs, x)]) > 0 then list_append(r.outs, q.l) else r.outs end from r join q on q.i = r.i + 1),
 f as (select outs from r order by i desc limit 1), v as (select l.l, arg_min(e, ek) twin from l, f where list_contains(outs, l.l) and not list_contains(outs, e) group by 1)
 select least(l, twin) as doc_lo, greatest(l, twin) as doc_hi from v""",
        "p6_found": f"{_SETS} select x as passage_lo, y as passage_hi from m join n a on a.id = x join n b on b.id = y where k >= 0.7 * (a.n + b.n - k)",
        "p6_classes": f"""{_SETS}, c as (select id, any_value(n) n, sum(h::hugeint)::varchar || '/' || any_value(n) || '/' || bit_xor(h)::varchar c from (select s.*, n.n from s join n using (id)) group by 1), r as (select c, min(id) r from c group by 1), e as (select id, r from c join r using (c))
 select distinct least(ex.r, ey.r) as lo, greatest(ex.r, ey.r) as hi from m join n a on a.id = x join n b on b.id = y join e ex on ex.id = x join e ey on ey.id = y where k >= 0.7 * (a.n + b.n - k) and ex.r <> ey.r""",
        "p6_groups": f"""{_SETS}, c as (select id, any_value(n) n, sum(h::hugeint)::varchar || '/' || any_value(n) || '/' || bit_xor(h)::varchar c from (select s.*, n.n from s join n using (id)) group by 1), r as (select c, min(id) r from c group by 1), e as (select id, r from c join r using (c)),
 l as (select distinct least(ex.r, ey.r) a, greatest(ex.r, ey.r) b from m join n p on p.id = x join n q on q.id = y join e ex on ex.id = x join e ey on ey.id = y where k >= 0.7 * (p.n + q.n - k) and ex.r <> ey.r),
 w as (select a x, b y from l union select b, a from l), d as (select x, count(*) n from w group by 1),
 z as (with recursive g(x, y) as (select r, r from r union select g.x, w.y from g join w on w.x = g.y) select x, min(y) root from g group by 1)
 select e.id as passage_id, e.r as class_id, z.root as group_id, coalesce(d.n, 0) as n_links from e join z on z.x = e.r left join d on d.x = e.r""",
        "p8_found": f"""with i as (select item_id, {_WORDS} w from eval_items where text is not null), g as (select distinct item_id, array_to_string(w[k:k + 12], ' ') h from i, lateral (select unnest(range(1, len(w) - 11)) k)),
 d as (select doc_id, {_WORDS} w from documents where text is not null), e as (select distinct doc_id, array_to_string(w[k:k + 12], ' ') h from d, lateral (select unnest(range(1, len(w) - 11)) k))
 select distinct doc_id, item_id from e join g using (h)""",
        "p8_items": f"""with i as (select item_id, {_WORDS} w from eval_items where text is not null), g as (select distinct item_id, array_to_string(w[k:k + 12], ' ') h from i, lateral (select unnest(range(1, len(w) - 11)) k)),
 d as (select doc_id, {_WORDS} w from documents where text is not null), e as (select distinct doc_id, array_to_string(w[k:k + 12], ' ') h from d, lateral (select unnest(range(1, len(w) - 11)) k))
 select item_id, count(distinct doc_id) as n_documents from e join g using (h) group by 1""",
    }

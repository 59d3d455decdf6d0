"""Text expressions, all native: they stay inside code generation and need no Python worker."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a token is, and the words that carry no topic.
TOKEN = r"\d[\d,.]*\d%?|\d%?|[a-z][a-z0-9'\-]*[a-z0-9]|[a-z]"
STOPWORDS = tuple(
    """
    a about above after again against all also am an and any are as at be because been before being below between both but by
    can company could did do does doing down during each few for from further had has have having he her here hers him his how
    i if in into is it it's its itself just me more most my no nor not now of off on once only or other our ours out over own
    quarter same she should so some such than that the their theirs them then there these they this those through to too under
    until up very was we we're were what when where which while who whom why will with would year you your yours
    """.split()
)
#: Similarity thresholds: near duplicate, its prefilter, previously seen; and how many are kept.
NEAR, PREFILTER, SEEN = 0.7, 0.3, 0.2
SEEN_LIMIT, CANDIDATES, QUERY_TERMS = 3, 25, 14


def normalize(c: Column | str) -> Column:
    """Lower case, every run of white space one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def squeeze(c: Column | str) -> Column:
    """Every run of white space one blank, none at the ends; case kept."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column | str) -> Column:
    """Lower-cased numbers and words in text order; null gives null."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def _telling(t: Column) -> Column:
    return ~t.isin(*STOPWORDS) & ((F.length(t) > 2) | t.rlike(r"\d"))


def content_words(c: Column | str) -> Column:
    """Distinct tokens that are no stop words and longer than two letters or with a digit, by first place."""
    return F.array_distinct(F.filter(tokens(c), _telling))


def shingles(c: Column | str, k: int = 3) -> Column:
    """Distinct runs of k tokens, joined by blanks; a shorter text is one run of all its tokens, an empty one has none."""
    t = tokens(c)
    whole = F.when(F.size(t) > 0, F.array(F.array_join(t, " "))).otherwise(F.array().cast("array<string>"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, k), " "))
    return F.when(F.size(t) < k, whole).otherwise(F.array_distinct(runs))


def jaccard(a: Column, b: Column) -> Column:
    """Shared members over all members of two sets; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def query_terms(c: Column | str, most: int = QUERY_TERMS) -> Column:
    """The most distinctive words: the longest first, then those first in the text."""
    words = content_words(c)
    ranked = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("size"), i.alias("at"), w.alias("word"))))
    return F.transform(F.slice(ranked, 1, most), lambda s: s["word"])


def sha256(c: Column | str) -> Column:
    """Hexadecimal SHA-256 of the UTF-8 text."""
    return F.sha2(F.col(c) if isinstance(c, str) else c, 256)


def half(key: Column | str) -> Column:
    """0 or 1, whether the SHA-256 of the key as text is even: a split that is the same everywhere."""
    return F.conv(F.right(F.sha2((F.col(key) if isinstance(key, str) else key).cast("string"), 256), F.lit(1)), 16, 10).cast("int") % 2


def estimated_tokens(c: Column | str) -> Column:
    """A quarter of the characters, rounded up, 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(c) / 4)).cast("long")


def tail(c: Column | str, limit: int) -> Column:
    """The last ``limit`` characters from a word's beginning, after an ellipsis; the whole if it is not longer; null if empty."""
    t = squeeze(c)
    last = F.right(t, F.lit(limit))
    return F.when(F.length(t) == 0, F.lit(None)).when(F.length(t) <= limit, t).otherwise(F.concat(F.lit("… "), F.regexp_replace(last, r"^\S*\s+", "")))


def slug(c: Column | str, limit: int = 60) -> Column:
    """Lower case, every run of other characters than letters a-z and digits a hyphen, none at the ends, at most ``limit`` long."""
    dashed = F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, limit), "-+$", "")


def title_of(meta: Column, text: Column, fallback: Column, limit: int = 200) -> Column:
    """The given title unless blank, else the first non-blank line without leading #, else ``fallback``."""
    line = F.regexp_extract(text, r"(?m)^[#\s]*(\S[^\r\n]*)", 1)
    return F.substring(F.coalesce(F.nullif(F.trim(meta), F.lit("")), F.nullif(F.trim(line), F.lit("")), fallback), 1, limit)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))

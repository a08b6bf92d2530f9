"""Text column functions.  All native Spark expressions: no Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def evaluated_once(c: str | Column) -> Column:
    """``c`` as the output of a one-element ``explode`` (a null value stays a row).

    Use for an expensive column that a later filter tests: Catalyst pushes a filter on a
    plain projection below it by copying the expression (and, through join keys, into
    inferred filters on the other side), so the expression runs once per copy.  A filter
    on generator output stops above the generator, so the expression runs once per row.
    """
    return F.explode(F.array(_col(c)))


def null_safe_concat(a: str | Column, b: str | Column, sep: str = " ") -> Column:
    """``coalesce(a,'') || sep || coalesce(b,'')`` — keeps the separator when a side is null
    (``concat_ws`` would drop it)."""
    return F.concat(F.coalesce(_col(a), F.lit("")), F.lit(sep), F.coalesce(_col(b), F.lit("")))


def normalize_text(c: str | Column) -> Column:
    """lower → URLs to space → non ``[a-z0-9\\s]`` to space → collapse whitespace → trim.

    Computed in one replacement: after the two middle steps every character outside
    ``[a-z0-9]`` has become whitespace and every whitespace run one space, which is the
    same as replacing each maximal ``[^a-z0-9]`` run by one space (one regex match per
    run instead of one per punctuation mark).  Only single spaces remain at the ends, so
    ``trim`` (spaces only) is enough.
    """
    t = F.lower(_col(c))
    t = F.regexp_replace(t, r"http\S+", " ")
    t = F.regexp_replace(t, r"[^a-z0-9]+", " ")
    return F.trim(t)


# Whitespace collapse ``\s+`` → ' ', matching only where a change happens: runs of two or
# more whitespace characters, or a single whitespace character other than a space.
_WS_TO_FIX = r"\s{2,}|[^\S ]"


def strip_ws(c: str | Column) -> Column:
    """Strip leading/trailing whitespace of any ASCII class (Spark's trim removes spaces only)."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def canon_key(c: str | Column) -> Column:
    """Key canonicalisation for map lookups: lower + strip."""
    return strip_ws(F.lower(_col(c)))


def clean_placeholders(c: str | Column) -> Column:
    """Replace the synthetic placeholders, collapse whitespace and strip."""
    t = _col(c)
    for token, repl in C.PLACEHOLDERS:
        t = F.replace(t, F.lit(token), F.lit(repl))
    return strip_ws(F.regexp_replace(t, _WS_TO_FIX, " "))


def word_count(c: str | Column) -> Column:
    """Number of whitespace-separated words of a *normalised* text (single spaces, trimmed).

    Counted arithmetically (spaces + 1) so no array is materialised per row.
    """
    t = _col(c)
    return F.when(t == "", F.lit(0)).otherwise(
        F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1
    )


def complexity(text: str | Column) -> Column:
    n = word_count(text)
    return (
        F.when(n > C.COMPLEXITY_HIGH_WORDS, F.lit("high"))
        .when(n > C.COMPLEXITY_MEDIUM_WORDS, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def contains_any(text: Column, words) -> Column:
    cond = None
    for w in words:
        e = text.contains(w)
        cond = e if cond is None else (cond | e)
    return cond


def keyword_issue(text: str | Column, keyword_map=C.KEYWORD_MAP, default: str = "other") -> Column:
    """First label whose substring list hits the text; ``default`` otherwise."""
    t = _col(text)
    out = None
    for label, words in keyword_map:
        cond = contains_any(t, words)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def keyword_issue_bench(text: str | Column) -> Column:
    """The benchmark's keyword classifier, applied to lower-cased raw text."""
    return keyword_issue(F.lower(_col(text)), C.BENCHMARK_KEYWORD_RULES)


def keyword_urgency(text: str | Column) -> Column:
    t = _col(text)
    return (
        F.when(contains_any(t, C.URGENCY_HIGH_WORDS), F.lit("high"))
        .when(contains_any(t, C.URGENCY_MEDIUM_WORDS), F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def md5_order(seed: int, key: str | Column) -> Column:
    """Deterministic pseudo-random order key: md5 hex of ``'<seed>:<key>'``.

    Hex digits sort the same as the hash value, in Spark and in SQL engines alike.
    """
    return F.md5(F.concat(F.lit(f"{seed}:"), _col(key).cast("string")))

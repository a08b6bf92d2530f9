"""URL filters: a broadcast trie over reversed host labels and path segments.

Longest match decides between allow and block entries. The rule list is an
argument of at most ``MAX_RULES`` entries (checked), so the trie that is shipped to the
executors has a proven bound and does not grow with the pages. A list of any size is a table:
``judge_urls_by_table`` joins it, with the same answers, on the suffixes of hosts and the lengths of paths that it has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import free_names

MAX_RULES = 1_000_000
RESULT = "host string, path string, rule string, verdict string"

#: The rules (verdict, host, path) that op8 applies.
CONTRACT_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

NAMES = ("host", "path", "rule", "verdict")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = str.maketrans(_UPPER, _UPPER.lower())


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty for a null or a url without ``://``."""
    rest = (url or "").partition("://")[2]
    cut = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:cut].partition("/")
    return host.translate(_LOWER), slash + path


def build_trie(rules: Sequence[tuple[str, str, str]]) -> dict:
    """Host node: label → host node, plus ``"/"`` → path node. Path node: segment →
    path node, plus ``"="`` → [(unfinished last segment, rule, verdict)], longest first.

    Labels hold no ``/`` and path keys start with ``/`` (but for ``"="``), so the markers
    cannot clash. Where both lists have one host and path, block holds.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    root: dict = {}
    for verdict, host, path in sorted(rules, key=lambda r: r[0] != "block"):
        node = root
        for label in reversed(host.translate(_LOWER).split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault("/", {})
        *segments, rest = path.split("/")
        for s in segments:
            node = node.setdefault("/" + s, {})
        ends = node.setdefault("=", [])
        if all(e[0] != rest for e in ends):
            ends.append((rest, host + path, verdict))
            ends.sort(key=lambda e: -len(e[0]))
    return root


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the entry with the most host labels, then the longest path."""
    node, paths = trie, []
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        if "/" in node:
            paths.append(node["/"])
    segments = path.split("/")
    for tree in reversed(paths):
        best, at = None, tree
        for s in segments:
            best = next((e for e in at.get("=", ()) if s.startswith(e[0])), best)
            at = at.get("/" + s)
            if at is None:
                break
        if best:
            return best[1], best[2]
    return None


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null where none fits) and verdict.

    A rule (verdict, host, path) fits its host and all subdomains when the url's path
    starts with the rule's path. Null, empty and malformed urls have empty host and path and
    get ``default``. Input columns named like a result column are replaced; repeated
    rows are judged alike; one scan, no shuffle.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf(RESULT)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = shipped.value
        for urls in batches:
            parts = [split_url(u) for u in urls]
            found = [longest_match(trie, *p) or (None, default) for p in parts]
            yield pd.DataFrame([(*p, *f) for p, f in zip(parts, found, strict=True)],
                               columns=["host", "path", "rule", "verdict"], dtype=object)

    keep = [c for c in pages.columns if c not in NAMES]
    found, = free_names([*pages.columns, *NAMES], "judged")
    return (pages.withColumn(found, judged(F.col(url_col)))
            .select(*(F.col(f"`{c}`") for c in keep), *(F.col(f"{found}.{n}").alias(n) for n in NAMES)))


def judge_urls_by_table(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``judge_urls`` for a table of rules (verdict, host, path) of any size; nothing is shipped whole.

    A url goes with the suffixes of its host to the lengths of rule paths that such a host has, and with these
    beginnings of its path to the rules; the rule with the most host labels, then the longest path, comes back. Distinct hosts and paths
    are judged once, so a url that fills a third of the table is one.
    """
    host = F.translate(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), "(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower())
    path = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)
    keep = [c for c in pages.columns if c not in NAMES]
    of_host, of_path = free_names([*keep, *NAMES], "of_host", "of_path")
    parted = pages.select(*(F.col(f"`{c}`") for c in keep), host.alias("host"), path.alias("path"))
    own = rules.select(F.translate("host", _UPPER, _UPPER.lower()).alias("r_host"), F.col("path").alias("r_path"),
                       F.struct((F.col("verdict") != "block").alias("second"), F.concat("host", "path").alias("rule"), "verdict").alias("r"))
    own = own.groupBy("r_host", "r_path").agg(F.min("r").alias("r"))      # where both lists have one host and path, block holds
    sizes = own.groupBy(F.col("r_host").alias("s_host")).agg(F.collect_set(F.length("r_path")).alias("sizes"))      # lengths of paths
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.struct(
        n.alias("n"), F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".").alias("suffix")))
    each = parted.select("host", "path").distinct().select("host", "path", F.inline(suffixes))
    tried = each.join(sizes, F.col("suffix") == F.col("s_host")).select("host", "path", "n", "suffix", F.explode("sizes").alias("size"))
    tried = tried.where(F.col("size") <= F.length("path")).withColumn("start", F.expr("substring(path, 1, size)"))
    hits = tried.join(own, (F.col("suffix") == F.col("r_host")) & (F.col("start") == F.col("r_path")))
    best = hits.groupBy(F.col("host").alias(of_host), F.col("path").alias(of_path)).agg(F.max_by("r", F.struct("n", "size")).alias("r"))
    return (parted.join(best, (F.col("host") == F.col(of_host)) & (F.col("path") == F.col(of_path)), "left")
            .select(*(F.col(f"`{c}`") for c in keep), "host", "path", F.col("r.rule").alias("rule"),
                    F.coalesce("r.verdict", F.lit(default)).alias("verdict")))

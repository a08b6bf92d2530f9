"""Importance resampling against features built as strings."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ticketlens.llm import importance
from ticketlens.llm.queries import QUERIES

LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def features(text, longest=2):
    w = words(text)
    return [" ".join(w[k:k + n]).encode() for n in range(1, longest + 1) for k in range(len(w) - n + 1)]


def brute(docs, target, share=25, least=20, seed=7, buckets=10_000, longest=2):
    """[(id, n_words, n_features, weight, score, rank)]; rows that agree in all but the rank are in any order."""
    of = [[zlib.crc32(f) % buckets for f in features(t, longest)] for _, t in docs]
    s = Counter(b for f in of for b in f)
    t = Counter(zlib.crc32(f) % buckets for x in target for f in features(x, longest))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]
    out = []
    for (i, text), f in zip(docs, of, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((k for k, r in enumerate(out) if r[1] >= least), key=lambda k: (-out[k][4], out[k][0] is None, out[k][0] or 0))
    rank = {k: p + 1 for p, k in enumerate(able[:share * len(able) // 100])}
    return sorted([(*r, rank.get(k)) for k, r in enumerate(out)], key=str)


def found(docs, target, **options):
    rows = importance.resample(docs, target, **options).collect()
    return sorted([(r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in rows], key=str)


def test_awkward_rows_against_brute_force(spark, docs, texts):
    goal = ["river stone market12 letter", None, "", "ABC abc Ünder-grund ß"]
    target = spark.createDataFrame([(x,) for x in goal], "text string")
    assert found(docs, target) == brute(texts, goal)
    assert found(docs, target, share=60, least_words=3, longest=3, buckets=97) == brute(texts, goal, 60, 3, longest=3, buckets=97)


def test_registered_query_against_brute_force(spark):
    from tests.conftest import SF001

    read = lambda name: spark.read.parquet(f"{SF001}/{name}.parquet")
    docs = [tuple(r) for r in read("documents").select("doc_id", "text").collect()]
    want = brute(docs, [r[0] for r in read("benchmark").select("text").collect()])
    rows = QUERIES["op12_importance_resampling"](spark, SF001).collect()
    assert sorted([(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in rows], key=str) == sorted(
        [(i, n, w, s, k) for i, _, n, w, s, k in want], key=str)


def test_repeated_rows_null_ids_and_ties(spark):
    rows = [(5, "one two three " * 8)] * 300 + [(None, "two four " * 12)] * 40 + [(k, "six " * 25) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    target = spark.createDataFrame([("two three",)], "text string")
    got = found(docs, target)
    assert got == brute(rows, ["two three"])
    assert sorted(r[5] for r in got if r[5]) == list(range(1, 25 * 390 // 100 + 1))


def test_empty_tables_clashing_names_and_one_text_in_parts(spark, docs, no_docs):
    target = spark.createDataFrame([], "text string")
    assert found(no_docs, target) == []
    clash = docs.selectExpr("*", "'a' as weight", "'b' as rank", "'c' as score", "'d' as at", "'e' as own_score", "'f' as place")
    out = importance.resample(clash, docs)
    assert {"at", "own_score", "place", "lang", "fp"} <= set(out.columns) and "text" not in out.columns
    assert {(r["at"], r["own_score"], r["place"]) for r in out.collect()} == {("d", "e", "f")}


@pytest.mark.parametrize("most", [1, 7, 64, 1 << 20])
def test_features_do_not_depend_on_the_slices(most):
    texts = ["", "a b c", "  --  ", "Ünder x" * 9, "longword" * 30 + " and more of it", "x", "last one here", ". . a . b"]
    raw = [t.encode() for t in texts]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    for longest in (1, 2, 4):
        got = Counter()
        n_words = Counter()
        for doc, bucket, of in importance.feature_buckets(buf, off, 1009, longest, most):
            got.update(zip(doc.tolist(), bucket.tolist(), strict=True))
            n_words.update(of.tolist())
        assert got == Counter((k, zlib.crc32(f) % 1009) for k, t in enumerate(texts) for f in features(t, longest))
        assert n_words == Counter(k for k, t in enumerate(texts) for _ in words(t))


def test_composed_crcs():
    for a, b in ((b"x", b"y"), (b"", b"abc"), (b"left ", b"r" * 1000), (b"left ", b"r" * 70_001)):
        got = importance.compose(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), importance._moved(len(b))[None], 0)
        assert int(got[0]) == zlib.crc32(a + b)

"""Mixing: targets against repeated resharing, rounding by its invariants and against a plain fold."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ticketlens.llm import mixing
from ticketlens.llm.queries import QUERIES


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    goal, total = dict.fromkeys(names, 0.0), sum(sizes.values())
    open_, left = set(names), float(total)
    while open_ and left > 1e-9:      # deal out, cut what is above, deal that out again
        share = sum(w[s] for s in open_)
        for s in open_:
            goal[s] += left * w[s] / share
        left = sum(max(0.0, goal[s] - most * sizes[s]) for s in open_)
        for s in list(open_):
            if goal[s] >= most * sizes[s]:
                goal[s] = float(most * sizes[s])
                open_.discard(s)
    return goal


def check(rows, found, most=3, exact=None):
    """``found``: (source, id, size, source_size, target, copies)."""
    assert Counter(f[:3] for f in found) == Counter(rows)
    sizes = Counter()
    for s, _, n in rows:
        sizes[s] += n
    goal = brute_targets({s: sizes[s] for s in {r[0] for r in rows}}, most=most)
    taken, largest = Counter(), Counter()
    for s, _, n, source_size, target, copies in found:
        assert source_size == sizes[s] and target == pytest.approx(goal[s], rel=1e-9, abs=1e-9)
        rate = target / source_size if source_size else 0
        assert int(rate + 1e-9) <= copies <= min(most, int(rate - 1e-9) + 1) or copies == round(rate)
        taken[s] += n * copies
        largest[s] = max(largest[s], n)
    for s, t in goal.items():
        assert abs(taken[s] - t) <= largest[s]      # only one unit is rounded by itself


def mixed(spark, rows, parts=3, **options):
    df = spark.createDataFrame(rows, "source string, doc_id long, size long").repartition(parts)
    return sorted([tuple(r) for r in mixing.mix(df, **options).select("source", "doc_id", "size", *mixing.RESULTS).collect()], key=str)


@pytest.mark.parametrize("seed", range(3))
def test_every_source_meets_its_target(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("abcdé") if r.random() < 0.6 else "hot", k, int(r.expovariate(1 / 200)) if k % 9 else 0) for k in range(1500)]
    rows += [(None, 5000 + k, 3) for k in range(4)] + [("zz", 6000, 17), ("nothing", 6001, 0), ("nothing", 6002, 0)]
    found = mixed(spark, rows)
    check(rows, found)
    assert found == mixed(spark, rows, parts=11)      # reruns agree, whatever the partitions


def test_small_sources_stop_at_three_times_their_size(spark):
    rows = [("a", k, 10) for k in range(100)] + [("b", 200 + k, 5) for k in range(4)] + [("c", 300, 8), ("d", 400 + 0, 0)]
    found = mixed(spark, rows)
    check(rows, found)
    assert {f[5] for f in found if f[0] in ("b", "c")} == {3}


def test_chances_are_kept():
    """Over many seeds a document's mean number of copies is what it is due."""
    from ticketlens.session import local_session

    spark = local_session(4)
    rows = [("a", k, 1 + k * k) for k in range(12)] + [("b", 100 + k, 40) for k in range(12)]
    units = spark.createDataFrame(rows, "source string, at long, size long")
    many = units.crossJoin(spark.range(400).withColumnRenamed("id", "world"))      # a world per seed: 24 rows, 400 times, in a test
    many = many.select(F.concat_ws(":", "source", F.col("world").cast("string")).alias("source"), "size",
                       F.xxhash64("world", "at").alias("h"), (F.col("world") * 1000 + F.col("at")).alias("at"), F.lit(0.3).alias("part"))
    won = mixing.rounded(many).withColumn("unit", F.col("at") % 1000).groupBy("unit").agg(F.avg("won").alias("p"), F.count("*").alias("n"))
    for r in won.collect():
        assert r["n"] == 400 and abs(r["p"] - 0.3) < 0.115      # five standard errors


def test_repeated_rows_and_null_ids_share_their_unit(spark):
    rows = [("a", 1, 7)] * 500 + [("a", None, 7)] * 300 + [("b", k, 9) for k in range(90)] + [(None, None, 0)] * 5 + [("c", 3, 11)]
    found = mixed(spark, rows, parts=9)
    check(rows, found)
    again = [f for f in found if f[0] == "a" and f[1] == 1]
    rate = again[0][4] / again[0][3]
    assert abs(sum(f[5] for f in again) - 500 * rate) < 1


def test_empty_clashing_columns_and_null_sizes(spark):
    df = spark.createDataFrame([], "source string, doc_id long, size long")
    assert mixing.mix(df).collect() == []
    clash = spark.createDataFrame([("a", 1, 5, "t", "r", "n", 9), ("b", 2, None, "t", "r", "n", 9)],
                                  "source string, doc_id long, size long, target string, row string, `n` string, copies int")
    out = mixing.mix(clash)
    assert out.columns == ["source", "doc_id", "size", "row", "n", *mixing.RESULTS]
    assert sorted((r["doc_id"], r["size"], r["row"], r["copies"]) for r in out.collect()) == [(1, 5, "r", 1), (2, None, "r", 0)]


def test_word_count(spark, docs, texts):
    more = [(900, "a\x0bb\x0cc\rd\te\nf  g "), (901, "   x "), (902, "word " * 300_000)]
    df = spark.createDataFrame([*texts, *more], "doc_id long, text string")
    got = df.select("doc_id", mixing.word_count("text").alias("n")).collect()
    want = sorted((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in [*texts, *more])
    assert sorted(map(tuple, got)) == want


def test_registered_query(spark):
    from tests.conftest import SF001

    docs = [(r["source"], r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")))
            for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    source = {i: s for s, i, _ in docs}
    rows = QUERIES["op13_pivotal_mixing"](spark, SF001).collect()
    assert rows[0].asDict().keys() == {"doc_id", "size", "source_size", "target", "taken"}
    assert all(r["taken"] % r["size"] == 0 if r["size"] else r["taken"] == 0 for r in rows)
    by = defaultdict(set)
    for r in rows:
        by[source[r["doc_id"]]].add((r["source_size"], r["target"]))
    assert all(len(v) == 1 for v in by.values())
    check([d for d in docs if d[2]], [(source[r["doc_id"]], r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"] // r["size"])
                                      for r in rows if r["size"]])


def test_the_plan_has_no_python(spark):
    df = spark.createDataFrame([("a", k, k) for k in range(200)], "source string, doc_id long, size long")
    plan = mixing.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)

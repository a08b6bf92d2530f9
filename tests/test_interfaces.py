"""Helper names, one ticket without a job, CSV and ids of files, scratch folder, single-pass samples."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from ticketlens import config as C
from ticketlens.functions import lookup as LK
from ticketlens.operators import policy as PO
from ticketlens.operators import routing as RT
from ticketlens.operators import sampling as SM
from ticketlens.plans import triage
from ticketlens.sources import readers as RD

CLASH = ["_b", "_off", "_rank", "_group_n", "_ord", "_rn", "_all", "_c", "_upto", "_cut", "_total", "_key0", "_null0", "_bucket", "_of"]


def test_samples_and_ranks_keep_every_column_of_the_caller(spark):
    df = spark.range(200).select("id", (F.col("id") % 3).cast("string").alias("label"), *(F.lit(f"own{k}").alias(c) for k, c in enumerate(CLASH)))
    own = {c: f"own{k}" for k, c in enumerate(CLASH)}
    for out in (SM.hash_sample(df, 20), SM.per_class_sample(df, "label", 5), SM.stratified_split(df, "label"), SM.kfold_assign(df, "label"),
                SM.positional_split(df), SM.dedup_keep_first(df, "label"), SM.top_n_per_group(df, ["label"], ["id"], 2)):
        assert set(df.columns) <= set(out.columns)
        rows = out.collect()
        assert rows and all(r[c] == v for r in rows for c, v in own.items())
    t = df.withColumn("text", F.lit("a refund")).withColumns({c: F.lit("mine") for c in ("_h", "_found_h", "_grams", "_bits")})
    out = LK.rule_match_table(t, "text", LK.rule_registry(spark)).collect()
    assert all(r["_h"] == r["_bits"] == "mine" and r["rule_issue_type"] == "billing" for r in out)


def test_rows_beyond_the_cut_are_filtered_before_any_exchange(spark):
    df = spark.range(40_000).select("id", (F.col("id") % 3).cast("string").alias("label"))
    df.write.mode("overwrite").parquet(path := f"/tmp/ticketlens-cut-{os.getpid()}")
    df = spark.read.parquet(path)
    for out, most in ((SM.hash_sample(df, 50), 50 + 10), (SM.per_class_sample(df, "label", 20), 60 + 30)):
        n = out.count()
        assert n in (50, 60)
        plan = out._jdf.queryExecution().optimizedPlan()
        # below the window (which needs the exchange) stands the filter on the cut
        text = plan.toString()
        assert text.index("Window [row_number()") < text.index("Generate explode(array(") < text.rindex("Relation")
        near = [ln for ln in text.splitlines() if "Filter" in ln and "scalar-subquery" not in ln and "_cut" in ln]
        assert near
        rows = out.select("id")
        assert rows.count() <= most


def test_splits_move_only_the_rows_of_the_cut_bucket(spark):
    from collections import Counter

    df = spark.range(60_000).select("id", F.when(F.col("id") % 5 > 0, (F.col("id") % 3).cast("string")).alias("label"), F.lit("wide text").alias("text"))
    df.write.mode("overwrite").parquet(path := f"/tmp/ticketlens-split-{os.getpid()}")
    df = spark.read.parquet(path)
    n = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    for out, want in ((SM.stratified_split(df, "label"), {k: -(-v // 5) for k, v in n.items()}), (SM.positional_split(df), None)):
        rows = out.collect()
        assert len(rows) == 60_000
        if want:
            assert Counter(r["label"] for r in rows if r["split"] == "test") == want
        else:
            assert sum(r["split"] == "train" for r in rows) == 48_000
        far, near = out._jdf.queryExecution().optimizedPlan().toString().split("Window [row_number()")
        assert "Union" in far and far.index("Project") < far.index("Generate explode(array(")      # the far branch: no window above its scan


def test_class_samples_of_null_and_many_classes(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 4 > 0, (F.col("id") % 50).cast("string")).alias("label"))
    got = {r["label"]: r["count"] for r in SM.per_class_sample(df, "label", 7).groupBy("label").count().collect()}
    want = {r["label"]: min(7, r["count"]) for r in df.groupBy("label").count().collect()}
    assert got == want


@pytest.mark.parametrize("call_model", [True, False])
def test_one_ticket_equals_the_batch_and_runs_no_job(spark, call_model):
    cases = [("please refund me", "other", 0.1, "high", None), ("odd", "technical", 0.93, "critical", None), ("odd", "ads", 0.7, "", None),
             ("odd", "ads", 0.3, "low", '{"issue_type": "login", "urgency": "high", "more": 1}'), ("odd", "ads", 0.3, "", "no json"),
             ("odd", "ads", 0.3, "", None), ("odd", "ads", float("nan"), "", None), ("it's 100% \"odd\" \\ {x}", "nowhere", 0.99, "", None)]
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    for text, label, prob, urgency, reply in cases:
        row = spark.createDataFrame([(0, text, label, prob, urgency)], "id long, text string, label string, prob double, urgency string")
        replies = spark.createDataFrame([(0, reply)], "id long, reply string") if call_model else None
        want = RT.route(row, replies=replies, with_metadata=True).first()
        group = f"one-{call_model}-{cases.index((text, label, prob, urgency, reply))}"
        context.setJobGroup(group, "a single ticket")
        got = RT.route_one(spark, text, label, prob, urgency, reply, call_model=call_model)
        assert list(tracker.getJobIdsForGroup(group)) == []
        context.setJobGroup("other", "")
        assert (got["route"], got["stage"]) == (want["route"], want["stage"])
        assert got["confidence"] == want["confidence"] or prob != prob
        assert got["metadata"] == dict(want["metadata"] or {})


def test_nan_scores_are_in_no_band_of_the_sweep(spark):
    df = spark.createDataFrame([(float("nan"),), (0.2,), (0.7,), (0.9,), (None,)], "prob double")
    for r in PO.threshold_sweep(df).collect():
        auto = [p for p in (0.2, 0.7, 0.9) if p >= r["threshold_high"]]
        assert r["auto_routed_rate"] == len(auto) / 5
        assert r["avg_confidence_auto"] == pytest.approx(sum(auto) / len(auto) if auto else 0.0)


def test_quoted_line_breaks_by_default(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,text\n1,"line one\nline two"\n2,"a ""quoted"" word"\n')
    for df in (RD.read_csv(spark, str(tmp_path)), RD.first_table(RD.read_folder(spark, str(tmp_path))),
               RD.read_required(spark, str(tmp_path)), RD.read_labeled_eval(spark, str(tmp_path))):
        assert sorted((r["id"], r["text"]) for r in df.collect()) == [("1", "line one\nline two"), ("2", 'a "quoted" word')]
    assert RD.read_csv(spark, str(tmp_path), multi_line=False).count() == 3      # the faster way is asked for


def test_ids_of_files_do_not_depend_on_how_they_are_split(spark, tmp_path):
    for name, n in (("b", 4000), ("a", 700)):
        (tmp_path / f"{name}.csv").write_text("text,inbound\n" + "".join(f"{name} row {k} {'x' * 40},True\n" for k in range(n)))
    seen = []
    for size, multi in (("128m", True), ("20k", False), ("7k", False)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = triage.with_id(RD.read_csv(spark, str(tmp_path), multi_line=multi), 1)
            seen.append({r["text"]: r["id"] for r in df.collect()})
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] == seen[2] and len(set(seen[0].values())) == 4700
    assert all(i % 2 for i in seen[0].values()) and seen[0]["a row 3 " + "x" * 40] == 7
    assert max(i for t, i in seen[0].items() if t[0] == "a") < min(i for t, i in seen[0].items() if t[0] == "b")


def test_weight_flags_reach_the_sweep():
    a = triage.arguments(["--social", "s", "--tickets", "t", "--out", "o", "--weight-auto", "2", "--weight-human", "0.5", "--weight-llm", "3"])
    assert (a.weight_auto, a.weight_human, a.weight_llm) == (2.0, 0.5, 3.0)
    b = triage.arguments(["--social", "s", "--tickets", "t", "--out", "o"])
    w = C.SweepWeights()
    assert (b.weight_auto, b.weight_human, b.weight_llm) == (w.auto_weight, w.human_penalty, w.llm_penalty)


def test_queries_need_no_spark_defaults(tmp_path):
    """With an empty Spark conf folder nothing names spark.checkpoint.dir: a local session gets a folder of its own."""
    code = ("import __spark_entry__ as E\nfrom ticketlens.session import local_session, named_folder, CHECKPOINT_CONF\n"
            "s = local_session(2, 2)\nassert not s.conf.get(CHECKPOINT_CONF, None), s.conf.get(CHECKPOINT_CONF, None)\n"
            "n = E.queries()['rule_match_table'](s, '/root/testdata/sf0.001').count()\n"
            "q = E.queries().get('op13_pivotal_mixing')\n"
            "assert q is None or q(s, '/root/testdata/sf0.001').count() > 0\nassert n > 0 and named_folder(s)\nprint('fine')\n")
    env = dict(os.environ, SPARK_CONF_DIR=str(tmp_path), PYTHONPATH=os.getcwd())
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
                          capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]


def test_rule_tables_of_any_size_against_brute_force(spark):
    """No rule, a few, and very many, patterns of 0 to 40 characters; whatever the size, only texts with a passing gram are shuffled."""
    import random

    r = random.Random(4)
    texts = ["", None, "é日本", "😀😀x"] + ["".join(r.choices("abcdé 日😀", k=r.randrange(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(k % 90, t) for k, t in enumerate(texts * 2)], "id long, text string").repartition(5)
    schema = "ord int, pattern string, queue string, issue_type string"
    few = [(k, "".join(r.choices("abcdé 日😀", k=r.randrange(1, 6))), f"q{k}", f"i{k}") for k in range(40)]
    many = few + [(1000 + k, f"never {k:06d} there", "q", "i") for k in range(100_000)]
    for rules in ([], few, [*few, (7, "", "all", "all")], [(5, "bc", "q5", "i5"), (5, "bc", "q4", "i4")], many):
        best = {p: min(x for x in rules if x[1] == p) for p in {x[1] for x in rules if len(rules) < 1000 or x[0] < 1000}}
        out = LK.rule_match_table(df, "text", spark.createDataFrame(rules, schema))
        got = {(x["text"], x["rule_queue"], x["rule_issue_type"]) for x in out.collect()}
        want = set()
        for t in set(texts):
            hit = min((b[0], b[2], b[3]) for p, b in best.items() if p in t) if t is not None and any(p in t for p in best) else (0, None, None)
            want.add((t, *hit[1:]))
        assert got == want and out.count() == len(texts) * 2
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter (size(") < plan.index("Generate explode(array(filter(")      # grams are tested before anything is shuffled


def test_numbered_patterns_do_not_all_come_back_for_a_text(spark):
    """Thousands of numbered patterns share their short grams; an indexed gram belongs to few of them."""
    rules = spark.range(20_000).select(F.col("id").cast("int").alias("ord"), F.concat(F.lit("ref "), F.col("id")).alias("pattern"),
                                       F.lit("q").alias("queue"), F.col("id").cast("string").alias("issue_type"))
    assert LK._rule_index(spark, rules).groupBy("gram").count().agg(F.max("count")).first()[0] <= 20
    rows = spark.createDataFrame([(1, "about ref 12345 please"), (2, "ref 19"), (3, "ref"), (4, "xref 7"), (5, None)], "id long, text string")
    got = {r["id"]: r["rule_issue_type"] for r in LK.rule_match_table(rows, "text", rules).collect()}
    assert got == {1: "1", 2: "1", 3: None, 4: "7", 5: None}

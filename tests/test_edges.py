"""Edges that the registered queries do not reach on the driver tables."""

import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ticketlens import config as C
from ticketlens.operators import evalset as ES
from ticketlens.operators import evaluation as EV
from ticketlens.operators import ml as ML
from ticketlens.operators import reports as RP
from ticketlens.operators import routing as RT
from ticketlens.operators import sampling as SM
from ticketlens.plans import triage
from ticketlens.session import shared_path


def test_split_keeps_null_labels_and_trains_on_a_rare_class(spark):
    rows = [(k, "a") for k in range(10)] + [(20, "rare"), (30, None), (31, None), (None, "a")]
    df = spark.createDataFrame(rows, "id long, label string")
    got = SM.stratified_split(df, "label").collect()
    assert len(got) == len(rows)
    assert {(r["label"], r["split"]) for r in got if r["label"] == "rare"} == {("rare", "train")}
    assert sorted(r["split"] for r in got if r["label"] is None) == ["test", "train"]
    folds = SM.kfold_assign(df, "label").collect()
    assert len(folds) == len(rows) and all(0 <= r["fold"] < 5 for r in folds)


def test_samples_are_exact_whatever_the_cap(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("x")).alias("label"))
    order = [r["id"] for r in SM.with_order_key(df, "id", 42).orderBy(SM.ORDER_COL, "id").collect()]
    for n in (0, 1, 25, 299, 300, 1000):
        assert [r["id"] for r in SM.hash_sample(df, n).collect()] == order[:n]
    per = {r["label"]: r["count"] for r in SM.per_class_sample(df, "label", 40).groupBy("label").count().collect()}
    assert per == {None: 40, "x": 40}


def test_grids_with_null_labels(spark):
    pred = spark.createDataFrame([("m", "a", None), ("m", None, "a"), ("m", "a", "a")], "model string, y string, p string")
    got = {(r["actual_label"], r["predicted_label"]): r["count"] for r in EV.confusion_long(pred).collect()}
    assert got == {("a", None): 1, (None, "a"): 1, ("a", "a"): 1, (None, None): 0}
    ev = spark.createDataFrame([("s", None), ("t", "a"), (None, "a")], "eval_label_source string, issue_type string")
    assert sum(r["count"] for r in ES.eval_summary(ev).collect()) == 3


def test_report_numbers_have_no_separators(spark):
    df = spark.createDataFrame([(12.345, 1234.5)], "rate double, value double")
    assert tuple(RP.format_report(df, ["rate"], ["value"]).first()) == ("1234.5%", "1234.5000")


def test_nan_goes_to_a_human_and_repeated_replies_route_once(spark):
    scored = spark.createDataFrame([(1, "odd", "other", float("nan"), ""), (2, "odd", "other", 0.2, ""), (3, "odd", "other", 0.7, "")],
                                   "id long, text string, label string, prob double, urgency string")
    replies = spark.createDataFrame([(2, None), (2, '{"issue_type": "ads"}'), (2, '{"issue_type": "ads"}')], "id long, reply string")
    enrichment = spark.createDataFrame([(3, "s", None), (3, "s", None)], "id long, summary string, resolution string")
    got = RT.route(scored, replies=replies, enrichment=enrichment).collect()
    assert sorted((r["id"], r["stage"]) for r in got) == [(1, C.STAGE_HUMAN), (2, C.STAGE_LLM), (3, C.STAGE_HUMAN)]


def test_classifier_reads_another_text_column_and_keeps_all_columns(spark):
    rows = [(k, ("refund my invoice please" if k % 2 else "screen crashes at start") + f" {k}", "billing" if k % 2 else "technical", "own", k)
            for k in range(40)]
    df = spark.createDataFrame(rows, "id long, body string, y string, text string, _tfidf_note long")
    train = df.select("id", F.col("body").alias("text"), "y")
    clf = ML.fit_classifier(train, "y", calibrate=False, max_iter=30)
    out = clf.transform(df, text_col="body")
    assert out.columns[:5] == df.columns
    got = out.collect()
    assert all(r["text"] == "own" and r["_tfidf_note"] == r["id"] and r["prediction"] == r["y"] for r in got)


def test_vocabulary_without_a_bound_keeps_every_term(spark):
    df = spark.createDataFrame([(k, f"aa{k} bb{k} common") for k in range(50)], "id long, text string")
    rows = ML.tfidf_rows(df, ML.fit_tfidf(df, ML.TfidfSpec(ngram_max=1, vocab_size=None)))
    assert rows.select("term").distinct().count() == 101


def test_a_vocabulary_without_a_bound_stays_a_table(spark, monkeypatch):
    """Rare and frequent terms, rows that share an id, and a row without a term; no vocabulary comes to the driver."""
    texts = ["aa bb bb", "aa cc cc cc", "aa", "", "aa bb bb", "dd aa"]
    df = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "id long, text string")
    monkeypatch.setattr(ML, "FREQUENT_TERMS", 2)
    monkeypatch.setattr(ML, "_count_model", lambda *a: pytest.fail("a vocabulary at the driver"))
    for spec in (ML.TfidfSpec(ngram_max=1, vocab_size=None), ML.BASELINE_SPEC):
        model = ML.fit_tfidf(df, spec)
        assert [r["term"] for r in model.frequent.collect()] == ["aa"]
        seen = Counter(t for x in texts for t in set(x.split()))
        want = []
        for k, x in enumerate(texts):
            w = {t: (1 + math.log(n) if spec.sublinear else n) * (math.log(7 / (seen[t] + 1)) + 1) for t, n in Counter(x.split()).items()
                 if seen[t] >= spec.min_df}
            want += [(k // 2, t, v / math.sqrt(sum(y * y for y in w.values()))) for t, v in w.items()]
        got = sorted(tuple(r) for r in ML.tfidf_rows(df, model).collect())
        assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in sorted(want)])


def test_triage_job_from_folders(spark, tmp_path):
    social, tickets = tmp_path / "social", tmp_path / "tickets"
    social.mkdir(), tickets.mkdir()
    words = ["refund for my order", "cannot sign in", "app crash on start", "where is the invoice", "campaign ads stopped", "asap help"]
    (social / "messages.csv").write_text("text,inbound\n" + "".join(f"{words[k % 6]} number {k},{'True' if k % 4 else 'False'}\n" for k in range(80)))
    (tickets / "t.csv").write_text("Ticket Subject,Ticket Description,Ticket Type,Ticket Priority\n" + "".join(
        f"s{k},{words[k % 6]} case {k},{'Billing inquiry' if k % 2 else 'Technical issue'},High\n" for k in range(80)))
    out = shared_path(spark, "test_triage_folders")
    a = triage.arguments(["--social", str(social), "--tickets", str(tickets), "--out", out, "--no-cv", "--max-iter", "10", "--folds", "2",
                          "--targets", "issue_type", "--high", "0.6", "--low", "0.3", "--client", "tests.test_edges:echo_client",
                          "--enrich", "--fit-rows", "100"])
    res = triage.run(spark, a)
    assert res["routed"].count() == res["labeled"].count() > 0
    report = {(r["section"], r["metric"]) for r in spark.read.parquet(f"{out}/training_report").collect()}
    assert ("issue_type", "held_out_accuracy") in report and any(s == "label_composition" for s, _ in report)


def echo_client():
    return lambda prompt: json.dumps({"issue_type": "ads", "urgency": "low", "suggested_path": "x", "should_escalate": False, "reason": "y"})

"""What a fit reads: rows derived once, terms counted in batches, terms stored before several passes, folds that share memory."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from ticketlens.operators import ml as ML
from ticketlens.operators import sampling as SM
from ticketlens.plans import jobs as JB
from ticketlens.plans import queries as Q
from ticketlens.sources import fixtures as FX


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def rows(spark):
    words = {"billing": "refund invoice charge", "login": "password login locked", "technical": "crash error bug"}
    out = [(k, f"{words[y].split()[k % 3]} please {words[y].split()[(k // 3) % 3]} ticket{k % 7}", y)
           for k, y in ((k, sorted(words)[k % 3]) for k in range(90))]
    return spark.createDataFrame(out, "id long, text string, issue_type string")


def test_labelled_rows_of_a_fit_are_derived_once(spark):
    for df in (Q._train_test(spark, SF001), Q._weak_rows(spark, SF001)):
        assert "regexp_replace" not in plan(df) and "Window [row_number() windowspecdefinition(description" not in plan(df)
    lab = FX.labeled(spark, SF001).select("id", "text", "issue_type")
    key = ["id", "text", "issue_type", "split"]
    want = SM.stratified_split(lab, "issue_type", "id", Q.C.SEED).select(key).collect()
    assert sorted(Q._train_test(spark, SF001).select(key).collect()) == sorted(want)


def test_term_totals_count_batches(spark):
    local = [(["b", "a", "b"], True), ([], True), (None, True), (["b"], None), (["a", "c", "c", "c"], False)]
    df = spark.createDataFrame(local, "ts array<string>, p boolean")
    totals = ML.term_totals(df, "ts", {"odd.name": F.col("p")})
    assert "Generate" not in plan(totals) and "MapInArrow" in plan(totals)      # no row per occurrence
    tf, n, ptf, pn = Counter(), Counter(), Counter(), Counter()
    for ts, p in local:
        tf.update(ts or [])
        n.update(set(ts or []))
        if p:
            ptf.update(ts or [])
            pn.update(set(ts or []))
    got = {r["term"]: (r["tf"], r["df"], r["tf_odd.name"], r["df_odd.name"]) for r in totals.collect()}
    assert got == {t: (tf[t], n[t], ptf[t], pn[t]) for t in tf}
    only = spark.createDataFrame([("b",), ("z",)], "term string")
    assert [(r["term"], r["tf"], r["df"]) for r in ML.term_totals(df, "ts", None, only).collect()] == [("b", 3, 2)]


def test_improved_and_bounded_vocabularies_count_stored_terms(spark, rows, monkeypatch):
    seen = []
    whole = ML.vocabulary_totals
    monkeypatch.setattr(ML, "vocabulary_totals", lambda terms, *a: (seen.append(plan(terms)), whole(terms, *a))[1])
    clf = ML.fit_improved(rows, "issue_type", max_iter=20)
    ML.fit_tfidf(rows, ML.TfidfSpec())
    assert len(seen) == 3 and all("Generate" not in p and "UDF" not in p and "parquet" in p for p in seen)
    out = clf.transform(rows).select("issue_type", "prediction").collect()
    assert sum(r[0] == r[1] for r in out) >= 0.9 * len(out)


def test_the_benchmark_split_reads_stored_rows(spark, monkeypatch):
    seen = []
    whole = SM.stratified_split
    monkeypatch.setattr(SM, "stratified_split", lambda df, *a, **k: (seen.append(plan(df)), whole(df, *a, **k))[1])
    monkeypatch.setattr(ML, "fit_baseline", lambda *a, **k: (_ for _ in ()).throw(StopIteration))
    with pytest.raises(StopIteration):
        JB.run_benchmark(spark, FX.tickets_raw(spark, SF001))
    assert seen and "regexp_replace" not in seen[0]


def test_folds_that_fill_the_cores_follow_one_another(spark, rows, monkeypatch):
    asked = []
    whole = ML._parallel
    monkeypatch.setattr(ML, "_parallel", lambda fn, items, parallelism: (asked.append(parallelism), whole(fn, items, parallelism))[1])
    ML.cv_accuracy(rows, "issue_type", max_iter=5, folds=2).collect()
    small = asked[0]
    asked.clear()
    monkeypatch.setattr(ML, "ROWS_PER_FIT_TASK", 10)
    ML.cv_accuracy(rows, "issue_type", max_iter=5, folds=2).collect()
    ML.fit_classifier(rows, "issue_type", max_iter=5, folds=2)
    assert small > 1 and asked[:2] == [1, 1]


def test_folds_move_texts_not_terms(spark, rows, monkeypatch):
    seen = []
    whole = SM.kfold_assign
    monkeypatch.setattr(SM, "kfold_assign", lambda df, *a, **k: (seen.append(df.columns), whole(df, *a, **k))[1])
    ML.cv_accuracy(rows, "issue_type", max_iter=5, folds=2).collect()
    assert seen == [["id", "issue_type", "text"]]

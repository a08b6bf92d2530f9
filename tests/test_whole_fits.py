"""Models fitted on every row, in tasks or in passes over the rows, and rules found by what surrounds a gram."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from ticketlens.functions import lookup as LK
from ticketlens.operators import ml as ML
from ticketlens.operators import regression as LR
from ticketlens.operators import sampling as SM

WORDS = {"billing": "refund invoice charge card", "login": "password login locked reset", "technical": "crash error bug screen"}


@pytest.fixture(scope="module")
def rows(spark):
    out = []
    for k in range(240):
        y = sorted(WORDS)[(k if k % 5 else k // 5) % 3]
        w = WORDS[sorted(WORDS)[k % 3]].split()
        out.append((k, f"{w[k % 4]} {w[(k // 3) % 4]} please ticket{k % 50}", y))
    return spark.createDataFrame(out, "id long, text string, y string")


def test_every_labelled_row_is_split_and_fitted(spark, rows, monkeypatch):
    drawn = []
    whole = SM.hash_sample
    monkeypatch.setattr(SM, "hash_sample", lambda df, n, *a: (drawn.append(n), whole(df, n, *a))[1])
    got = ML.train_text_models(rows, ["y"], with_cv=False, calibrate=False, max_iter=5)["y"].report
    assert not drawn      # no row is left out, however many there are
    n = {r["y"]: r["n"] for r in SM.stratified_split(rows, "y").where("split = 'test'").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r["label"]: r["support"] for r in got.where("label NOT LIKE '% avg'").collect()} == n
    few = ML.train_text_models(rows, ["y"], with_cv=False, calibrate=False, max_iter=5, max_rows=60)["y"].report
    assert drawn == [60] and few.where("label NOT LIKE '% avg'").agg(F.sum("support")).first()[0] < sum(n.values())


@pytest.mark.parametrize("alone", [LR.ALONE, 0])
def test_a_fit_finds_the_optimum_in_fewer_steps(spark, rows, monkeypatch, alone):
    """Spark's own fit, run to its end, and ours agree; both ways of passing over the rows do."""
    monkeypatch.setattr(LR, "ALONE", alone)
    monkeypatch.setattr(LR, "ENTRIES_PER_TASK", 300)
    monkeypatch.setattr(LR, "PART", 64)
    clf = ML.fit_classifier(rows.repartition(3), "y", calibrate=False, max_iter=60)
    data = clf.indexer.transform(ML.drop_internal(clf.features.transform(rows)))
    data = ML.balanced_weights(data, "y", clf.labels).cache()
    theirs = LogisticRegression(featuresCol="features", labelCol="_y", weightCol="_w", maxIter=1000, regParam=1.0 / data.count(), tol=1e-12,
                                standardization=False, family="multinomial").fit(data)

    def loss(m):
        p = m.setProbabilityCol("_prob").setRawPredictionCol("_raw").setPredictionCol("_pred").transform(data)
        own = p.select("_w", F.log(F.get(ML.vector_to_array("_prob"), F.col("_y").cast("int"))).alias("l")).agg(F.sum(-F.col("_w") * F.col("l"))).first()[0]
        return own / data.count() + (m.coefficientMatrix.toArray() ** 2).sum() / 2 / data.count()

    assert loss(clf.lr_models[0]) <= loss(theirs) * (1 + 1e-3)
    assert np.abs(clf.lr_models[0].coefficientMatrix.toArray() - theirs.coefficientMatrix.toArray()).max() < 0.2


def test_folds_are_fitted_in_the_same_passes(spark, rows, monkeypatch):
    monkeypatch.setattr(LR, "ALONE", 0)
    asked = []
    whole = LR._pass
    monkeypatch.setattr(LR, "_pass", lambda blocks, points, *a: (asked.append(len(points)), whole(blocks, points, *a))[1])
    clf = ML.fit_classifier(rows, "y", folds=3, max_iter=3)
    assert asked[0] == 3 and len(asked) < 12      # of three fits of three steps each
    assert all(sum(r["probabilities"]) == pytest.approx(1) for r in clf.transform(rows).collect())


def test_one_label_is_certain(spark, rows):
    clf = ML.fit_classifier(rows.withColumn("y", F.lit("only")), "y", calibrate=False, max_iter=3)
    assert {(r["prediction"], r["confidence"]) for r in clf.transform(rows).collect()} == {("only", 1.0)}


@pytest.mark.parametrize(("longest", "n"), [(3, 40), (12, 200), (70, 100)])
def test_rules_are_found_by_what_surrounds_a_gram(spark, longest, n):
    r = random.Random(longest)
    texts = [(i, "".join(r.choice("ab\U0001F600é \n") for _ in range(r.randrange(90)))) for i in range(150)] + [(900, None), (901, ""), (0, "ab")]
    rules = []
    for o in range(n):
        t = r.choice(texts)[1] or "x"
        at = r.randrange(max(1, len(t)))
        rules.append((o // 2, t[at:at + r.randrange(1, longest)] or "q", f"q{o}", "i"))
    out = LK.rule_match_table(spark.createDataFrame(texts, "id long, text string"), "text",
                              spark.createDataFrame(rules, "ord int, pattern string, queue string, issue_type string"))
    want = sorted((i, str(t), str(min(((o, q) for o, p, q, _ in rules if t is not None and p in t), default=(0, None))[1])) for i, t in texts)
    assert sorted((x["id"], str(x["text"]), str(x["rule_queue"])) for x in out.collect()) == want
    assert "substring(text" in out._jdf.queryExecution().optimizedPlan().toString()      # no whole text is shuffled with a gram

"""Shared tokens, fold totals by subtraction, calibration summary and what a fitted model must meet."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlens.operators import ml as ML
from ticketlens.operators import sampling as SM
from ticketlens.plans import checks as CK

WORDS = {"billing": "refund invoice charge card", "login": "password login locked reset", "technical": "crash error bug screen"}


@pytest.fixture(scope="module")
def rows(spark):
    out = []
    for k in range(180):
        y = sorted(WORDS)[k % 3]
        w = WORDS[y].split()
        out.append((k, f"{w[k % 4]} {w[(k // 3) % 4]} please ticket{k % 11} and", y, "high" if k % 4 else "low"))
    return spark.createDataFrame(out, "id long, text string, y string, u string")


def test_totals_and_fold_totals(spark, rows):
    spec = ML.TfidfSpec()
    terms = SM.kfold_assign(ML.tokenised(rows, spec), "y").cache()
    totals = ML.term_totals(terms, "_tf_terms", {str(f): F.col("fold") == f for f in range(5)})
    local = [(r["fold"], r["_tf_terms"]) for r in terms.collect()]
    for f in range(5):
        tf, df = Counter(), Counter()
        for fold, ts in local:
            if fold != f:
                tf.update(ts)
                df.update(set(ts))
        got = {r["term"]: (r["tf"], r["df"]) for r in ML.without_part(totals, str(f)).where("tf > 0").collect()}
        assert got == {t: (tf[t], df[t]) for t in tf}


def test_fold_weights_equal_a_refit(spark, rows):
    """Vocabulary and idf of a fold by subtraction are those of a fit on the fold's training rows."""
    spec = ML.TfidfSpec(min_df=2.0, sublinear=True)
    folds = SM.kfold_assign(rows, "y").cache()
    terms = ML.tokenised(folds, spec)
    totals = ML.term_totals(terms, "_tf_terms", {str(f): F.col("fold") == f for f in range(5)})
    for f in (0, 3):
        own = folds.where(F.col("fold") != f)
        a, b = ML.weighting(ML.without_part(totals, str(f)), own.count(), spec), ML.fit_tfidf(own, spec)
        cv, product = a.stages[0], a.stages[-2]
        other_cv, other_product = b.stages[-4], b.stages[-2]
        assert cv.vocabulary == other_cv.vocabulary
        assert np.allclose(product.getScalingVec().toArray(), other_product.getScalingVec().toArray())


@pytest.mark.parametrize("tracked", [40, 400, 100_000])
def test_a_vocabulary_by_sketch_is_the_counted_one(spark, monkeypatch, tracked):
    """With few counters the error bound does not separate and all terms are counted; with more the candidates suffice."""
    r = np.random.default_rng(2)
    rows = [(k, " ".join(f"w{x}" for x in r.zipf(1.3, 60) if x < 5000)) for k in range(400)]
    terms = ML.tokenised(spark.createDataFrame(rows, "id long, text string").repartition(6), spec := ML.TfidfSpec(ngram_max=1, vocab_size=3, min_df=2.0)).cache()
    parts = {"a": F.col("id") % 3 == 0, "b": F.col("id") < 200}
    full = ML._kept(ML.term_totals(terms, "_tf_terms", parts))
    monkeypatch.setattr(ML, "SKETCH_FROM", 100)
    monkeypatch.setattr(ML, "SKETCHED_TERMS", tracked)
    counted = []
    whole = ML.term_totals
    monkeypatch.setattr(ML, "term_totals", lambda *a: (counted.append(len(a)), whole(*a))[1])
    totals = ML.vocabulary_totals(terms, "_tf_terms", spec, parts)
    assert counted == ([4, 3] if tracked == 40 else [4])      # 4: candidates only
    for view in (lambda t: t, lambda t: ML.of_part(t, "a"), lambda t: ML.without_part(t, "b")):
        a, b = ML.weighting(view(totals), 400, spec), ML.weighting(view(full), 400, spec)
        assert a.stages[0].vocabulary == b.stages[0].vocabulary
        assert np.array_equal(a.stages[1].getScalingVec().toArray(), b.stages[1].getScalingVec().toArray())
    if tracked == 400:
        assert totals.count() < full.count()


def test_texts_are_tokenised_once_for_all_targets(spark, rows, monkeypatch):
    calls = []
    once = ML.tokenised
    monkeypatch.setattr(ML, "tokenised", lambda *a, **k: (calls.append(1), once(*a, **k))[1])
    got = ML.train_text_models(rows, ["y", "u"], max_iter=30, folds=3, calibrate=False)
    assert len(calls) == 1 and set(got) == {"y", "u"}
    assert got["y"].accuracy > 0.9 and got["y"].cv.first()["cv_mean"] > 0.9
    one = ML.train_text_model(rows, "y", max_iter=30, folds=3, calibrate=False)
    assert one.accuracy == pytest.approx(got["y"].accuracy, abs=0.05)      # sums of doubles come in any order
    assert one.cv.first()["cv_mean"] == pytest.approx(got["y"].cv.first()["cv_mean"], abs=0.05)
    assert got["u"].model.transform(rows).columns == [*rows.columns, "prediction", "confidence", "probabilities"]


def test_terms_are_those_of_the_ml_stages_without_a_python_or_scala_function(spark):
    from pyspark.ml.feature import NGram, RegexTokenizer

    texts = ["", "a", "ab", "Ab cd", "x ab, cd-ef  gh", "é ab caf\u00e9s \u0130stanbul \u212aelvin", "a_b __ 12 ab\tcd\nef", "中文 ab 中cd"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for n in (1, 2, 3):
        got = ML.tokenised(df, ML.TfidfSpec(ngram_max=n))
        assert "UDF" not in got._jdf.queryExecution().optimizedPlan().toString()
        want, grams = RegexTokenizer(inputCol="text", outputCol="k1", pattern=ML.TOKEN_PATTERN, gaps=False).transform(df), ["k1"]
        for k in range(2, n + 1):
            want = NGram(n=k, inputCol="k1", outputCol=f"k{k}").transform(want)
            grams.append(f"k{k}")
        want = {r["id"]: r["terms"] for r in want.select("id", F.concat(*grams).alias("terms")).collect()}
        assert {r["id"]: r["_tf_terms"] for r in got.collect()} == want


def test_two_models_of_the_same_terms_make_them_once(spark, rows):
    from ticketlens.plans import jobs as JB

    got = ML.train_text_models(rows, ["y", "u"], with_cv=False, max_iter=20, folds=2)
    scored = JB.score(rows, got["y"].model, got["u"].model)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2      # the words and the runs of two, for both models
    a, b = ({r["id"]: r for r in got[t].model.transform(rows).collect()} for t in ("y", "u"))
    for r in scored.collect():
        assert (r["label"], r["urgency"]) == (a[r["id"]]["prediction"], b[r["id"]]["prediction"])
        assert r["prob"] == pytest.approx(a[r["id"]]["confidence"], abs=1e-12)


def test_null_labels_are_a_clear_error(spark, rows):
    df = rows.withColumn("y", F.when(F.col("id") % 9 == 0, F.lit(None)).otherwise(F.col("y")))
    with pytest.raises(ValueError, match="null labels"):
        ML.fit_classifier(df, "y", calibrate=False, max_iter=5)
    with pytest.raises(ValueError, match="null labels"):
        ML.balanced_weights(df, "y", ["billing", "login", "technical"])


def pav(points):
    """Exact isotonic fit of (score, hit) rows: {score: value}."""
    blocks = []
    for s in sorted({p[0] for p in points}):
        own = [h for x, h in points if x == s]
        blocks.append([sum(own), len(own), [s]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            h, n, ss = blocks.pop()
            blocks[-1] = [blocks[-1][0] + h, blocks[-1][1] + n, blocks[-1][2] + ss]
    return {s: h / n for h, n, ss in blocks for s in ss}


def test_calibration_of_the_summary_stays_within_its_stated_error(spark):
    r = np.random.default_rng(4)
    score = r.normal(0, 2, 3000)
    hit = (r.random(3000) < 1 / (1 + np.exp(-score * 0.7))).astype(float)
    df = spark.createDataFrame([(float(s), float(h)) for s, h in zip(score, hit, strict=True)], "score double, hit double").repartition(7)
    exact = pav(list(zip(score.tolist(), hit.tolist(), strict=True)))
    for cells in (16, 256):
        points = ML.calibration_points(df, [], cells=cells).collect()
        assert len(points) <= cells and sum(p["n"] for p in points) == 3000
        fit = pav_points(sorted((p["cell"], p["hits"], p["n"]) for p in points))
        assert all(a <= b + 1e-12 for a, b in zip(fit.values(), list(fit.values())[1:], strict=False))
        cell = np.minimum(np.floor(cells / (1 + np.exp(-score))), cells - 1)
        order = np.argsort(score)
        mine = np.cumsum([fit[int(c)] for c in cell[order]])
        true = np.cumsum([exact[float(s)] for s in score[order]])
        edges = np.r_[np.flatnonzero(np.diff(cell[order]) > 0), len(order) - 1]
        assert np.abs(mine[edges] - true[edges]).max() <= max(p["n"] for p in points) + 1e-6
        model = ML.isotonic_fit(ML.calibration_points(df, [], cells=cells))
        assert np.all(np.diff(model.predictions.toArray()) >= -1e-12)


def pav_points(points):
    blocks = []
    for c, h, n in points:
        blocks.append([h, n, [c]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            h, n, cs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + h, blocks[-1][1] + n, blocks[-1][2] + cs]
    return {c: h / n for h, n, cs in blocks for c in cs}


def test_a_broken_model_does_not_pass_the_optimality_check(spark, rows):
    from pyspark.ml.linalg import DenseMatrix

    terms = ML._kept(ML.tokenised(rows.select("id", "y", "text"), ML.TfidfSpec()).drop("text"))
    weights = ML.weighting(ML.term_totals(terms, "_tf_terms"), terms.count())
    clf = ML.fit_classifier(rows, "y", calibrate=False, max_iter=300)
    data = ML.drop_internal(weights.transform(terms))
    model = clf.lr_models[0]
    coef, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    good = CK.optimality(data, "y", clf.labels, coef, bias)
    assert all(r["residual"] < 1e-2 for r in good.collect())
    for broken in (coef * 0, coef * 1.3, coef[::-1]):
        assert any(r["residual"] > 5e-2 for r in CK.optimality(data, "y", clf.labels, broken, bias).collect())
    assert isinstance(model.coefficientMatrix, DenseMatrix) or math.isfinite(coef.sum())

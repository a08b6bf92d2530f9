"""Text models: features, calibrated probabilities, persistence (small iteration budgets)."""

import pytest
from pyspark.sql import functions as F

from ticketlens.operators import ml as ML
from ticketlens.sources import sinks as SK

TEXTS = [("refund my charge", "billing"), ("invoice is wrong", "billing"), ("charged twice refund", "billing"),
         ("cannot login password", "login"), ("password reset fails", "login"), ("login locked out", "login"),
         ("app crash error", "technical"), ("bug error on page", "technical"), ("crash when saving", "technical")] * 4


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(TEXTS)], "id long, text string, y string")


def _char_wb_brute(t):
    out = []
    for w in (t or "").lower().split():
        p = f" {w} "
        for n in range(3, min(5, len(p)) + 1):
            out.extend(p[o:o + n] for o in range(len(p) - n + 1))
    return out


def test_char_wb_native_equals_brute_force(spark):
    df = spark.createDataFrame([(1, "Hi there  wonderful world"), (2, "a"), (3, "")], "id long, t string")
    a = {r["id"]: r["g"] for r in df.select("id", ML.char_wb_ngrams(F.col("t")).alias("g")).collect()}
    assert a == {1: _char_wb_brute("Hi there  wonderful world"), 2: _char_wb_brute("a"), 3: _char_wb_brute("")}
    assert a[2] == [" a "] and " hi" in a[1] and "hi t" not in a[1]


def test_native_char_ngrams_feed_the_python_tf_stage(spark):
    """Native n-grams → counts → Python sublinear tf in one plan (the generator barrier lets
    Spark extract the Python stage)."""
    from pyspark.ml.feature import CountVectorizer

    df = spark.createDataFrame([(1, "login fails again"), (2, "login works"), (3, "")], "id long, text string")
    terms = ML.CharWbTerms(inputCol="text", outputCol="_terms").transform(df)
    cv = CountVectorizer(inputCol="_terms", outputCol="_cnt").fit(terms)
    out = ML.SublinearTF(inputCol="_cnt", outputCol="_tf").transform(cv.transform(terms)).collect()
    assert sorted(r["id"] for r in out) == [1, 2, 3]
    assert all(v >= 1.0 for r in out for v in r["_tf"].values)


def test_sublinear_tf(spark):
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(Vectors.sparse(4, [0, 2], [1.0, 3.0]),)], ["v"])
    v = df.select(ML.sublinear_tf("v").alias("w")).first()["w"]
    assert v[0] == pytest.approx(1.0) and v[2] == pytest.approx(2.0986122886681098) and v[1] == 0.0


def test_calibrated_probabilities(spark, data):
    clf = ML.fit_classifier(data, "y", max_iter=30, calibrate=True, folds=3)
    out = clf.transform(data).collect()
    for r in out:
        assert sum(r["probabilities"]) == pytest.approx(1.0)
        assert 0.0 <= r["confidence"] <= 1.0
    acc = sum(r["prediction"] == r["y"] for r in out) / len(out)
    assert acc > 0.8


def test_uncalibrated_and_save_load(spark, data, tmp_path):
    clf = ML.fit_classifier(data, "y", max_iter=30, calibrate=False)
    SK.save_classifier(clf, str(tmp_path / "m"))
    back = SK.load_classifier(spark, str(tmp_path / "m"))
    a = [r["prediction"] for r in clf.transform(data).orderBy("id").collect()]
    b = [r["prediction"] for r in back.transform(data).orderBy("id").collect()]
    assert a == b


def test_label_index(spark, data):
    out = {r["y"]: r["label_index"] for r in ML.label_index(data, "y").collect()}
    assert out == {"billing": 0, "login": 1, "technical": 2}

"""Evaluation against a brute-force Python implementation on hand-made predictions."""

from collections import Counter

import pytest

from ticketlens.operators import evaluation as EV

PRED = [("m", "billing", "billing"), ("m", "billing", "ads"), ("m", "ads", "ads"), ("m", "login", "billing"),
        ("m", "login", "zzz"), ("k", "billing", "billing"), ("k", "ads", "other")]


def _df(spark, rows=PRED):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, model string, y string, p string")


def brute(rows, model):
    ys = [y for m, y, _ in rows if m == model]
    ps = [p for m, _, p in rows if m == model]
    labels = sorted(set(ys) | set(ps))
    out = {}
    for lab in labels:
        tp = sum(1 for y, p in zip(ys, ps) if y == lab and p == lab)
        pr = sum(1 for p in ps if p == lab)
        su = sum(1 for y in ys if y == lab)
        prec = tp / pr if pr else 0.0
        rec = tp / su if su else 0.0
        f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
        out[lab] = (prec, rec, f1, float(su))
    return out, ys, ps


def test_per_class_matches_brute_force(spark):
    got = {(r["model"], r["label"]): (r["precision"], r["recall"], r["f1_score"], r["support"])
           for r in EV.per_class(_df(spark)).collect()}
    for model in ("m", "k"):
        exp, ys, _ = brute(PRED, model)
        for lab, vals in exp.items():
            assert got[(model, lab)] == pytest.approx(vals)
        macro = [sum(v[i] for v in exp.values()) / len(exp) for i in range(3)]
        assert got[(model, "macro avg")][:3] == pytest.approx(macro)
        n = len(ys)
        weighted = [sum(v[i] * v[3] for v in exp.values()) / n for i in range(3)]
        assert got[(model, "weighted avg")][:3] == pytest.approx(weighted)


def test_summary_and_lift(spark):
    s = {r["model"]: r for r in EV.f1_summary(_df(spark)).collect()}
    exp, ys, ps = brute(PRED, "m")
    assert s["m"]["accuracy"] == pytest.approx(sum(y == p for y, p in zip(ys, ps)) / len(ys))
    assert s["m"]["macro_f1"] == pytest.approx(sum(v[2] for v in exp.values()) / len(exp))
    lift = EV.lift(EV.f1_summary(_df(spark)), "m", "k").first()
    assert lift["ml_accuracy_lift"] == pytest.approx(s["m"]["accuracy"] - s["k"]["accuracy"])


def test_confusion_zero_filled_grid(spark):
    cm = EV.confusion_long(_df(spark)).filter("model = 'm'").collect()
    labels = {"billing", "ads", "login", "zzz"}
    assert len(cm) == len(labels) ** 2
    got = Counter({(r["actual_label"], r["predicted_label"]): r["count"] for r in cm})
    assert got[("login", "zzz")] == 1 and got[("zzz", "zzz")] == 0


def test_confusion_restricted_drops_outside_predictions(spark):
    cm = EV.confusion_restricted(_df(spark)).filter("model = 'm'").collect()
    assert {r["true"] for r in cm} == {"billing", "ads", "login"}
    assert sum(r["count"] for r in cm) == 4        # the "zzz" prediction is dropped


def test_per_class_restricted(spark):
    pc = EV.per_class_restricted(_df(spark)).filter("model = 'm'").collect()
    assert {r["label"] for r in pc} == {"billing", "ads", "login"}


def test_confusion_wide(spark):
    w = EV.confusion_wide(EV.confusion_long(_df(spark)), ["billing", "ads", "login", "other", "zzz"])
    row = w.filter("model = 'm' AND actual_label = 'login'").first()
    assert (row["billing"], row["zzz"], row["other"]) == (1, 1, 0)

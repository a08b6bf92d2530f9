"""Routing KPIs, queue shares, threshold sweep and the recommendation."""

import pytest

from ticketlens import config as C
from ticketlens.operators import kpis as KP
from ticketlens.operators import policy as PO

ROUTED = "route string, stage string, confidence double"


def test_kpis_rates(spark):
    df = spark.createDataFrame([("billing_queue", "rule_based", 0.99), ("technical_support_queue", "ml_high_confidence", 0.9),
                                ("human_triage_queue", "human_fallback", 0.6)], ROUTED)
    k = KP.routing_kpis(df).first()
    assert k["tickets"] == 3.0
    assert k["human_triage_rate"] == pytest.approx(1 / 3) and k["escalation_rate"] == k["human_triage_rate"]
    assert k["rule_based_rate"] == pytest.approx(1 / 3) and k["ml_high_confidence_rate"] == pytest.approx(1 / 3)
    assert k["cost_per_ticket_usd_estimated"] == pytest.approx(C.INFRA_COST_PER_TICKET_USD)


def test_llm_invocation_rate(spark):
    df = spark.createDataFrame([("ads_ops_queue", "llm_reasoning", 0.4), ("human_triage_queue", "human_fallback", 0.6)], ROUTED)
    k = KP.routing_kpis(df).first()
    assert k["llm_invocation_rate"] == 0.5
    assert k["cost_per_ticket_usd_estimated"] == pytest.approx(0.0001 + 0.5 * 0.00016)


def test_empty_kpis(spark):
    k = KP.routing_kpis(spark.createDataFrame([], ROUTED)).first()
    assert k["tickets"] == 0.0 and k["human_triage_rate"] is None and k["cost_per_ticket_usd_estimated"] is None


def test_queue_share_key(spark):
    df = spark.createDataFrame([("billing_queue", "rule_based", 0.99)], ROUTED)
    q = KP.queue_share(df).first()
    assert (q["metric"], q["share"]) == ("queue_pct_billing_queue", 1.0)
    wide = KP.queue_share_wide(df).first().asDict()
    assert wide == {"queue_pct_billing_queue": 1.0}


def _scores(spark, probs):
    return spark.createDataFrame([(float(p),) for p in probs], "prob double")


def test_sweep_shape(spark):
    probs = [0.3 + 0.02 * i for i in range(30)]
    sw = PO.threshold_sweep(_scores(spark, probs))
    assert sw.count() == 10 and tuple(sw.columns) == PO.SWEEP_COLUMNS


def test_sweep_weights_and_one_recommendation(spark):
    w = C.SweepWeights(auto_weight=2.0, human_penalty=0.1, llm_penalty=0.2)
    sw = PO.threshold_sweep(_scores(spark, [0.3, 0.6, 0.9]), weights=w).collect()
    assert {(r["weight_auto"], r["weight_human_penalty"], r["weight_llm_penalty"]) for r in sw} == {(2.0, 0.1, 0.2)}
    assert sum(r["is_recommended_threshold"] for r in sw) == 1


def test_sweep_score_identity_and_bands(spark):
    probs = [0.33, 0.5, 0.55, 0.6, 0.86, 0.99]
    for r in PO.threshold_sweep(_scores(spark, probs)).collect():
        assert r["threshold_recommendation_score"] == pytest.approx(
            r["score_automation_gain"] - r["score_human_penalty"] - r["score_llm_penalty"], abs=1e-9)
        hi, lo = r["threshold_high"], r["threshold_low"]
        assert r["auto_routed_rate_estimated"] == pytest.approx(sum(p >= hi for p in probs) / 6)
        assert r["llm_fallback_rate_estimated"] == pytest.approx(sum(p < lo for p in probs) / 6)   # exclusive here
        assert r["human_fallback_rate_estimated"] == pytest.approx(sum(lo <= p < hi for p in probs) / 6)


def test_sweep_ties_go_to_lowest_threshold(spark):
    sw = PO.threshold_sweep(_scores(spark, [0.99, 0.98])).collect()   # every threshold: all auto
    best = [r["threshold_high"] for r in sw if r["is_recommended_threshold"]]
    assert best == [0.5]


def test_sweep_empty(spark):
    sw = PO.threshold_sweep(_scores(spark, []))
    assert sw.count() == 0 and tuple(sw.columns) == PO.SWEEP_COLUMNS


def test_avg_confidence_auto_zero_when_none(spark):
    sw = PO.threshold_sweep(_scores(spark, [0.1, 0.2])).collect()
    assert all(r["avg_confidence_auto"] == 0.0 for r in sw)


def test_recommendation_record(spark):
    sw = PO.threshold_sweep(_scores(spark, [0.3, 0.6, 0.9, 0.95]))
    rec = PO.recommend(sw, C.RoutingThresholds()).collect()
    assert len(rec) == 1 and tuple(rec[0].asDict()) == PO.RECOMMENDATION_COLUMNS
    assert rec[0]["thresholds_match_recommendation"] == (
        rec[0]["recommended_threshold_high"] == 0.85 and rec[0]["recommended_threshold_low"] == 0.55)

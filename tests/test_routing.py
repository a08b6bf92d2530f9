"""Cascade: rule → ML → model reply → human; failure path; thresholds; enrichment."""

import pytest

from ticketlens import config as C
from ticketlens.operators import routing as RT

SCORED = "id long, text string, label string, prob double, urgency string"


def route1(spark, text, label, prob, urgency="", reply=None, thresholds=C.RoutingThresholds(), replies=True,
           enrichment=None):
    s = spark.createDataFrame([(1, text, label, float(prob), urgency)], SCORED)
    r = spark.createDataFrame([(1, reply)], "id long, reply string") if replies else None
    e = spark.createDataFrame([(1,) + enrichment], "id long, summary string, resolution string") \
        if enrichment else None
    return RT.route(s, thresholds, replies=r, enrichment=e).first()


@pytest.mark.parametrize("text", ["please refund me", "account locked again", "app crash on start"])
def test_rule_stage(spark, text):
    r = route1(spark, text, "other", 0.1)
    assert r["stage"] == "rule_based" and r["confidence"] == 0.99


def test_high_confidence(spark):
    r = route1(spark, "the screen flickers", "technical", 0.92)
    assert (r["stage"], r["route"], r["llm_issue_type"]) == ("ml_high_confidence", "technical_support_queue", "")


def test_middle_band_is_human(spark):
    r = route1(spark, "something odd", "other", 0.70)
    assert (r["stage"], r["route"], r["llm_issue_type"]) == ("human_fallback", "human_triage_queue", "other")


def test_priority_suffix_on_ml(spark):
    r = route1(spark, "the screen flickers", "technical", 0.92, "critical")
    assert r["route"] == "technical_support_queue_priority"


def test_llm_band_uses_reply(spark):
    r = route1(spark, "something odd", "other", 0.40, "", '{"issue_type": "ads", "urgency": "high"}')
    assert (r["stage"], r["route"], r["llm_issue_type"], r["llm_urgency"]) == \
        ("llm_reasoning", "ads_ops_queue_priority", "ads", "high")


def test_llm_failure_goes_to_human(spark):
    r = route1(spark, "something odd", "other", 0.40, "low", "not json at all")
    assert (r["stage"], r["route"], r["llm_issue_type"], r["reason"]) == \
        ("human_fallback", "human_triage_queue", "", "")
    r = route1(spark, "something odd", "other", 0.40, "low", None)
    assert r["stage"] == "human_fallback"


def test_no_client_means_failure_path(spark):
    r = route1(spark, "something odd", "other", 0.40, replies=False)
    assert (r["stage"], r["route"]) == ("human_fallback", "human_triage_queue")


@pytest.mark.parametrize("reply,issue,urg,stage", [
    ("{}", "other", "medium", "llm_reasoning"),                       # valid empty object
    ('```json\n{"issue_type": "login"}\n```', "login", "medium", "llm_reasoning"),   # fenced
    ('{"issue_type": "billing", "urgency": "low"} trailing words', "billing", "low", "llm_reasoning"),
    ('text {"a": {"b": 1}} more', "", "medium", "human_fallback"),   # nested object in text: non-greedy span breaks
    ('{"issue_type": "billing"', "", "medium", "human_fallback"),     # truncated
    ("[1, 2]", "", "medium", "human_fallback"),                       # not an object
])
def test_reply_parsing_cases(spark, reply, issue, urg, stage):
    r = route1(spark, "something odd", "other", 0.40, "medium", reply)
    assert (r["stage"], r["llm_issue_type"], r["llm_urgency"]) == (stage, issue, urg)


def test_llm_urgency_suffix_from_reply(spark):
    r = route1(spark, "x", "other", 0.3, "critical", '{"issue_type": "billing", "urgency": "low"}')
    assert r["route"] == "billing_queue"      # the reply's urgency replaces the model's


def test_custom_thresholds(spark):
    default = route1(spark, "something odd", "technical", 0.60)
    custom = route1(spark, "something odd", "technical", 0.60,
                    thresholds=C.RoutingThresholds(high_confidence=0.55, low_confidence=0.30))
    assert default["stage"] == "human_fallback" and custom["stage"] == "ml_high_confidence"


def test_band_edges(spark):
    # prob exactly at high → ML; exactly at low → model band (inclusive)
    assert route1(spark, "x", "technical", 0.85)["stage"] == "ml_high_confidence"
    assert route1(spark, "x", "technical", 0.55, reply='{"issue_type": "ads"}')["stage"] == "llm_reasoning"


def test_low_above_high_high_wins(spark):
    th = C.RoutingThresholds(high_confidence=0.5, low_confidence=0.7)
    assert route1(spark, "x", "technical", 0.6, thresholds=th)["stage"] == "ml_high_confidence"


def test_enrichment_fields(spark):
    r = route1(spark, "something odd", "other", 0.70, enrichment=(
        "Short summary", '{"suggested_path": "refund_flow", "should_escalate": false, "reason": "policy"}'))
    assert (r["suggested_path"], r["should_escalate"], r["reason"], r["llm_summary"]) == \
        ("refund_flow", "False", "policy", "Short summary")


def test_enrichment_failure_sentinel(spark):
    r = route1(spark, "something odd", "other", 0.70, enrichment=("", "oops"))
    assert (r["suggested_path"], r["should_escalate"]) == ("human_review", "True")


def test_no_enrichment_for_high_confidence(spark):
    r = route1(spark, "something odd", "other", 0.95, enrichment=("s", '{"suggested_path": "p"}'))
    assert (r["stage"], r["suggested_path"], r["llm_summary"]) == ("ml_high_confidence", "", "")


def test_llm_issue_type_by_stage(spark):
    rows = [(1, "please refund", "ads", 0.1, ""), (2, "x", "ads", 0.9, ""),
            (3, "x", "ads", 0.4, ""), (4, "x", "ads", 0.7, ""), (5, "x", "ads", 0.3, "")]
    s = spark.createDataFrame(rows, SCORED)
    rep = spark.createDataFrame([(3, '{"issue_type": "login"}'), (5, "broken")], "id long, reply string")
    got = {r["id"]: r["llm_issue_type"] for r in RT.route(s, replies=rep).collect()}
    assert got == {1: "billing", 2: "", 3: "login", 4: "ads", 5: ""}


def test_single_ticket_metadata(spark):
    m = RT.route_one(spark, "please refund", "other", 0.2)["metadata"]
    assert m == {"issue_type": "billing", "urgency": "", "rule": "pattern_match"}
    d = RT.route_one(spark, "x", "other", 0.3, reply=None)
    assert d["metadata"]["reason"] == "llm_unavailable" and d["stage"] == "human_fallback"
    d = RT.route_one(spark, "x", "other", 0.3, reply='{"issue_type": "ads", "urgency": "high"}')
    assert d["metadata"] == {"issue_type": "ads", "urgency": "high"}


def test_staged_table_routes_like_scored_and_prunes_partitions(spark):
    import tempfile

    from ticketlens.operators import routing as RT
    from ticketlens.sources import fixtures as FX
    from ticketlens.sources import sinks as SK
    from tests.conftest import SF001

    scored = FX.scored(spark, SF001)
    replies, enrichment = FX.llm_replies(spark, SF001), FX.llm_enrichment(spark, SF001)
    path = tempfile.mkdtemp(prefix="ticketlens-staged-") + "/scored"
    staged = SK.materialize(spark, RT.stage_table(scored), path, [RT.BAND_COL])

    want = RT.route(scored, replies=replies, enrichment=enrichment)
    got = RT.route(staged, replies=replies, enrichment=enrichment, staged=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    for band_fn in (RT.low_band, RT.middle_band):
        a = band_fn(staged, staged=True)
        assert sorted(r["id"] for r in a.collect()) == sorted(r["id"] for r in band_fn(scored).collect())
        p = a._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(routing_band" in p


def test_rules_lower_a_text_once(spark):
    df = spark.createDataFrame([(1, "ACCOUNT LOCKED", 0.7), (2, None, 0.7)], "id long, text string, prob double")
    out = RT.assign_stage(df)
    assert out.columns == ["id", "text", "prob", "_rule", "_stage"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert [r["_rule"] is None for r in out.orderBy("id").collect()] == [False, True]

"""Model-call transport: injected client, failures as data, one pass for enrichment."""

from tests.stub_client import StubClient
from ticketlens.operators import model_calls as MC
from ticketlens.operators import routing as RT
from ticketlens.session import shared_path

REPLIES = ('{"issue_type": "ads", "urgency": "high"}',)


def factory():
    return StubClient(REPLIES, fail_marker="BROKEN")


def test_call_model_failures_are_rows(spark):
    df = spark.createDataFrame([(1, "fine"), (2, "BROKEN ticket")], "id long, text string")
    out = {r["id"]: (r["reply"], r["error"]) for r in MC.call_model(df, MC.classify_prompt("text"), factory).collect()}
    assert out[1] == (REPLIES[0], None)
    assert out[2][0] is None and "unavailable" in out[2][1]


def test_low_band_only_and_routing(spark):
    scored = spark.createDataFrame([(1, "refund now", "other", 0.2, ""), (2, "odd", "other", 0.3, ""),
                                    (3, "odd", "other", 0.95, ""), (4, "BROKEN", "other", 0.3, "")],
                                   "id long, text string, label string, prob double, urgency string")
    band = RT.low_band(scored)
    assert sorted(r["id"] for r in band.collect()) == [2, 4]
    replies = MC.persist_replies(spark, MC.classify_replies(band, factory), "test_classify")
    assert replies.inputFiles()[0].startswith("file:" + shared_path(spark, "model_replies")) or replies.count() == 2
    got = {r["id"]: r["stage"] for r in RT.route(scored, replies=replies).collect()}
    assert got == {1: "rule_based", 2: "llm_reasoning", 3: "ml_high_confidence", 4: "human_fallback"}


def test_enrichment_one_pass(spark):
    mid = spark.createDataFrame([(7, "odd")], "id long, text string")
    e = MC.enrichment_replies(mid, factory)
    assert e.columns == ["id", "summary", "resolution", "resolution_error"]
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Join" not in plan


def test_each_call_run_uses_its_own_client(spark):
    """Many factories in one session: every run is answered by its own client."""
    df = spark.createDataFrame([(k, "odd") for k in range(4)], "id long, text string")
    for n in range(25):
        rows = MC.call_model(df, MC.classify_prompt("text"), lambda n=n: (lambda prompt: f"answer {n}")).collect()
        assert {r["reply"] for r in rows} == {f"answer {n}"}


def test_error_text_is_kept_whole_and_becomes_the_reason(spark):
    long = "service down " * 300

    def failing():
        def call(prompt):
            raise RuntimeError(long)
        return call

    mid = spark.createDataFrame([(7, "odd", "other", 0.7, "")], "id long, text string, label string, prob double, urgency string")
    e = MC.enrichment_replies(mid, failing)
    assert e.first()["resolution_error"] == long
    routed = RT.route(mid, enrichment=e).first()
    assert routed["reason"] == long and routed["should_escalate"] == "True"

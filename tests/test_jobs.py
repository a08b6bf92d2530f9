"""End-to-end jobs on the smallest driver tables (small iteration budgets)."""

from tests.stub_client import StubClient
from ticketlens.plans import jobs as JB
from ticketlens.session import shared_path
from ticketlens.sources import fixtures as FX
from tests.conftest import SF001


def _factory():
    return StubClient(FX.REPLIES + ('{"suggested_path": "p", "should_escalate": true, "reason": "r"}',))


def test_triage_job(spark):
    out = shared_path(spark, "test_triage")
    cfg = JB.TriageConfig(enrich_human=True, label_targets=("issue_type", "urgency"), with_cv=False,
                          max_iter=15, folds=2)
    res = JB.run_triage(spark, FX.social_raw(spark, SF001), FX.tickets_raw(spark, SF001), out,
                        client_factory=_factory, cfg=cfg, ticket_aliases=JB.UN.FIXTURE_TICKET_COLUMNS["aliases"])
    n_labeled = res["labeled"].count()
    assert res["routed"].count() == n_labeled
    k = res["routing_metrics"].first()
    assert k["tickets"] == float(n_labeled)
    assert res["threshold_sweep"].count() == 10
    assert res["policy_recommendation"].count() == 1
    assert spark.read.parquet(f"{out}/eval_comparison").count() == 0     # no eval set: empty, typed
    stages = {r["stage"] for r in spark.read.parquet(f"{out}/routed").select("stage").distinct().collect()}
    assert stages <= {"rule_based", "ml_high_confidence", "llm_reasoning", "human_fallback"}


def test_eval_set_job(spark):
    lab = FX.labeled(spark, SF001)
    from ticketlens.operators import evalset as ES

    res = JB.build_eval_set(spark, ES.base_from_labeled(lab).drop("eval_label_source"), FX.tickets_raw(spark, SF001),
                            shared_path(spark, "test_evalset"))
    summ = res["eval_summary"].collect()
    assert sum(r["count"] for r in summ) == res["eval_set"].count()


def test_local_run_and_benchmark_observation(spark):
    from pyspark.sql import Observation

    from ticketlens.operators import evalset as ES

    lab = FX.labeled(spark, SF001)
    es = ES.merge_eval_set(ES.base_from_labeled(lab), ES.candidate_rows(FX.tickets_raw(spark, SF001)))
    cfg = JB.TriageConfig(label_targets=("issue_type", "urgency"), with_cv=False, max_iter=10, folds=2)
    res = JB.run_local(spark, es, shared_path(spark, "test_local"), cfg)
    assert res["routed"].count() == es.count()
    assert res["threshold_sweep"].count() == 10
    obs = (Observation("before"), Observation("after"))
    n = JB.benchmark_rows(FX.tickets_raw(spark, SF001), observation=obs).count()
    assert JB.dedup_dropped(obs) >= 0 and n > 0

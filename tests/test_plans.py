"""Plan properties that matter at scale, checked on the physical plans."""

from ticketlens.plans import queries as Q
from tests.conftest import SF001


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_uses_partial_window_group_limit(spark):
    p = plan(Q.q_unify(spark, SF001))
    assert p.count("WindowGroupLimit") >= 2          # partial (before the shuffle) + final


def test_routing_has_no_python(spark):
    p = plan(Q.q_route_with_replies(spark, SF001))
    assert "Python" not in p and "ArrowEval" not in p


def test_sweep_single_scan_no_cartesian(spark):
    p = plan(Q.q_threshold_sweep(spark, SF001))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_scan_prunes_columns(spark):
    p = Q.q_keyword_issue(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,text:string>" in p or "role" not in p.split("ReadSchema")[1][:80]


def test_every_query_has_named_columns(spark):
    import oracles

    sql = oracles.oracle_sql()
    rows_only = {"tfidf_lr_score", "calibrated_score", "cv_accuracy", "benchmark_summary"}
    for name in Q.QUERIES:
        assert name in sql or name in rows_only, name


def _filters(df):
    """Condition text of every Filter in the optimised logical plan."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return [ln for ln in lines if ln.lstrip(" :+-").startswith("Filter")]


def test_candidate_text_is_not_copied_into_pushed_filters(spark):
    from ticketlens.operators import evalset as ES
    from ticketlens.sources import fixtures as FX

    fs = _filters(ES.candidate_rows(FX.tickets_raw(spark, SF001)))
    assert any("length(text#" in f for f in fs)                 # tests the computed column
    assert not any("length(regexp_replace" in f for f in fs)    # no copy of the text expression


def test_rule_chain_is_not_copied_into_band_filters(spark):
    from ticketlens.operators import routing as RT
    from ticketlens.sources import fixtures as FX

    for band in (RT.low_band, RT.middle_band):
        fs = _filters(band(FX.scored(spark, SF001)))
        assert fs and not any("Contains" in f or "contains(" in f for f in fs)


def test_rule_registry_ships_hashes_not_texts_to_the_gram_join(spark):
    p = plan(Q.q_rule_match_table(spark, SF001))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p and "Python" not in p


def test_per_class_sample_has_no_exchange_on_the_label_alone(spark):
    import re

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(Q.q_per_class_sample(spark, SF001))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = re.findall(r"hashpartitioning\(([^)]*(?:\([^)]*\)[^)]*)*), \d+\)", p)
    assert keys and not [k for k in keys if "_b" not in k and "issue_type" in k and "_c" in k]

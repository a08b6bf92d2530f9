"""DuckDB oracle SQL for the registered queries.

Each statement starts with the fixture ``WITH`` prefix (the same views the Spark
side builds) and restates the operator's semantics in plain SQL.  Doubles are
rounded to 6 digits, as on the Spark side.
"""

from __future__ import annotations

from ticketlens import config as C
from ticketlens.sources import fixtures as FX
from ticketlens.sources.fixtures import (
    sql_complexity, sql_contains_any, sql_keyword_issue, sql_keyword_urgency, sql_map, sql_normalize,
    sql_pick, sql_queue, sql_rule, sql_str, sql_strip, sql_suffix, sql_word_count,
)

from ticketlens.operators import kpis as KP  # noqa: E402
from ticketlens.operators import model_calls as MC  # noqa: E402
from ticketlens.operators.routing import UNPARSEABLE_REASON  # noqa: E402
from ticketlens.plans import queries as QU  # noqa: E402

W = FX.fixture_ctes()
MD5_ORDER = f"md5('{C.SEED}:' || CAST(id AS VARCHAR))"


def _clean(x: str) -> str:
    t = x
    for token, repl in C.PLACEHOLDERS:
        t = f"replace({t}, {sql_str(token)}, {sql_str(repl)})"
    return sql_strip(f"regexp_replace({t}, '\\s+', ' ', 'g')")


def _social_norm() -> str:
    return f"social_norm AS (SELECT id, {sql_normalize('text')} AS text FROM social_raw)"


def _routed(with_replies: bool, with_enrichment: bool = False, replies: str = "llm_replies") -> str:
    """CTEs ``staged`` and ``routed`` over ``scored`` (default thresholds 0.85 / 0.55)."""
    hi, lo = C.RoutingThresholds().high_confidence, C.RoutingThresholds().low_confidence
    parse = ""
    if with_replies:
        parse = """,
parsed0 AS (
  SELECT s.*, r.reply,
         CASE WHEN json_valid(r.reply) THEN r.reply
              ELSE regexp_extract(r.reply, '(?s)\\{.*?\\}', 0) END AS j0
  FROM staged s LEFT JOIN """ + replies + """ r ON s.id = r.id AND s.st = 'band'
),
parsed AS (
  SELECT *, (j0 IS NOT NULL AND json_valid(j0) AND json_type(TRY_CAST(j0 AS JSON)) = 'OBJECT') AS ok FROM parsed0
),
fields AS (
  SELECT *, CASE WHEN ok THEN coalesce(json_extract_string(TRY_CAST(j0 AS JSON), '$.issue_type'), 'other') END AS li,
            CASE WHEN ok THEN coalesce(json_extract_string(TRY_CAST(j0 AS JSON), '$.urgency'), urgency) END AS lu
  FROM parsed
)"""
        src = "fields"
        if with_enrichment:
            parse += """,
enr0 AS (
  SELECT f.*, e.summary, e.resolution,
         CASE WHEN json_valid(e.resolution) THEN e.resolution
              ELSE regexp_extract(e.resolution, '(?s)\\{.*?\\}', 0) END AS rj
  FROM fields f LEFT JOIN llm_enrichment e ON f.id = e.id AND f.st = 'mid'
),
enr AS (
  SELECT *, (rj IS NOT NULL AND json_valid(rj) AND json_type(TRY_CAST(rj AS JSON)) = 'OBJECT') AS rok FROM enr0
)"""
            src = "enr"
    else:
        src = "(SELECT *, FALSE AS ok, CAST(NULL AS VARCHAR) AS li, CAST(NULL AS VARCHAR) AS lu FROM staged)"
    if with_enrichment:
        esc_field = "json_extract(TRY_CAST(rj AS JSON), '$.should_escalate')"
        enrich_cols = f"""CASE WHEN st = 'mid' THEN coalesce(summary, '') ELSE '' END AS llm_summary,
    CASE WHEN st = 'mid' THEN (CASE WHEN rok THEN coalesce(json_extract_string(TRY_CAST(rj AS JSON), '$.suggested_path'), '')
                                    ELSE 'human_review' END) ELSE '' END AS suggested_path,
    CASE WHEN st = 'mid' THEN (CASE WHEN NOT rok THEN 'True'
                                    WHEN json_type({esc_field}) = 'BOOLEAN' THEN
                                         (CASE WHEN json_extract_string(TRY_CAST(rj AS JSON), '$.should_escalate') = 'true'
                                               THEN 'True' ELSE 'False' END)
                                    ELSE coalesce(json_extract_string(TRY_CAST(rj AS JSON), '$.should_escalate'), '') END)
         ELSE '' END AS should_escalate,
    CASE WHEN st = 'mid' THEN (CASE WHEN rok THEN coalesce(json_extract_string(TRY_CAST(rj AS JSON), '$.reason'), '')
                                    ELSE {sql_str(UNPARSEABLE_REASON)} END) ELSE '' END AS reason"""
    else:
        enrich_cols = "'' AS llm_summary, '' AS suggested_path, '' AS should_escalate, '' AS reason"
    return f""",
ruled AS (
  SELECT *, {sql_rule('lower(text)', 1)} AS rq, {sql_rule('lower(text)', 2)} AS ri FROM scored
),
staged AS (
  SELECT *, CASE WHEN rq IS NOT NULL THEN 'rule' WHEN prob >= CAST({hi} AS DOUBLE) THEN 'ml'
                 WHEN prob <= CAST({lo} AS DOUBLE) THEN 'band' ELSE 'mid' END AS st
  FROM ruled
){parse},
routed AS (
  SELECT id, text,
    CASE WHEN st = 'rule' THEN {sql_suffix('rq', 'urgency')}
         WHEN st = 'ml' THEN {sql_suffix(sql_queue('label'), 'urgency')}
         WHEN st = 'band' AND ok THEN {sql_suffix(sql_queue('li'), 'lu')}
         ELSE 'human_triage_queue' END AS route,
    CASE WHEN st = 'rule' THEN 'rule_based' WHEN st = 'ml' THEN 'ml_high_confidence'
         WHEN st = 'band' AND ok THEN 'llm_reasoning' ELSE 'human_fallback' END AS stage,
    CASE WHEN st = 'rule' THEN CAST(0.99 AS DOUBLE) ELSE prob END AS confidence,
    CASE WHEN st = 'rule' THEN ri WHEN st = 'ml' THEN ''
         WHEN st = 'band' THEN (CASE WHEN ok THEN li ELSE '' END) ELSE label END AS llm_issue_type,
    CASE WHEN st = 'band' AND ok THEN lu ELSE urgency END AS llm_urgency,
    {enrich_cols}
  FROM {src}
)
"""


def _sweep_sql() -> str:
    """CTE ``sweep`` over ``scored``: one conditional-aggregate row per grid threshold."""
    aggs = ",\n         ".join(
        f"count(*) FILTER (WHERE prob >= CAST({hi} AS DOUBLE)) AS a{i}, "
        f"count(*) FILTER (WHERE prob < CAST({lo} AS DOUBLE)) AS l{i}, "
        f"count(*) FILTER (WHERE prob >= CAST({lo} AS DOUBLE) AND prob < CAST({hi} AS DOUBLE)) AS h{i}, "
        f"sum(prob) FILTER (WHERE prob >= CAST({hi} AS DOUBLE)) AS s{i}"
        for i, (hi, lo) in enumerate(C.SWEEP_GRID))
    long = "\n  UNION ALL ".join(
        f"SELECT CAST({hi} AS DOUBLE) AS th, CAST({lo} AS DOUBLE) AS tl, n, a{i} AS a, l{i} AS l, h{i} AS h, s{i} AS s "
        f"FROM agg1 WHERE n > 0" for i, (hi, lo) in enumerate(C.SWEEP_GRID))
    wt = C.SweepWeights()
    return f""",
agg1 AS (
  SELECT count(*) AS n,
         {aggs}
  FROM scored
),
agg AS (
  {long}
),
rates AS (
  SELECT th AS threshold_high, tl AS threshold_low,
         a / CAST(n AS DOUBLE) AS auto_routed_rate_estimated,
         l / CAST(n AS DOUBLE) AS llm_fallback_rate_estimated,
         h / CAST(n AS DOUBLE) AS human_fallback_rate_estimated,
         CASE WHEN a > 0 THEN s / a ELSE CAST(0.0 AS DOUBLE) END AS avg_confidence_auto
  FROM agg
),
scores AS (
  SELECT *, CAST({C.INFRA_COST_PER_TICKET_USD!r} AS DOUBLE) + llm_fallback_rate_estimated * CAST({C.LLM_COST_PER_CALL_USD!r} AS DOUBLE) AS cost_per_ticket_usd_estimated,
         CAST({wt.auto_weight} AS DOUBLE) * auto_routed_rate_estimated AS score_automation_gain,
         CAST({wt.human_penalty} AS DOUBLE) * human_fallback_rate_estimated AS score_human_penalty,
         CAST({wt.llm_penalty} AS DOUBLE) * llm_fallback_rate_estimated AS score_llm_penalty
  FROM rates
),
sweep AS (
  SELECT threshold_high, threshold_low, auto_routed_rate_estimated, llm_fallback_rate_estimated,
         human_fallback_rate_estimated, avg_confidence_auto, cost_per_ticket_usd_estimated,
         score_automation_gain, score_human_penalty, score_llm_penalty,
         score_automation_gain - score_human_penalty - score_llm_penalty AS threshold_recommendation_score,
         CAST({wt.auto_weight} AS DOUBLE) AS weight_auto, CAST({wt.human_penalty} AS DOUBLE) AS weight_human_penalty,
         CAST({wt.llm_penalty} AS DOUBLE) AS weight_llm_penalty,
         auto_routed_rate_estimated AS auto_routed_rate, llm_fallback_rate_estimated AS llm_fallback_rate,
         human_fallback_rate_estimated AS human_fallback_rate, cost_per_ticket_usd_estimated AS est_cost_per_ticket_usd,
         row_number() OVER (ORDER BY round(score_automation_gain - score_human_penalty - score_llm_penalty, 9) DESC,
                            threshold_high ASC) = 1 AS is_recommended_threshold
  FROM scores
)
"""


def _round_select(cols_double: list[str], cols_other: list[str], src: str) -> str:
    parts = [f"round({c}, 6) AS {c}" for c in cols_double] + cols_other
    return f"SELECT {', '.join(parts)} FROM {src}"


SWEEP_DOUBLES = [
    "threshold_high", "threshold_low", "auto_routed_rate_estimated", "llm_fallback_rate_estimated",
    "human_fallback_rate_estimated", "avg_confidence_auto", "cost_per_ticket_usd_estimated",
    "score_automation_gain", "score_human_penalty", "score_llm_penalty", "threshold_recommendation_score",
    "weight_auto", "weight_human_penalty", "weight_llm_penalty", "auto_routed_rate", "llm_fallback_rate",
    "human_fallback_rate", "est_cost_per_ticket_usd",
]


def oracle_sql() -> dict[str, str]:
    tax = ", ".join(map(sql_str, C.ISSUE_TYPES))
    q: dict[str, str] = {}

    q["normalize_text"] = f"SELECT doc_id, {sql_normalize('text')} AS norm FROM documents"

    q["clean_placeholders"] = W + f"""
SELECT id, {_clean('subject')} AS subject_clean, {_clean('description')} AS description_clean FROM tickets_raw"""

    q["keyword_issue"] = W + f", {_social_norm()} SELECT id, {sql_keyword_issue('text')} AS issue_type FROM social_norm"

    desc0 = "coalesce(description, '')"
    bench_text = f"lower({sql_strip('subject')} || ' ' || {_clean(desc0)})"
    q["keyword_issue_bench"] = W + f"""
SELECT id, {sql_keyword_issue(bench_text, C.BENCHMARK_KEYWORD_RULES)} AS predicted FROM tickets_raw"""

    q["keyword_urgency"] = W + f", {_social_norm()} SELECT id, {sql_keyword_urgency('text')} AS urgency FROM social_norm"

    q["complexity"] = W + f""", {_social_norm()}
SELECT id, CAST({sql_word_count('text')} AS BIGINT) AS n_words, {sql_complexity('text')} AS complexity FROM social_norm"""

    rule_sel = f"SELECT id, {sql_rule('text', 1)} AS rule_queue, {sql_rule('text', 2)} AS rule_issue_type FROM social_norm"
    q["rule_match"] = W + f", {_social_norm()} {rule_sel}"
    q["rule_match_table"] = q["rule_match"]

    q["inbound_filter"] = W + "SELECT id, text, inbound FROM social_raw WHERE inbound"

    q["map_structured"] = W + """
SELECT id, subject, description, category, priority, label_source, source
FROM tickets_mapped"""

    q["unify"] = W + "SELECT * FROM unified"

    q["weak_labels"] = W + "SELECT id, source, text, issue_type, urgency, complexity, label_quality FROM labeled"

    q["label_composition"] = W + """
SELECT label_quality, count, round(count * 100.0 / greatest(sum(count) OVER (), 1), 6) AS pct
FROM (SELECT label_quality, count(*) AS count FROM labeled GROUP BY label_quality)"""

    q["route_offline"] = W + _routed(False) + "SELECT * REPLACE (round(confidence, 6) AS confidence) FROM routed"
    q["route_with_replies"] = W + _routed(True) + "SELECT * REPLACE (round(confidence, 6) AS confidence) FROM routed"
    q["route_staged"] = q["route_with_replies"]
    q["urgency_suffix"] = W + f"SELECT id, {sql_suffix(sql_queue('label'), 'urgency')} AS route FROM scored"

    infra, call = C.INFRA_COST_PER_TICKET_USD, C.LLM_COST_PER_CALL_USD
    q["routing_kpis"] = W + _routed(True) + f""",
k AS (
  SELECT CAST(count(*) AS DOUBLE) AS tickets,
         avg(CASE WHEN route = 'human_triage_queue' THEN 1.0 ELSE 0.0 END) AS human_triage_rate,
         avg(CASE WHEN stage = 'llm_reasoning' THEN 1.0 ELSE 0.0 END) AS llm_invocation_rate,
         avg(CASE WHEN stage = 'rule_based' THEN 1.0 ELSE 0.0 END) AS rule_based_rate,
         avg(CASE WHEN stage = 'ml_high_confidence' THEN 1.0 ELSE 0.0 END) AS ml_high_confidence_rate,
         avg(CASE WHEN stage = 'human_fallback' THEN 1.0 ELSE 0.0 END) AS human_fallback_rate,
         avg(confidence) AS avg_routing_confidence
  FROM routed
)
SELECT round(tickets, 6) AS tickets, round(human_triage_rate, 6) AS human_triage_rate,
       round(human_triage_rate, 6) AS escalation_rate, round(llm_invocation_rate, 6) AS llm_invocation_rate,
       round(rule_based_rate, 6) AS rule_based_rate, round(ml_high_confidence_rate, 6) AS ml_high_confidence_rate,
       round(human_fallback_rate, 6) AS human_fallback_rate, round(avg_routing_confidence, 6) AS avg_routing_confidence,
       round(CASE WHEN tickets > 0 THEN CAST({infra!r} AS DOUBLE) + llm_invocation_rate * CAST({call!r} AS DOUBLE) END, 6)
         AS cost_per_ticket_usd_estimated,
       round(CASE WHEN tickets > 0 THEN CAST({infra!r} AS DOUBLE) END, 6) AS infra_cost_per_ticket_usd_estimated,
       round(CASE WHEN tickets > 0 THEN CAST({call!r} AS DOUBLE) END, 6) AS llm_cost_per_call_usd_estimated
FROM k"""

    pct = ", ".join(f"format('{{:.1f}}', {c} * 100.0) || '%' AS {c}" for c in QU.REPORT_PCT_COLUMNS)
    num = ", ".join(f"format('{{:.4f}}', {c}) AS {c}" for c in QU.REPORT_NUM_COLUMNS)
    q["report_format"] = f"SELECT tickets, {pct}, {num} FROM ({q['routing_kpis']}) kpis"

    q["queue_share"] = W + _routed(True) + """
SELECT 'queue_pct_' || route AS metric, route, round(n / CAST(greatest(sum(n) OVER (), 1) AS DOUBLE), 6) AS share
FROM (SELECT route, count(*) AS n FROM routed GROUP BY route)"""

    q["threshold_sweep"] = W + _sweep_sql() + _round_select(SWEEP_DOUBLES, ["is_recommended_threshold"], "sweep")

    hi, lo = C.RoutingThresholds().high_confidence, C.RoutingThresholds().low_confidence
    q["recommend_threshold"] = W + _sweep_sql() + f"""
SELECT 'estimated_policy_from_threshold_sweep' AS metric_type,
       'estimated from the score distribution; real accuracy and response times are not part of it' AS note,
       round(threshold_high, 6) AS recommended_threshold_high, round(threshold_low, 6) AS recommended_threshold_low,
       round(auto_routed_rate_estimated, 6) AS auto_routed_rate_estimated,
       round(llm_fallback_rate_estimated, 6) AS llm_fallback_rate_estimated,
       round(human_fallback_rate_estimated, 6) AS human_fallback_rate_estimated,
       round(cost_per_ticket_usd_estimated, 6) AS cost_per_ticket_usd_estimated,
       round(score_automation_gain, 6) AS score_automation_gain, round(score_human_penalty, 6) AS score_human_penalty,
       round(score_llm_penalty, 6) AS score_llm_penalty,
       round(threshold_recommendation_score, 6) AS threshold_recommendation_score,
       round(weight_auto, 6) AS weight_auto, round(weight_human_penalty, 6) AS weight_human_penalty,
       round(weight_llm_penalty, 6) AS weight_llm_penalty,
       round(CAST({hi} AS DOUBLE), 6) AS active_threshold_high, round(CAST({lo} AS DOUBLE), 6) AS active_threshold_low,
       (CAST({hi} AS DOUBLE) = threshold_high AND CAST({lo} AS DOUBLE) = threshold_low) AS thresholds_match_recommendation
FROM sweep WHERE is_recommended_threshold"""


    # ---------------------------------------------------------------- evaluation
    cnt = """,
cnt AS (SELECT model, y AS actual_label, p AS predicted_label, count(*) AS n FROM predictions GROUP BY model, y, p),
stats AS (
  SELECT model, label, sum(tp) AS tp, sum(sup) AS sup, sum(pr) AS pr FROM (
    SELECT model, actual_label AS label, CASE WHEN actual_label = predicted_label THEN n ELSE 0 END AS tp, n AS sup, 0 AS pr FROM cnt
    UNION ALL
    SELECT model, predicted_label AS label, 0 AS tp, 0 AS sup, n AS pr FROM cnt
  ) GROUP BY model, label
),
m AS (
  SELECT model, label,
         CASE WHEN pr > 0 THEN CAST(tp AS DOUBLE) / CAST(pr AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS precision,
         CASE WHEN sup > 0 THEN CAST(tp AS DOUBLE) / CAST(sup AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS recall,
         CASE WHEN sup + pr > 0 THEN (2.0 * CAST(tp AS DOUBLE)) / CAST(sup + pr AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS f1_score,
         CAST(sup AS DOUBLE) AS support, tp, sup, pr
  FROM stats
),
summ AS (
  SELECT model, CAST(sum(sup) AS BIGINT) AS n_eval_samples, CAST(sum(tp) AS DOUBLE) / CAST(sum(sup) AS DOUBLE) AS accuracy,
         avg(f1_score) AS macro_f1, sum(f1_score * support) / sum(support) AS weighted_f1
  FROM m GROUP BY model
)
"""
    pc_cols = "model, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, round(support, 6) AS support"
    grid_sql = """,
labs AS (SELECT DISTINCT model, label FROM ({src})),
grid AS (SELECT a.model, a.label AS actual_label, b.label AS predicted_label FROM labs a JOIN labs b ON a.model = b.model)
"""
    union_labs = "SELECT model, actual_label AS label FROM cnt UNION ALL SELECT model, predicted_label AS label FROM cnt"
    true_labs = "SELECT model, actual_label AS label FROM cnt"
    q["confusion_long"] = W + cnt + grid_sql.format(src=union_labs) + """
SELECT g.model, g.actual_label, g.predicted_label, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM grid g LEFT JOIN cnt c ON g.model = c.model AND g.actual_label = c.actual_label AND g.predicted_label = c.predicted_label"""
    q["confusion_nulls"] = W + cnt.replace("FROM predictions", """FROM (
  SELECT model, CASE WHEN id % 3 = 0 THEN NULL ELSE y END AS y, CASE WHEN id % 5 = 0 THEN NULL ELSE p END AS p FROM predictions)""", 1) \
        + grid_sql.format(src=union_labs) + """
SELECT g.model, g.actual_label, g.predicted_label, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM grid g LEFT JOIN cnt c ON g.model = c.model AND g.actual_label IS NOT DISTINCT FROM c.actual_label
  AND g.predicted_label IS NOT DISTINCT FROM c.predicted_label"""
    q["confusion_restricted"] = W + cnt + grid_sql.format(src=true_labs) + """
SELECT g.model, g.actual_label AS "true", g.predicted_label AS predicted, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM grid g LEFT JOIN cnt c ON g.model = c.model AND g.actual_label = c.actual_label AND g.predicted_label = c.predicted_label"""
    wide_cols = ", ".join(
        f"CAST(coalesce(sum(CASE WHEN predicted_label = {sql_str(l)} THEN count END), 0) AS BIGINT) AS {l}"
        for l in C.ISSUE_TYPES)
    q["confusion_wide"] = W + cnt + grid_sql.format(src=union_labs) + f""",
cl AS (
  SELECT g.model, g.actual_label, g.predicted_label, coalesce(c.n, 0) AS count
  FROM grid g LEFT JOIN cnt c ON g.model = c.model AND g.actual_label = c.actual_label AND g.predicted_label = c.predicted_label
)
SELECT model, actual_label, {wide_cols} FROM cl GROUP BY model, actual_label"""
    q["per_class"] = W + cnt + f"""
SELECT {pc_cols} FROM m
UNION ALL
SELECT model, 'macro avg' AS label, round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6), round(sum(support), 6)
FROM m GROUP BY model
UNION ALL
SELECT model, 'weighted avg' AS label, round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1_score * support) / sum(support), 6), round(sum(support), 6)
FROM m GROUP BY model"""
    q["per_class_restricted"] = W + cnt + f"""
SELECT {pc_cols} FROM m WHERE (model, label) IN (SELECT model, actual_label FROM cnt)"""
    q["f1_summary"] = W + cnt + """
SELECT model, n_eval_samples, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1
FROM summ"""
    pick = lambda mdl, c: f"max(CASE WHEN model = {sql_str(mdl)} THEN {c} END)"
    ml, kw = "ml_tfidf_lr", "keyword_baseline"
    q["benchmark_summary_table"] = W + cnt + """
SELECT model AS model_name, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1,
       round(weighted_f1, 6) AS weighted_f1, CAST(0 AS BIGINT) AS n_train, n_eval_samples AS n_test,
       'measured_holdout_metadata_labels' AS metric_type, 'metadata_ticket_type' AS label_source,
       'structured support tickets' AS dataset_source
FROM summ"""
    q["benchmark_compat"] = W + cnt + f"""
SELECT round({pick(ml, 'accuracy')}, 6) AS ml_accuracy, round({pick(ml, 'macro_f1')}, 6) AS ml_macro_f1,
       round({pick(ml, 'weighted_f1')}, 6) AS ml_weighted_f1,
       round({pick(kw, 'accuracy')}, 6) AS keyword_baseline_accuracy,
       round({pick(kw, 'macro_f1')}, 6) AS keyword_macro_f1, round({pick(kw, 'weighted_f1')}, 6) AS keyword_weighted_f1,
       {pick(ml, 'n_eval_samples')} AS n_eval_samples,
       'metadata_ticket_type' AS label_source, 'structured support tickets' AS dataset_source,
       'measured_holdout_metadata_labels' AS metric_type
FROM summ"""
    q["lift"] = W + cnt + f""",
lr AS (
  SELECT {pick(ml, 'n_eval_samples')} AS n_eval_samples,
         {pick(ml, 'accuracy')} AS ml_accuracy, {pick(kw, 'accuracy')} AS keyword_baseline_accuracy,
         {pick(ml, 'macro_f1')} AS ml_macro_f1, {pick(kw, 'macro_f1')} AS keyword_macro_f1,
         {pick(ml, 'weighted_f1')} AS ml_weighted_f1, {pick(kw, 'weighted_f1')} AS keyword_weighted_f1
  FROM summ
)
SELECT 'measured_eval_set' AS metric_type, n_eval_samples,
       round(ml_accuracy, 6) AS ml_accuracy, round(keyword_baseline_accuracy, 6) AS keyword_baseline_accuracy,
       round(ml_accuracy - keyword_baseline_accuracy, 6) AS ml_accuracy_lift,
       round(ml_macro_f1, 6) AS ml_macro_f1, round(keyword_macro_f1, 6) AS keyword_macro_f1,
       round(ml_macro_f1 - keyword_macro_f1, 6) AS ml_macro_f1_lift,
       round(ml_weighted_f1, 6) AS ml_weighted_f1, round(keyword_weighted_f1, 6) AS keyword_weighted_f1,
       round(ml_weighted_f1 - keyword_weighted_f1, 6) AS ml_weighted_f1_lift
FROM lr"""

    # ---------------------------------------------------------------- sampling
    q["dedup_norm"] = W + f""", {_social_norm()}
SELECT id, norm FROM (SELECT id, text AS norm, row_number() OVER (PARTITION BY text ORDER BY id) AS rn FROM social_norm)
WHERE rn = 1"""
    q["per_class_sample"] = W + f"""
SELECT id, issue_type FROM (
  SELECT id, issue_type, row_number() OVER (PARTITION BY issue_type ORDER BY {MD5_ORDER}, id) AS rn FROM labeled
) WHERE rn <= {C.EVAL_ROWS_PER_CLASS}"""
    q["stratified_split"] = W + f"""
SELECT id, issue_type, CASE WHEN rn <= least((n + 4) // 5, n - 1) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT id, issue_type, row_number() OVER (PARTITION BY issue_type ORDER BY {MD5_ORDER}, id) AS rn,
         count(*) OVER (PARTITION BY issue_type) AS n FROM labeled)"""
    q["kfold_assign"] = W + f"""
SELECT id, issue_type, CAST((rn - 1) % 5 AS INTEGER) AS fold FROM (
  SELECT id, issue_type, row_number() OVER (PARTITION BY issue_type ORDER BY {MD5_ORDER}, id) AS rn FROM labeled)"""
    q["hash_sample"] = W + f"SELECT id, text FROM labeled ORDER BY {MD5_ORDER}, id LIMIT {C.ROUTING_SAMPLE_CAP}"
    q["hash_sample_small"] = W + f"SELECT id, text FROM labeled ORDER BY {MD5_ORDER}, id LIMIT 50"
    nulls = "(SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE issue_type END AS issue_type FROM labeled)"
    q["stratified_split_nulls"] = q["stratified_split"].replace("FROM labeled)", f"FROM {nulls})")
    q["kfold_assign_nulls"] = q["kfold_assign"].replace("FROM labeled)", f"FROM {nulls})")
    q["route_nan"] = W.replace("CAST((id * 37) % 71 + 29 AS DOUBLE) / 100.0 AS prob",
                               "CASE WHEN id % 4 = 1 THEN NULL ELSE CAST((id * 37) % 71 + 29 AS DOUBLE) / 100.0 END AS prob") \
        + _routed(False) + "SELECT id, route, stage FROM routed"
    q["route_repeated_replies"] = q["route_with_replies"]
    q["rule_match_wide"] = W + """,
rules AS (SELECT DISTINCT n FROM (SELECT p_partkey * 7 % 10007 AS n FROM part UNION ALL SELECT o_orderkey * 3 + 100 FROM orders)),
texts AS (SELECT DISTINCT lower(description) AS text FROM tickets_raw WHERE description IS NOT NULL),
refs AS (SELECT text, regexp_extract(text, 'ref ([0-9]+)$', 1) AS ref FROM texts),
hits AS (
  SELECT text, min(n) AS n FROM (SELECT text, substr(ref, 1, CAST(k AS INTEGER)) AS lead FROM (SELECT text, ref, unnest(range(1, length(ref) + 1)) AS k FROM refs))
  JOIN rules ON lead = CAST(n AS VARCHAR) GROUP BY text
)
SELECT t.id % 7 AS id, lower(t.description) AS text, 'queue_' || CAST(n % 11 AS VARCHAR) AS rule_queue,
       'issue_' || CAST(n % 5 AS VARCHAR) AS rule_issue_type
FROM tickets_raw t LEFT JOIN hits h ON lower(t.description) = h.text"""
    q["balanced_weights"] = W + """
SELECT id, issue_type, round((SELECT count(*) FROM labeled) * 1.0 / ((SELECT count(DISTINCT issue_type) FROM labeled)
       * count(*) OVER (PARTITION BY issue_type)), 6) AS weight FROM labeled"""

    def tfidf(rows: str, tf: str, min_df: int) -> str:
        return f""",
toks AS (SELECT id, unnest(regexp_extract_all(text, '\\b\\w\\w+\\b')) AS term FROM ({rows})),
tfs AS (SELECT id, term, {tf} AS tf FROM toks GROUP BY id, term),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term HAVING count(*) >= {min_df}),
raw AS (SELECT id, term, tf * (ln(((SELECT count(*) FROM ({rows})) + 1.0) / (df + 1.0)) + 1.0) AS w FROM tfs JOIN dfs USING (term)),
weights AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM raw)"""

    q["tfidf_weights"] = W + tfidf("SELECT id, text FROM labeled", "count(*)", 1) + \
        " SELECT id, term, round(weight, 6) AS weight FROM weights"
    docs = f"SELECT doc_id AS id, {sql_normalize('text')} AS text FROM documents"
    q["tfidf_weights_documents"] = W + tfidf(docs, "1 + ln(count(*))", 2) + \
        " SELECT id, count(*) AS n_terms, round(sum(weight * weight), 6) AS norm FROM weights GROUP BY id"
    q["tfidf_lr_score"] = f"SELECT split, issue_type, count(*) AS n, count(*) AS n_sound, count(*) AS n_predicted " \
        f"FROM ({q['stratified_split']}) GROUP BY split, issue_type"
    q["calibrated_score"] = q["tfidf_lr_score"]
    q["cv_accuracy"] = "SELECT CAST(fold AS INTEGER) AS fold, TRUE AS is_share, TRUE AS mean_fits, TRUE AS std_fits FROM range(5) t(fold)"
    q["model_to_route"] = W + _routed(False).replace("FROM scored", "FROM labeled").replace("SELECT *, ", "SELECT *, ") \
        .split("staged AS")[0].rstrip().rstrip(",") + \
        " SELECT count(*) AS n, count(rq) AS n_rule, 0 AS n_without_route FROM ruled"
    q["positional_split"] = W + f"""
SELECT id, CASE WHEN rn <= (n * 4) // 5 THEN 'train' ELSE 'test' END AS split FROM (
  SELECT id, row_number() OVER (ORDER BY {MD5_ORDER}, id) AS rn, count(*) OVER () AS n FROM labeled)"""

    # ---------------------------------------------------------------- eval set
    ttype_key = f"lower({sql_strip('raw_ticket_type')})"
    prio_key = f"lower({sql_strip('raw_priority')})"
    ev = f""",
cand0 AS (
  SELECT id, {sql_strip(sql_strip("coalesce(subject, '')") + " || '. ' || " + _clean("coalesce(description, '')"))} AS text,
         type AS raw_ticket_type, priority AS raw_priority
  FROM tickets_raw
),
cand1 AS (
  SELECT *, {sql_map(ttype_key, C.TICKET_TYPE_MAP)} AS issue_type,
         coalesce({sql_map(prio_key, C.TICKET_PRIORITY_MAP)}, 'medium') AS urgency
  FROM cand0 WHERE length(text) >= {C.EVAL_MIN_TEXT_LEN}
),
cand2 AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {sql_normalize('text')} ORDER BY id) AS rn FROM cand1
                 WHERE issue_type IS NOT NULL) WHERE rn = 1
),
cand AS (
  SELECT id, text, issue_type, urgency, 'metadata_ticket_type' AS eval_label_source, raw_ticket_type, raw_priority
  FROM (SELECT *, row_number() OVER (PARTITION BY issue_type ORDER BY {MD5_ORDER}, id) AS rn2 FROM cand2)
  WHERE rn2 <= {C.EVAL_ROWS_PER_CLASS}
),
base AS (
  SELECT id, text, issue_type, urgency, 'manually_written' AS eval_label_source, '' AS raw_ticket_type, urgency AS raw_priority
  FROM labeled WHERE label_quality = 'real'
),
newc AS (
  SELECT * FROM cand c
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE {sql_normalize('b.text')} = {sql_normalize('c.text')})
),
es AS (SELECT * FROM base UNION ALL SELECT * FROM newc)
"""
    q["anti_join_eval"] = W + ev + "SELECT * FROM newc"
    q["eval_set"] = W + ev + "SELECT * FROM es"
    q["eval_set_checks"] = W + ev + f""",
chk AS (
  SELECT issue_type AS y, {sql_normalize('text')} AS norm,
         (text IS NULL OR {sql_strip('text')} = '') AS missing
  FROM es
),
chk2 AS (SELECT *, {sql_keyword_issue('norm')} AS kw FROM chk),
r AS (
  SELECT CAST(count(*) AS DOUBLE) AS n,
         CAST(sum(CASE WHEN missing THEN 1 ELSE 0 END) AS DOUBLE) AS missing_text,
         CAST(sum(CASE WHEN y IS NULL OR y NOT IN ({tax}) THEN 1 ELSE 0 END) AS DOUBLE) AS outside,
         count(norm) AS with_text, count(DISTINCT norm) AS n_distinct,
         CAST(sum(CASE WHEN kw <> 'other' AND kw = y THEN 1 ELSE 0 END) AS DOUBLE) AS easy
  FROM chk2
),
pc AS (SELECT issue_type AS y, count(*) AS n FROM es GROUP BY issue_type)
SELECT 'rows' AS check_name, n AS value FROM r
UNION ALL SELECT 'missing_text', missing_text FROM r
UNION ALL SELECT 'label_outside_taxonomy', outside FROM r
UNION ALL SELECT 'duplicate_rows', CAST(with_text - n_distinct AS DOUBLE) FROM r
UNION ALL SELECT 'duplicate_rate', round(CAST(with_text - n_distinct AS DOUBLE) / greatest(with_text, 1), 6) FROM r
UNION ALL SELECT 'keyword_recoverable', easy FROM r
UNION ALL SELECT 'keyword_recoverable_rate', round(easy / greatest(n, 1.0), 6) FROM r
UNION ALL SELECT 'classes_below_min',
  CAST({len(C.ISSUE_TYPES)} - (SELECT count(*) FROM pc WHERE y IN ({tax}) AND n >= {C.EVAL_MIN_PER_CLASS}) AS DOUBLE)"""
    q["eval_summary"] = W + ev + """,
counts AS (SELECT eval_label_source, issue_type, count(*) AS n FROM es GROUP BY eval_label_source, issue_type),
grid AS (
  SELECT eval_label_source, unnest((SELECT list(DISTINCT issue_type) FROM counts)) AS issue_type
  FROM (SELECT DISTINCT eval_label_source FROM counts)
)
SELECT g.eval_label_source, g.issue_type, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM grid g LEFT JOIN counts c ON g.eval_label_source = c.eval_label_source AND g.issue_type = c.issue_type
ORDER BY 1, 2"""
    q["unmapped_count"] = W + f"""
SELECT CAST(count(*) FILTER (WHERE {sql_map(f"lower({sql_strip('type')})", C.TICKET_TYPE_MAP)} IS NULL) AS BIGINT) AS unmapped
FROM tickets_raw"""

    # ---------------------------------------------------------------- reports
    q["route_enriched"] = W + _routed(True, True) + "SELECT * REPLACE (round(confidence, 6) AS confidence) FROM routed"
    R = W + _routed(True)
    q["freq_tables"] = R + """
SELECT 'stage' AS dimension, stage AS value, count(*) AS count FROM routed GROUP BY stage
UNION ALL SELECT 'route', route, count(*) FROM routed GROUP BY route
UNION ALL SELECT 'urgency', llm_urgency, count(*) FROM routed WHERE llm_urgency <> '' GROUP BY llm_urgency"""
    q["confidence_histogram"] = R + """
SELECT stage, CAST(least(floor(confidence * 40.0) + 1, 40) AS INTEGER) AS bin, count(*) AS count
FROM routed GROUP BY 1, 2"""
    q["urgency_order"] = R + """
SELECT llm_urgency AS urgency, count(*) AS count,
       CAST(list_position(['critical', 'high', 'medium', 'low'], llm_urgency) AS BIGINT) AS urgency_rank
FROM routed WHERE llm_urgency <> '' GROUP BY llm_urgency"""
    q["stage_display"] = R + f"""
SELECT stage, coalesce({sql_map('stage', C.STAGE_LABELS)}, stage) AS stage_label, count(*) AS count FROM routed GROUP BY stage"""
    SW = W + _sweep_sql()
    q["rates_long"] = SW + " UNION ALL ".join(
        f"SELECT round(threshold_high, 6) AS threshold_high, '{c}' AS variable, round({c}, 6) AS value FROM sweep"
        for c in ("auto_routed_rate_estimated", "llm_fallback_rate_estimated", "human_fallback_rate_estimated"))
    q["cost_curve"] = SW + """
SELECT round(threshold_high, 6) AS threshold_high, round(cost_per_ticket_usd_estimated * 1000.0, 6) AS cost_milli_usd FROM sweep"""
    q["f1_by_label_outer"] = W + cnt + f"""
SELECT coalesce(a.label, b.label) AS label, round(coalesce(a.f1_score, 0.0), 6) AS f1_model,
       round(coalesce(b.f1_score, 0.0), 6) AS f1_keyword
FROM (SELECT label, f1_score FROM m WHERE model = '{ml}') a
FULL OUTER JOIN (SELECT label, f1_score FROM m WHERE model = '{kw}') b ON a.label = b.label"""
    q["best_model"] = W + cnt + f"""
SELECT model, n_eval_samples, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1
FROM summ WHERE model <> '{kw}' ORDER BY macro_f1 DESC, model LIMIT 1"""
    q["enriched_listing"] = W + _routed(True, True) + """
SELECT id, text, round(confidence, 6) AS confidence, llm_urgency, suggested_path, should_escalate, reason, llm_summary
FROM routed WHERE stage = 'human_fallback' AND suggested_path <> ''"""

    q["queue_counts"] = R + """
SELECT route, count, max(count) OVER () AS max_count FROM (SELECT route, count(*) AS count FROM routed GROUP BY route)"""
    q["local_training_frame"] = W + ev + f""",
lt AS (SELECT id, {sql_normalize('text')} AS text, issue_type, urgency FROM es)
SELECT id, text, issue_type, urgency, {sql_complexity('text')} AS complexity, 'real' AS label_quality FROM lt"""
    bmap = C.BENCHMARK_TYPE_MAP
    btype_key = "lower(" + sql_strip("coalesce(type, '')") + ")"
    bench_ctes = f""",
b0 AS (
  SELECT id, {sql_strip("coalesce(subject, '')")} || ' ' || {_clean("coalesce(description, '')")} AS text,
         {sql_map(btype_key, bmap)} AS issue_type
  FROM tickets_raw
),
b1 AS (
  SELECT * FROM b0 WHERE issue_type IS NOT NULL AND length(text) >= {C.BENCHMARK_MIN_TEXT_LEN}
)
"""
    q["benchmark_dedup_dropped"] = W + bench_ctes + "SELECT count(*) - count(DISTINCT text) AS dropped FROM b1"
    q["benchmark_rows"] = W + bench_ctes + f"""
SELECT id, {sql_strip('text')} AS text, issue_type FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY id) AS rn FROM b1) WHERE rn = 1"""

    # ---------------------------------------------------------------- models
    pad = "(' ' || w || ' ')"
    grams = (f"flatten(list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''), "
             f"lambda w: flatten(list_transform(range(3, least(5, length({pad})) + 1), "
             f"lambda n: list_transform(range(0, length({pad}) - n + 1), lambda o: substring({pad}, o + 1, n))))))")
    q["benchmark_summary"] = W + bench_ctes + """,
rows_b AS (SELECT issue_type, row_number() OVER (PARTITION BY issue_type ORDER BY id) AS rn, count(*) OVER (PARTITION BY issue_type) AS n
           FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY id) AS first FROM b1) WHERE first = 1),
sizes AS (SELECT count(*) FILTER (WHERE rn > least((n + 4) // 5, n - 1)) AS train, count(*) FILTER (WHERE rn <= least((n + 4) // 5, n - 1)) AS test FROM rows_b)
SELECT model, CASE WHEN model = 'keyword_baseline' THEN 0 ELSE train END AS n_train, test AS n_test, TRUE AS are_shares
FROM sizes, (VALUES ('keyword_baseline'), ('ml_baseline'), ('ml_improved')) m(model)"""
    q["char_ngrams"] = W + f"""
SELECT id, CAST(len(g) AS BIGINT) AS n_ngrams, CAST(len(list_distinct(g)) AS BIGINT) AS n_distinct
FROM (SELECT id, {grams} AS g FROM social_raw)"""
    q["label_index"] = W + """
SELECT id, issue_type, CAST(dense_rank() OVER (ORDER BY issue_type) - 1 AS INTEGER) AS label_index FROM labeled"""

    # ---------------------------------------------------------------- checks that a wrong model or job fails
    nan_w = W.replace("CAST((id * 37) % 71 + 29 AS DOUBLE) / 100.0 AS prob",
                      "CASE WHEN id % 4 = 1 THEN NULL ELSE CAST((id * 37) % 71 + 29 AS DOUBLE) / 100.0 END AS prob")
    q["sweep_nan"] = nan_w + _sweep_sql() + _round_select(SWEEP_DOUBLES, ["is_recommended_threshold"], "sweep")

    def isotonic(points: str, out: str) -> str:
        """Least-squares monotone fit of (x, n, h) by the max-min formula."""
        return f""",
pts AS ({points}),
p AS (SELECT *, row_number() OVER (ORDER BY x) AS i, sum(n) OVER (ORDER BY x) AS cn, sum(h) OVER (ORDER BY x) AS ch FROM pts),
ab AS (SELECT a.i AS a, b.i AS b, CAST(b.ch - a.ch + a.h AS DOUBLE) / CAST(b.cn - a.cn + a.n AS DOUBLE) AS m FROM p a JOIN p b ON a.i <= b.i),
low AS (SELECT p.i, a, min(m) AS m FROM p JOIN ab ON a <= p.i AND b >= p.i GROUP BY p.i, a),
fit AS (SELECT i, max(m) AS fitted FROM low GROUP BY i)
SELECT {out}, round(fitted, 6) AS fitted FROM p JOIN fit USING (i)"""

    q["calibration_curve"] = W + isotonic(
        "SELECT prob AS x, count(*) AS n, CAST(count(*) FILTER (WHERE (id * 7919) % 101 < (id * 37) % 71 + 29) AS BIGINT) AS h FROM scored GROUP BY prob",
        "round(x, 6) AS score, n")
    q["calibration_cells"] = "WITH z AS (SELECT doc_id, n_chars, CAST(n_chars % 997 AS DOUBLE) / 200 - 2.5 AS z FROM documents)" + isotonic(
        "SELECT CAST(least(floor(64 / (1 + exp(-z))), 63) AS INTEGER) AS x, count(*) AS n, "
        "CAST(count(*) FILTER (WHERE (doc_id * 7919) % 101 < (n_chars % 997) / 10.0) AS BIGINT) AS h FROM z GROUP BY 1", "x AS cell, n, h AS hits")
    q["fold_terms"] = W + f""",
folds AS (SELECT id, CAST((rn - 1) % 5 AS INTEGER) AS fold FROM (
  SELECT id, row_number() OVER (PARTITION BY issue_type ORDER BY {MD5_ORDER}, id) AS rn FROM labeled)),
toks AS (SELECT id, unnest(regexp_extract_all(text, '\\b\\w\\w+\\b')) AS term FROM labeled)
SELECT CAST(f AS INTEGER) AS fold, term, count(*) AS tf, count(DISTINCT id) AS df
FROM toks JOIN folds USING (id) JOIN range(5) r(f) ON f <> fold GROUP BY f, term"""
    weak = f""",
weak AS (SELECT id, text, {sql_keyword_issue('text')} AS label FROM labeled)"""
    q["lr_optimality"] = W + weak + """
SELECT label, least(40000, (SELECT count(DISTINCT term) FROM (SELECT unnest(regexp_extract_all(text, '\\b\\w\\w+\\b')) AS term FROM labeled))) AS n_terms,
       TRUE AS at_optimum
FROM (SELECT DISTINCT label FROM weak)"""
    tests = f"""
SELECT label, count(*) AS n_test, TRUE AS is_learned{{more}} FROM (
  SELECT label, row_number() OVER (PARTITION BY label ORDER BY {MD5_ORDER}, id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM weak)
WHERE rn <= least((n + 4) // 5, n - 1) GROUP BY label"""
    q["learned_labels"] = W + weak + tests.format(more="")
    q["calibrated_labels"] = W + weak + tests.format(more=", TRUE AS is_calibrated")
    q["cv_learned"] = "SELECT CAST(fold AS INTEGER) AS fold, TRUE AS is_learned, TRUE AS mean_fits, TRUE AS std_fits FROM range(5) t(fold)"
    q["train_targets"] = W + f""",
labels2 AS (
  SELECT id, 'issue_type' AS target, issue_type AS label FROM labeled
  UNION ALL SELECT id, 'keyword', {sql_keyword_issue('text')} FROM labeled
)
SELECT target, label, count(*) AS support, TRUE AS is_learned FROM (
  SELECT target, label, row_number() OVER (PARTITION BY target, label ORDER BY {MD5_ORDER}, id) AS rn,
         count(*) OVER (PARTITION BY target, label) AS n FROM labels2)
WHERE rn <= least((n + 4) // 5, n - 1) GROUP BY target, label"""
    q["model_roundtrip"] = W + weak + " SELECT label, count(*) AS n, count(*) AS n_equal FROM weak GROUP BY label"

    q["sublinear_weights"] = W + tfidf(docs, "1 + ln(count(*))", 2) + " SELECT id, term, round(weight, 6) AS weight FROM weights"
    q["benchmark_models"] = f"SELECT model, label, n_test, is_learned FROM ({q['learned_labels']}), (VALUES ('ml_baseline'), ('ml_improved')) m(model)"
    q["local_run"] = W + ev + """
SELECT issue_type AS name, count(*) AS n FROM es GROUP BY issue_type
UNION ALL SELECT 'routed', count(*) FROM es UNION ALL SELECT 'sweep', 10"""

    # ---------------------------------------------------------------- calls, files, jobs
    staged = _routed(False).split("staged AS")[0] + "staged AS" + _routed(False).split("staged AS")[1].split("routed AS")[0].rstrip().rstrip(",")

    def answer(prompt: str) -> str:
        return ("CASE WHEN strpos(text, 'opening hours') > 0 THEN NULL ELSE '{\"issue_type\": \"ads\", \"suggested_path\": \"queue\", \"length\": ' "
                f"|| CAST({len(prompt)} + length(text) AS VARCHAR) || '}}' END")

    refused = "CASE WHEN strpos(text, 'opening hours') > 0 THEN 'refused' END"
    q["classify_calls"] = W + staged + f"""
SELECT id, {answer(MC.CLASSIFY_PROMPT)} AS reply, {refused} AS error FROM staged WHERE st = 'band'"""
    q["enrichment_calls"] = W + staged + f"""
SELECT id, coalesce({answer(MC.SUMMARY_PROMPT)}, '') AS summary, {answer(MC.RESOLUTION_PROMPT)} AS resolution, {refused} AS resolution_error
FROM staged WHERE st = 'mid'"""
    q["csv_folder"] = W + "SELECT id, '\"quoted\", ' || text || chr(10) || ', end' AS text, inbound FROM social_raw"
    q["labeled_csv"] = W + "SELECT id, coalesce(subject, '') || ' ' || coalesce(description, '') AS text, issue_type FROM labeled"
    q["result_tables"] = R + """
SELECT stage AS name, count(*) AS n FROM routed GROUP BY stage
UNION ALL SELECT 'share', count(DISTINCT route) FROM routed UNION ALL SELECT 'stale', 0 UNION ALL SELECT 'missing', -1"""
    q["kpis_empty"] = "SELECT CAST(0.0 AS DOUBLE) AS tickets, " + ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in KP.KPI_COLUMNS if c != "tickets")
    q["cross_fill"] = W + """
SELECT id, 'no subject' AS "case", description AS subject, description FROM tickets_raw
UNION ALL SELECT id, 'no description', subject, subject FROM tickets_raw"""
    q["triage_job"] = W + f"""
SELECT 'labeled' AS name, count(*) AS n FROM labeled UNION ALL SELECT 'routed', count(*) FROM labeled
UNION ALL SELECT 'by_rule', count({sql_rule('lower(text)', 1)}) FROM labeled UNION ALL SELECT 'sweep', 10 UNION ALL SELECT 'kpis_fit', 1"""

    _ = (tax, sql_contains_any)
    return q

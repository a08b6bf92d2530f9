"""Explicit schemas at the boundaries."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


RAW_SOCIAL = _st(("text", S), ("inbound", B))
RAW_TICKETS = _st(("Ticket Subject", S), ("Ticket Description", S), ("Ticket Type", S), ("Ticket Priority", S))
UNIFIED = _st(("id", L), ("subject", S), ("description", S), ("category", S), ("priority", S),
              ("label_source", S), ("source", S))
SCORED = _st(("id", L), ("text", S), ("label", S), ("prob", D), ("urgency", S))
ROUTED = _st(("id", L), ("text", S), ("route", S), ("stage", S), ("confidence", D), ("llm_issue_type", S),
             ("llm_urgency", S), ("llm_summary", S), ("suggested_path", S), ("should_escalate", S), ("reason", S))
PER_CLASS = _st(("model", S), ("label", S), ("precision", D), ("recall", D), ("f1_score", D), ("support", D))
CONFUSION = _st(("model", S), ("actual_label", S), ("predicted_label", S), ("count", L))
EVAL_COMPARISON = _st(("metric_type", S), ("n_eval_samples", L), ("ml_accuracy", D), ("keyword_baseline_accuracy", D),
                      ("ml_accuracy_lift", D), ("ml_macro_f1", D), ("keyword_macro_f1", D), ("ml_macro_f1_lift", D),
                      ("ml_weighted_f1", D), ("keyword_weighted_f1", D), ("ml_weighted_f1_lift", D))
EVAL_SET = _st(("id", L), ("text", S), ("issue_type", S), ("urgency", S), ("eval_label_source", S),
               ("raw_ticket_type", S), ("raw_priority", S))
EVAL_SUMMARY = _st(("eval_label_source", S), ("issue_type", S), ("count", L))
REPORT = _st(("section", S), ("metric", S), ("value", S))

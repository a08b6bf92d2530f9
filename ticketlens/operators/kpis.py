"""Routing KPIs and estimated cost: one partial-aggregated pass over the routed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from .labels import with_share

KPI_COLUMNS = (
    "tickets", "human_triage_rate", "escalation_rate", "llm_invocation_rate", "rule_based_rate",
    "ml_high_confidence_rate", "human_fallback_rate", "avg_routing_confidence",
    "cost_per_ticket_usd_estimated", "infra_cost_per_ticket_usd_estimated", "llm_cost_per_call_usd_estimated",
)


def _rate(cond):
    return F.avg(cond.cast("double"))


def routing_kpis(routed: DataFrame, cost: C.CostModel = C.CostModel()) -> DataFrame:
    """One row.  ``escalation_rate`` is an alias of ``human_triage_rate`` (a proxy).
    ``llm_invocation_rate`` counts successful replies only.  On empty input only
    ``tickets = 0.0`` is set; every other column is null."""
    stage, route = F.col("stage"), F.col("route")
    agg = routed.agg(
        F.count(F.lit(1)).cast("double").alias("tickets"),
        _rate(route == C.HUMAN_QUEUE).alias("human_triage_rate"),
        _rate(stage == C.STAGE_LLM).alias("llm_invocation_rate"),
        _rate(stage == C.STAGE_RULE).alias("rule_based_rate"),
        _rate(stage == C.STAGE_ML).alias("ml_high_confidence_rate"),
        _rate(stage == C.STAGE_HUMAN).alias("human_fallback_rate"),
        F.avg("confidence").alias("avg_routing_confidence"),
    )
    some = F.col("tickets") > 0

    def guarded(c):
        return F.when(some, c)

    return agg.select(
        "tickets", "human_triage_rate",
        F.col("human_triage_rate").alias("escalation_rate"),
        "llm_invocation_rate", "rule_based_rate", "ml_high_confidence_rate", "human_fallback_rate",
        "avg_routing_confidence",
        guarded(F.lit(cost.infra_cost_per_ticket) + F.col("llm_invocation_rate") * F.lit(cost.llm_cost_per_call))
        .alias("cost_per_ticket_usd_estimated"),
        guarded(F.lit(cost.infra_cost_per_ticket)).alias("infra_cost_per_ticket_usd_estimated"),
        guarded(F.lit(cost.llm_cost_per_call)).alias("llm_cost_per_call_usd_estimated"),
    )


def queue_share(routed: DataFrame) -> DataFrame:
    """Normalised queue counts: ``metric = 'queue_pct_' || route``, ``route``, ``share``."""
    counts = routed.groupBy("route").agg(F.count(F.lit(1)).alias("_n"))
    return with_share(counts, "_n", "share").select(
        F.concat(F.lit("queue_pct_"), F.col("route")).alias("metric"), "route", "share")


def queue_share_wide(routed: DataFrame) -> DataFrame:
    """One row with a ``queue_pct_<route>`` column per route (pivot over the small share table)."""
    return queue_share(routed).groupBy().pivot("metric").agg(F.first("share"))

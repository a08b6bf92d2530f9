"""Report tables behind the dashboard panels and preview images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import lookup as LK

URGENCY_DISPLAY_ORDER = ("critical", "high", "medium", "low")
HISTOGRAM_BINS = 40
RATE_COLUMNS = ("auto_routed_rate_estimated", "llm_fallback_rate_estimated", "human_fallback_rate_estimated")


def frequency_tables(routed: DataFrame) -> DataFrame:
    """Stage, route and (non-empty) urgency counts in one pass: ``(dimension, value, count)``."""
    g = routed.groupingSets([["stage"], ["route"], ["llm_urgency"]], "stage", "route", "llm_urgency") \
        .agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("_gid"))
    # grouping_id bits (stage, route, llm_urgency), 1 = rolled up: 0b011 stage, 0b101 route, 0b110 urgency
    gid = F.col("_gid")
    dim = F.when(gid == 3, F.lit("stage")).when(gid == 5, F.lit("route")).otherwise(F.lit("urgency"))
    value = F.when(gid == 3, F.col("stage")).when(gid == 5, F.col("route")).otherwise(F.col("llm_urgency"))
    out = g.select(dim.alias("dimension"), value.alias("value"), "count")
    return out.filter(~((F.col("dimension") == "urgency") & (F.col("value") == "")))


def confidence_histogram(routed: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts per stage and fixed ``[0, 1]`` bin; 1.0 falls in the last bin."""
    b = F.least(F.floor(F.col("confidence") * F.lit(float(bins))) + 1, F.lit(bins)).cast("int")
    return routed.groupBy("stage", b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def urgency_counts_ordered(routed: DataFrame) -> DataFrame:
    """Non-empty urgency counts with their display rank (critical first)."""
    order = F.array(*[F.lit(u) for u in URGENCY_DISPLAY_ORDER])
    counts = routed.filter(F.col("llm_urgency") != "").groupBy(F.col("llm_urgency").alias("urgency")) \
        .agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("urgency_rank", F.array_position(order, F.col("urgency"))) \
        .orderBy("urgency_rank", "urgency")


def queue_counts(routed: DataFrame) -> DataFrame:
    """Route counts in ascending order, with the largest count on every row (bar scale)."""
    from pyspark.sql import Window

    c = routed.groupBy("route").agg(F.count(F.lit(1)).alias("count"))
    return c.withColumn("max_count", F.max("count").over(Window.partitionBy())).orderBy("count", "route")


def rates_long(sweep: DataFrame, rate_cols=RATE_COLUMNS) -> DataFrame:
    """Wide sweep rates → ``(threshold_high, variable, value)``."""
    return sweep.unpivot("threshold_high", list(rate_cols), "variable", "value")


def cost_curve(sweep: DataFrame) -> DataFrame:
    """Estimated cost per ticket in thousandths of a dollar, per threshold."""
    return sweep.select("threshold_high", (F.col("cost_per_ticket_usd_estimated") * 1000.0).alias("cost_milli_usd"))


def format_report(df: DataFrame, pct_cols=(), num_cols=(), digits: int = 4) -> DataFrame:
    """Report numbers as text: percentages with one decimal, others with fixed digits."""
    return df.withColumns({
        **{c: F.format_string("%.1f%%", F.col(c) * 100.0) for c in pct_cols},
        **{c: F.format_string(f"%.{int(digits)}f", F.col(c).cast("double")) for c in num_cols},
    })


def stage_display(routed: DataFrame) -> DataFrame:
    """Stage counts with display names (unknown stages keep their key)."""
    counts = routed.groupBy("stage").agg(F.count(F.lit(1)).alias("count"))
    return counts.select("stage", F.coalesce(LK.map_lookup("stage", C.STAGE_LABELS), F.col("stage"))
                         .alias("stage_label"), "count")


def f1_by_label(per_class: DataFrame, model_a: str = "ml_tfidf_lr", model_b: str = "keyword_baseline") -> DataFrame:
    """Per-label F1 of two models side by side (full-outer semantics: a label of either
    model appears, missing → 0); aggregate rows are left out.  One conditional aggregation
    instead of a self join."""
    real = per_class.filter(~F.col("label").isin(*C.REPORT_AGGREGATE_ROWS) & F.col("model").isin(model_a, model_b))
    return real.groupBy("label").agg(
        F.coalesce(F.max(F.when(F.col("model") == model_a, F.col("f1_score"))), F.lit(0.0)).alias("f1_model"),
        F.coalesce(F.max(F.when(F.col("model") == model_b, F.col("f1_score"))), F.lit(0.0)).alias("f1_keyword"),
    )


def best_model(summary: DataFrame, baseline: str = "keyword_baseline", name_col: str = "model") -> DataFrame:
    """The best non-baseline model by macro-F1 (ties: lowest name)."""
    return summary.filter(F.col(name_col) != baseline).orderBy(F.col("macro_f1").desc(), F.col(name_col)).limit(1)


def enriched_listing(routed: DataFrame) -> DataFrame:
    """Human-fallback rows that carry model guidance."""
    return routed.filter((F.col("stage") == C.STAGE_HUMAN) & (F.col("suggested_path") != "")).select(
        "id", "text", "confidence", "llm_urgency", "suggested_path", "should_escalate", "reason", "llm_summary")

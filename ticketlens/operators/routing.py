"""Routing cascade: rule → high-confidence ML → model reply (low band) → human.

The stage is decided once per row with an ordered ``CASE`` chain.  Only rows that
need a reply (low band) or an enrichment (middle band) are joined with the reply
tables; every other row is routed in place, without a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import lookup as LK
from ..functions import replies as RP
from ..functions import text as TX
from ..functions.names import free_names

ROUTED_COLUMNS = ("id", "text", "route", "stage", "confidence", "llm_issue_type", "llm_urgency",
                  "llm_summary", "suggested_path", "should_escalate", "reason")

_LOW_BAND = "_low_band"
_MIDDLE = "_middle"

UNPARSEABLE_REASON = "unparseable or failed model reply"

# Band column of a staged table (``stage_table``).  A visible name: it is the partition
# column of the written scored table, and readers skip folders whose names start with "_".
BAND_COL = "routing_band"


def assign_stage(scored: DataFrame, thresholds: C.RoutingThresholds = C.RoutingThresholds(),
                 text_col: str = "text", prob_col: str = "prob", rules=C.RULE_PATTERNS) -> DataFrame:
    """Adds ``_rule`` (struct or null) and ``_stage``: rule, ML, low band or middle band.

    Order matters: rules beat any probability; ``>= high`` is tested before ``<= low``.
    """
    lowered, = free_names([*scored.columns, "_rule", "_stage"], "_lower")
    rule = LK.rule_match(F.col(lowered), rules)      # a column: inside a generator every rule would lower the text again
    # Band filters test ``_stage``; ``evaluated_once`` keeps the rule chain out of them.
    return (scored.withColumn(lowered, F.lower(F.col(text_col))).withColumn("_rule", TX.evaluated_once(rule)).drop(lowered)
            .withColumn("_stage", _stage_of(F.col(prob_col), thresholds)))


def _stage_of(prob: Column, thresholds: C.RoutingThresholds) -> Column:
    """The stage of a row with column ``_rule`` (null: no rule hit)."""
    return (
        F.when(F.col("_rule").isNotNull(), F.lit(C.STAGE_RULE))
        # Spark orders NaN above all numbers; a NaN probability meets neither threshold
        .when(~F.isnan(prob) & (prob >= F.lit(float(thresholds.high_confidence))), F.lit(C.STAGE_ML))
        .when(prob <= F.lit(float(thresholds.low_confidence)), F.lit(_LOW_BAND))
        .otherwise(F.lit(_MIDDLE))
    )


def stage_table(scored: DataFrame, thresholds: C.RoutingThresholds = C.RoutingThresholds(),
                text_col: str = "text", prob_col: str = "prob", rules=C.RULE_PATTERNS) -> DataFrame:
    """The scored table with its rule match (``_rule``) and band (``routing_band``) stored.

    Written partitioned by ``routing_band``, it lets routing, band selection for model calls
    and enrichment read only the partitions they need (partition pruning) instead of
    scanning the whole table once per branch and recomputing the rule chain each time.
    Read it back with ``staged=True``; the thresholds are the ones used here.
    """
    return assign_stage(scored, thresholds, text_col, prob_col, rules).withColumnRenamed("_stage", BAND_COL)


def _staged(scored: DataFrame, staged: bool, thresholds, text_col, prob_col, rules=C.RULE_PATTERNS) -> DataFrame:
    if staged:
        return scored.withColumnRenamed(BAND_COL, "_stage")
    return assign_stage(scored, thresholds, text_col, prob_col, rules)


def route(scored: DataFrame, thresholds: C.RoutingThresholds = C.RoutingThresholds(),
          replies: DataFrame | None = None, enrichment: DataFrame | None = None,
          summary_only: bool = False, id_col: str = "id", text_col: str = "text",
          prob_col: str = "prob", label_col: str = "label", urgency_col: str | None = "urgency",
          rules=C.RULE_PATTERNS, queue_map: dict[str, str] | None = None,
          with_metadata: bool = False, staged: bool = False) -> DataFrame:
    """Route a scored table (``id, text, label, prob[, urgency]``).

    ``replies``: ``(id, reply)`` classification replies for the low band (null reply =
    failed call).  Without it every low-band row takes the failure path (human).
    ``enrichment``: ``(id, summary, resolution[, resolution_error])`` for middle-band rows; with
    ``summary_only`` only the summary is used.  Of several rows with one id one is taken.  ``staged``: the input comes from
    ``stage_table`` (band and rule match stored; ``thresholds`` and ``rules`` unused).
    """
    urgency = F.coalesce(F.col(urgency_col), F.lit("")) if urgency_col else F.lit("")
    base = _staged(scored, staged, thresholds, text_col, prob_col, rules).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(prob_col).alias("prob"),
        F.col(label_col).alias("label"), urgency.alias("urgency"), "_rule", "_stage")

    null_s = F.lit(None).cast("string")
    special = []
    if replies is not None:
        special.append(_LOW_BAND)
    if enrichment is not None:
        special.append(_MIDDLE)
    plain = base.filter(~F.col("_stage").isin(*special)) if special else base
    parts = [plain.select("*", null_s.alias("reply"), null_s.alias("summary"), null_s.alias("resolution"),
                          null_s.alias("resolution_error"))]
    if replies is not None:
        band = base.filter(F.col("_stage") == _LOW_BAND).join(
            _one_per_id(replies, id_col, ["reply"]), "id", "left")
        parts.append(band.select("*", null_s.alias("summary"), null_s.alias("resolution"), null_s.alias("resolution_error")))
    if enrichment is not None:
        mid = base.filter(F.col("_stage") == _MIDDLE).join(
            _one_per_id(enrichment, id_col, ["summary", "resolution", "resolution_error"]), "id", "left")
        parts.append(mid.select(*base.columns, null_s.alias("reply"), "summary", "resolution", "resolution_error"))
    both = reduce(lambda a, b: a.unionByName(b), parts)
    return _finalize(both, enrich=enrichment is not None, summary_only=summary_only, queue_map=queue_map,
                     with_metadata=with_metadata)


def _one_per_id(table: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """One row per id, so that a repeated reply row cannot multiply a ticket: the least by the
    columns' values, real replies before nulls.  A column the table lacks is null."""
    cols = [(F.col(c) if c in table.columns else F.lit(None).cast("string")).alias(c) for c in columns]
    rows = table.select(F.col(id_col).alias("id"), *cols)
    least = F.min(F.struct(*(x for c in columns for x in (F.col(c).isNull().alias(f"_{c}"), F.col(c)))))
    return rows.groupBy("id").agg(least.alias("_one")).select("id", *(F.col(f"_one.{c}").alias(c) for c in columns))


def _finalize(df: DataFrame, enrich: bool, summary_only: bool, queue_map, with_metadata: bool = False) -> DataFrame:
    stage, prob, label, urg = F.col("_stage"), F.col("prob"), F.col("label"), F.col("urgency")
    v = RP.parse_reply(F.col("reply"))
    df = df.withColumn("_v", v)
    v = F.col("_v")
    ok = v.isNotNull()
    llm_issue = RP.reply_field(v, "issue_type", "other")
    llm_urg = RP.reply_field(v, "urgency", urg)

    is_rule, is_ml = stage == C.STAGE_RULE, stage == C.STAGE_ML
    is_band, is_mid = stage == _LOW_BAND, stage == _MIDDLE
    human = F.lit(C.HUMAN_QUEUE)

    route_c = (
        F.when(is_rule, LK.urgency_suffix(F.col("_rule.queue"), urg))
        .when(is_ml, LK.urgency_suffix(LK.queue_for(label, queue_map), urg))
        .when(is_band & ok, LK.urgency_suffix(LK.queue_for(llm_issue, queue_map), llm_urg))
        .otherwise(human)
    )
    stage_c = (
        F.when(is_rule, F.lit(C.STAGE_RULE)).when(is_ml, F.lit(C.STAGE_ML))
        .when(is_band & ok, F.lit(C.STAGE_LLM)).otherwise(F.lit(C.STAGE_HUMAN))
    )
    conf_c = F.when(is_rule, F.lit(C.RULE_CONFIDENCE)).otherwise(prob)
    issue_c = (
        F.when(is_rule, F.col("_rule.issue_type")).when(is_ml, F.lit(""))
        .when(is_band, F.when(ok, llm_issue).otherwise(F.lit(""))).otherwise(label)
    )
    urg_c = F.when(is_band & ok, llm_urg).otherwise(urg)

    empty = F.lit("")
    summary_c = F.when(is_mid, F.coalesce(F.col("summary"), empty)).otherwise(empty) if enrich else empty
    if enrich and not summary_only:
        r = RP.parse_reply(F.col("resolution"))
        rok = r.isNotNull()
        path_c = F.when(is_mid, F.when(rok, RP.reply_text_field(r, "suggested_path"))
                        .otherwise(F.lit(C.RESOLUTION_FAILURE_PATH))).otherwise(empty)
        esc_c = F.when(is_mid, F.when(rok, RP.reply_text_field(r, "should_escalate"))
                       .otherwise(F.lit("True"))).otherwise(empty)
        reason_c = F.when(is_mid, F.when(rok, RP.reply_text_field(r, "reason"))
                          .otherwise(F.coalesce("resolution_error", F.lit(UNPARSEABLE_REASON)))).otherwise(empty)
    else:
        path_c = esc_c = reason_c = empty

    cols = [
        "id", "text", route_c.alias("route"), stage_c.alias("stage"), conf_c.alias("confidence"),
        issue_c.alias("llm_issue_type"), urg_c.alias("llm_urgency"), summary_c.alias("llm_summary"),
        path_c.alias("suggested_path"), esc_c.alias("should_escalate"), reason_c.alias("reason"),
    ]
    if with_metadata:
        cols.append(_metadata(is_rule, is_ml, is_band, ok, v, label, urg, summary_c, path_c, esc_c, reason_c,
                              enrich and not summary_only, enrich).alias("metadata"))
    return df.select(*cols)


def _metadata(is_rule, is_ml, is_band, ok, v, label, urg, summary, path, esc, reason, with_resolution,
              with_summary) -> Column:
    """The single-ticket decision metadata: rule → issue, urgency, rule marker; ML → issue,
    urgency; LLM → the whole reply; LLM failure → issue, urgency, ``llm_unavailable``;
    human → issue, urgency (+ enrichment fields when enabled)."""
    def m(*kv):
        return F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])

    human = m("issue_type", label, "urgency", urg)
    if with_summary:
        human = F.map_concat(human, m("llm_summary", summary))
    if with_resolution:
        human = F.map_concat(human, m("suggested_path", path, "should_escalate", esc, "reason", reason))
    return (
        F.when(is_rule, m("issue_type", F.col("_rule.issue_type"), "urgency", urg, "rule", "pattern_match"))
        .when(is_ml, m("issue_type", label, "urgency", urg))
        .when(is_band & ok, F.try_variant_get(v, "$", "map<string,string>"))
        .when(is_band, m("issue_type", label, "urgency", urg, "reason", "llm_unavailable"))
        .otherwise(human)
    )


def route_one(spark, text: str, label: str, prob: float, urgency: str = "", reply: str | None = None,
              thresholds: C.RoutingThresholds = C.RoutingThresholds(), call_model: bool = True,
              rules=C.RULE_PATTERNS, queue_map: dict[str, str] | None = None) -> dict:
    """Single-ticket form of the cascade, returned as a dict (``route, stage, confidence, metadata``).  ``reply`` is
    the classification reply the low band would receive (None = the call failed or no client).

    The expressions are those of the batch cascade, over literals on a one-row relation: the optimiser folds them into that
    row, so the answer comes from planning alone and no Spark job runs.
    """
    one = spark.sql("SELECT * FROM VALUES (CAST(0 AS BIGINT)) AS t(id)")
    null_s = F.lit(None).cast("string")
    row = one.select("id", F.lit(text).cast("string").alias("text"), F.lit(float(prob)).alias("prob"), F.lit(label).cast("string").alias("label"),
                     F.lit(urgency or "").alias("urgency"), LK.rule_match(F.lower(F.lit(text).cast("string")), rules).alias("_rule"))
    row = row.withColumn("_stage", _stage_of(F.col("prob"), thresholds))
    row = row.select("*", F.lit(reply if call_model else None).cast("string").alias("reply"),
                     *(null_s.alias(c) for c in ("summary", "resolution", "resolution_error")))
    out, = _finalize(row, enrich=False, summary_only=False, queue_map=queue_map, with_metadata=True).collect()
    return {"route": out["route"], "stage": out["stage"], "confidence": out["confidence"],
            "metadata": dict(out["metadata"] or {})}


def low_band(scored: DataFrame, thresholds: C.RoutingThresholds = C.RoutingThresholds(),
             text_col: str = "text", prob_col: str = "prob", staged: bool = False) -> DataFrame:
    """Rows whose route needs a classification reply (no rule hit, ``prob <= low``, not ``>= high``)."""
    return _staged(scored, staged, thresholds, text_col, prob_col).filter(F.col("_stage") == _LOW_BAND) \
        .drop("_rule", "_stage")


def middle_band(scored: DataFrame, thresholds: C.RoutingThresholds = C.RoutingThresholds(),
                text_col: str = "text", prob_col: str = "prob", staged: bool = False) -> DataFrame:
    """Rows that fall to human triage by confidence (candidates for enrichment)."""
    return _staged(scored, staged, thresholds, text_col, prob_col).filter(F.col("_stage") == _MIDDLE) \
        .drop("_rule", "_stage")


def urgency_suffix_routes(scored: DataFrame, label_col: str = "label", urgency_col: str = "urgency") -> DataFrame:
    """Queue of each row's label with the ``_priority`` suffix for high / critical urgency."""
    return scored.select("id", LK.urgency_suffix(LK.queue_for(F.col(label_col)), F.col(urgency_col)).alias("route"))

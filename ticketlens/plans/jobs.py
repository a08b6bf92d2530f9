"""End-to-end jobs: triage run, supervised benchmark, eval-set build.

Each job is a sequence of DataFrame stages with explicit materialisation points
(tables in the output folder), where a result is reused or where recomputation
would repeat paid model calls:

1. labeled table (training and scoring both read it);
2. scored table (routing, KPIs and the sweep all read it);
3. model replies (paid; committed to a ledger in units, then joined: a job that is started again pays only for
   calls that no committed unit holds).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from .. import schemas as SC
from ..functions import text as TX
from ..functions import lookup as LK
from ..operators import evalset as ES
from ..operators import evaluation as EV
from ..operators import kpis as KP
from ..operators import labels as LB
from ..operators import ml as ML
from ..operators import model_calls as MC
from ..operators import policy as PO
from ..operators import routing as RT
from ..operators import sampling as SM
from ..operators import unify as UN
from ..session import shared_path
from ..sources import readers as RD
from ..sources import sinks as SK


def score(df: DataFrame, issue_model: ML.TextClassifier, urgency_model: ML.TextClassifier | None = None,
          id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(id, text, label, prob, urgency)``: one batched pass per model (``urgency`` is ''
    without an urgency model); models of the same terms share them."""
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if urgency_model is not None and ML.same_terms(issue_model, urgency_model):
        return ML.transform_both(base, issue_model, urgency_model).select(
            "id", "text", F.col("prediction").alias("label"), F.col("confidence").alias("prob"), F.col("prediction_b").alias("urgency"))
    s = issue_model.transform(base).select("id", "text", F.col("prediction").alias("label"),
                                           F.col("confidence").alias("prob"))
    if urgency_model is None:
        return s.withColumn("urgency", F.lit(""))
    u = urgency_model.transform(s).select(*s.columns, F.col("prediction").alias("urgency"))
    return u


@dataclass
class TriageConfig:
    thresholds: C.RoutingThresholds = field(default_factory=C.RoutingThresholds)
    weights: C.SweepWeights = field(default_factory=C.SweepWeights)
    enrich_human: bool = False
    summarize_human: bool = False
    sample_cap: int | None = None          # None: route the whole table
    label_targets: tuple[str, ...] = ("issue_type", "urgency", "complexity")
    call_partitions: int | None = None     # bound on concurrent model callers
    unit_calls: int = MC.UNIT_CALLS        # calls committed together: as many can be paid twice at most
    with_cv: bool = True
    fit_rows: int | None = ML.MAX_FIT_ROWS  # labelled rows that fit a model (None: all); scoring covers all
    max_iter: int = 300
    folds: int = 5


def run_triage(spark: SparkSession, social: DataFrame, tickets: DataFrame, out: str,
               client_factory: MC.ClientFactory | None = None, eval_rows: DataFrame | None = None,
               cfg: TriageConfig = TriageConfig(), ticket_aliases: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Load → unify → label → train → evaluate → score → route → KPIs → sweep → recommend."""
    out = out.rstrip("/")
    RD.require_rows(social, "social message input")
    RD.require_rows(tickets, "structured ticket input")
    unified = UN.unify_sources(social, tickets, aliases=ticket_aliases)
    labeled = SK.materialize(spark, LB.add_weak_labels(unified), f"{out}/labeled", ["label_quality"])
    results: dict[str, DataFrame] = {"labeled": labeled, "label_composition": LB.label_composition(labeled)}

    report: list[tuple[str, str, str]] = []
    models: dict[str, ML.TextClassifier] = {}
    trained = ML.train_text_models(labeled, list(cfg.label_targets), with_cv=cfg.with_cv, max_iter=cfg.max_iter, folds=cfg.folds,
                                   max_rows=cfg.fit_rows)
    for target, tr in trained.items():
        models[target] = tr.model
        SK.save_classifier(tr.model, f"{out}/models/{target}")
        report.append((target, "held_out_accuracy", f"{tr.accuracy:.4f}"))
        if tr.cv is not None:
            cv = tr.cv.first()
            report.append((target, "cv_mean", f"{cv['cv_mean']:.4f}"))
            report.append((target, "cv_std", f"{cv['cv_std']:.4f}"))
        SK.write_small(tr.report, f"{out}/reports/per_class_{target}")
        if target == "complexity":
            report.append((target, "note", "labels follow the word count of the text: the scores measure how well it is recovered"))
        for row in tr.report.collect():        # a row per label
            for metric in ("precision", "recall", "f1_score", "support"):
                report.append((target, f"{row['label']}: {metric}", f"{row[metric]:.4f}"))
    for row in results["label_composition"].collect():
        report.append(("label_composition", str(row["label_quality"]), f"{row['count']} rows, {row['pct']:.1f}%"))

    eval_paths = [f"{out}/eval_comparison", f"{out}/eval_per_class_metrics", f"{out}/eval_confusion_matrix"]
    if eval_rows is not None:
        ev = eval_rows.select("id", TX.normalize_text("text").alias("text"), "issue_type")
        ml_pred = models["issue_type"].transform(ev).select(
            "id", F.lit("ml_tfidf_lr").alias("model"), F.col("issue_type").alias("y"), F.col("prediction").alias("p"))
        kw_pred = EV.keyword_predictions(ev, "text", "issue_type")
        pred = SK.materialize(spark, ml_pred.unionByName(kw_pred), f"{out}/eval_predictions")
        summary = EV.f1_summary(pred)
        results["eval_comparison"] = EV.lift(summary)
        results["eval_per_class_metrics"] = EV.per_class(pred)
        results["eval_confusion_matrix"] = EV.confusion_long(pred)
        for name, path in zip(("eval_comparison", "eval_per_class_metrics", "eval_confusion_matrix"), eval_paths):
            SK.write_small(results[name], path)
        for name, value in results["eval_comparison"].first().asDict().items():
            report.append(("eval_set", name, f"{value:.4f}" if isinstance(value, float) else str(value)))
    else:
        for schema, path in zip((SC.EVAL_COMPARISON, SC.PER_CLASS, SC.CONFUSION), eval_paths):
            SK.overwrite_empty(spark, schema, path)

    to_route = labeled if cfg.sample_cap is None else SM.hash_sample(labeled, cfg.sample_cap)
    # Written with its band as the partition column: the branches below read only theirs.
    scored = SK.materialize(spark, RT.stage_table(score(to_route, models["issue_type"], models.get("urgency")),
                                                  cfg.thresholds), f"{out}/scored", [RT.BAND_COL])

    replies = enrichment = None
    if client_factory is not None:
        band = RT.low_band(scored, staged=True)
        replies = SK.materialize(spark, MC.classify_replies(band, client_factory, partitions=cfg.call_partitions,
                                                                    ledger=f"{out}/model_replies/ledger", unit_calls=cfg.unit_calls),
                                 f"{out}/model_replies/classify")
        if cfg.enrich_human or cfg.summarize_human:
            middle = RT.middle_band(scored, staged=True)
            enrichment = SK.materialize(
                spark, MC.enrichment_replies(middle, client_factory, partitions=cfg.call_partitions,
                                             summary_only=not cfg.enrich_human, ledger=f"{out}/model_replies/ledger",
                                             unit_calls=cfg.unit_calls),
                f"{out}/model_replies/enrich")
    routed = SK.materialize(
        spark, RT.route(scored, cfg.thresholds, replies=replies, enrichment=enrichment,
                        summary_only=cfg.summarize_human and not cfg.enrich_human, staged=True),
        f"{out}/routed", ["stage"])
    results["routed"] = routed
    results["routing_metrics"] = KP.routing_kpis(routed)
    results["queue_share"] = KP.queue_share(routed)
    results["threshold_sweep"] = PO.threshold_sweep(scored, weights=cfg.weights)
    results["policy_recommendation"] = PO.recommend(results["threshold_sweep"], cfg.thresholds)
    for name in ("label_composition", "routing_metrics", "queue_share", "threshold_sweep", "policy_recommendation"):
        SK.write_small(results[name], f"{out}/{name}")
    SK.write_report(spark, report, f"{out}/training_report")
    return results


# ----------------------------------------------------------------------------- benchmark

def benchmark_candidates(tickets: DataFrame, subject: str = "subject", description: str = "description",
                         type_col: str = "type", id_col: str = "id") -> DataFrame:
    """Clean text and benchmark type map; unmapped and short (< 20 chars) rows dropped."""
    text = F.concat(TX.strip_ws(F.coalesce(F.col(subject), F.lit(""))), F.lit(" "),
                    TX.clean_placeholders(F.coalesce(F.col(description), F.lit(""))))
    issue = LK.map_lookup(TX.canon_key(F.coalesce(F.col(type_col), F.lit(""))), C.BENCHMARK_TYPE_MAP)
    d = tickets.select(F.col(id_col).alias("id"), TX.evaluated_once(text).alias("text"), issue.alias("issue_type"))
    return d.filter(F.col("issue_type").isNotNull() & (F.length("text") >= C.BENCHMARK_MIN_TEXT_LEN))


def benchmark_rows(tickets: DataFrame, subject: str = "subject", description: str = "description",
                   type_col: str = "type", id_col: str = "id", observation=None) -> DataFrame:
    """Benchmark candidates, keep-first dedup on text, then whitespace strip."""
    d = benchmark_candidates(tickets, subject, description, type_col, id_col)
    if observation is not None:
        d = d.observe(observation[0], F.count(F.lit(1)).alias("before_dedup"))
    d = SM.dedup_keep_first(d, "text")
    if observation is not None:
        d = d.observe(observation[1], F.count(F.lit(1)).alias("after_dedup"))
    return d.withColumn("text", TX.strip_ws("text"))


def dedup_dropped(observation) -> int:
    """Rows removed by the benchmark dedup, read from the two observations after an action
    (collected alongside the job's own work; no extra pass)."""
    return int(observation[0].get["before_dedup"]) - int(observation[1].get["after_dedup"])


def run_benchmark(spark: SparkSession, tickets: DataFrame, out: str | None = None,
                  seed: int = C.SEED, **cols) -> dict[str, DataFrame]:
    """Keyword baseline, TF-IDF baseline and the improved model on a stratified 80/20 split."""
    at = out.rstrip("/") if out else shared_path(spark, "benchmark", uuid.uuid4().hex)
    rows = SK.materialize(spark, benchmark_rows(tickets, **cols), f"{at}/benchmark_rows")      # the split reads them three times
    split = SM.stratified_split(rows, "issue_type", "id", seed)
    split = SK.materialize(spark, split, f"{at}/benchmark_split")
    train = split.filter(F.col("split") == "train").drop("split")
    test = split.filter(F.col("split") == "test").drop("split")
    n_train = train.count()

    kw = test.select("id", F.lit("keyword_baseline").alias("model"), F.col("issue_type").alias("y"),
                     TX.keyword_issue_bench("text").alias("p"))
    base = ML.fit_baseline(train, "issue_type")
    improved = ML.fit_improved(train, "issue_type")

    def preds(clf, name):
        return clf.transform(test).select("id", F.lit(name).alias("model"), F.col("issue_type").alias("y"),
                                          F.col("prediction").alias("p"))

    pred = kw.unionByName(preds(base, "ml_baseline")).unionByName(preds(improved, "ml_improved"))
    pred = SK.materialize(spark, pred, f"{at}/benchmark_predictions")
    summary = EV.benchmark_summary(EV.f1_summary(pred), {"ml_baseline": n_train, "ml_improved": n_train})
    per_class = EV.per_class_restricted(pred)
    confusion = EV.confusion_restricted(pred)
    compat_pc = per_class.filter(F.col("model").isin("ml_improved", "keyword_baseline")).withColumn(
        "model", F.when(F.col("model") == "ml_improved", F.lit("ml_tfidf_lr")).otherwise(F.col("model")))
    res = {"benchmark_summary": summary, "benchmark_per_class": per_class, "benchmark_confusion": confusion,
           "eval_per_class_metrics": compat_pc, "eval_comparison": benchmark_compat_row(summary)}
    if out:
        for k, v in res.items():
            SK.write_small(v, f"{out.rstrip('/')}/{k}")
    return res


# ----------------------------------------------------------------------------- eval set

def build_eval_set(spark: SparkSession, base: DataFrame, tickets: DataFrame, out: str | None = None) -> dict[str, DataFrame]:
    """Merge a base set with labelled ticket candidates; write to a *new* path (a lazily
    read input is never overwritten in place)."""
    merged = ES.merge_eval_set(ES.tag_base(base), ES.candidate_rows(tickets))
    if out:
        merged = SK.materialize(spark, merged, f"{out.rstrip('/')}/eval_set")
    summary = ES.eval_summary(merged)
    if out:
        SK.write_small(summary, f"{out.rstrip('/')}/eval_set_summary")
    return {"eval_set": merged, "eval_summary": summary}


def benchmark_compat_row(summary: DataFrame, model: str = "ml_improved", baseline: str = "keyword_baseline") -> DataFrame:
    """The benchmark summary re-projected into the eval-comparison schema (one row)."""
    def pick(name, c):
        return F.max(F.when(F.col("model_name") == name, F.col(c)))

    return summary.agg(
        pick(model, "accuracy").alias("ml_accuracy"), pick(model, "macro_f1").alias("ml_macro_f1"),
        pick(model, "weighted_f1").alias("ml_weighted_f1"),
        pick(baseline, "accuracy").alias("keyword_baseline_accuracy"),
        pick(baseline, "macro_f1").alias("keyword_macro_f1"), pick(baseline, "weighted_f1").alias("keyword_weighted_f1"),
        pick(model, "n_test").alias("n_eval_samples"),
    ).select("*", F.lit("metadata_ticket_type").alias("label_source"),
             F.lit("structured support tickets").alias("dataset_source"),
             F.lit("measured_holdout_metadata_labels").alias("metric_type"))


# ----------------------------------------------------------------------------- local run

def local_training_frame(eval_rows: DataFrame) -> DataFrame:
    """Training rows from a labeled eval set: normalised text, complexity, real labels."""
    t = TX.normalize_text("text")
    return eval_rows.select("id", t.alias("text"), "issue_type", "urgency").withColumns({
        "complexity": TX.complexity("text"), "label_quality": F.lit("real")})


def run_local(spark: SparkSession, eval_rows: DataFrame, out: str, cfg: TriageConfig | None = None,
              client_factory: MC.ClientFactory | None = None) -> dict[str, DataFrame]:
    """Train issue and urgency models on the eval set itself, then score, route (with the
    client or, without one, through the failure path), KPIs, sweep and recommendation."""
    cfg = cfg or TriageConfig(label_targets=("issue_type", "urgency"))
    out = out.rstrip("/")
    frame = SK.materialize(spark, local_training_frame(eval_rows), f"{out}/local_labeled")
    trained = ML.train_text_models(frame, list(cfg.label_targets), with_cv=cfg.with_cv, max_iter=cfg.max_iter, folds=cfg.folds,
                                   max_rows=cfg.fit_rows)
    models = {t: r.model for t, r in trained.items()}
    scored = SK.materialize(spark, RT.stage_table(score(frame, models["issue_type"], models.get("urgency")),
                                                  cfg.thresholds), f"{out}/local_scored", [RT.BAND_COL])
    replies = None
    if client_factory is not None:
        replies = SK.materialize(spark, MC.classify_replies(RT.low_band(scored, staged=True), client_factory, partitions=cfg.call_partitions,
                                                                    ledger=f"{out}/local_ledger", unit_calls=cfg.unit_calls),
                                 f"{out}/local_replies")
    routed = SK.materialize(spark, RT.route(scored, cfg.thresholds, replies=replies, staged=True),
                            f"{out}/local_routed")
    sweep = PO.threshold_sweep(scored, weights=cfg.weights)
    res = {"routed": routed, "routing_metrics": KP.routing_kpis(routed), "threshold_sweep": sweep,
           "policy_recommendation": PO.recommend(sweep, cfg.thresholds),
           "stage_counts": routed.groupBy("stage").count(), "issue_counts": frame.groupBy("issue_type").count()}
    for k in ("routing_metrics", "threshold_sweep", "policy_recommendation"):
        SK.write_small(res[k], f"{out}/local_{k}")
    return res

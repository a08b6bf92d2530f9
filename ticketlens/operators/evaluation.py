"""Classifier evaluation from a predictions table ``(model, y, p)``.

The raw rows are read once: ``groupBy(model, y, p).count()`` is partial-aggregated
per task, so at most (#models × #labels²) rows are shuffled.  Everything after
that — per-class metrics, F1 averages, zero-filled confusion grids, lifts —
runs on that small count table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


PER_CLASS_COLUMNS = ("model", "label", "precision", "recall", "f1_score", "support")
SUMMARY_COLUMNS = ("model", "n_eval_samples", "accuracy", "macro_f1", "weighted_f1")


def confusion_counts(pred: DataFrame, model: str = "model", y: str = "y", p: str = "p") -> DataFrame:
    return pred.groupBy(F.col(model).alias("model"), F.col(y).alias("actual_label"),
                        F.col(p).alias("predicted_label")).agg(F.count(F.lit(1)).alias("count"))


def _grid(cnt: DataFrame, true_only: bool) -> DataFrame:
    """Dense (actual, predicted) grid over the model's labels with zero-filled counts: a model's labels, one list of
    them, are paired, and the pairs left-joined to the counts (a null label is a label of its own)."""
    cnt = cnt.where("count > 0")      # always true; keeps the counts in both branches, which then share one exchange
    ys = F.collect_set(F.struct(F.col("actual_label").alias("l")))
    labels = ys if true_only else F.array_union(ys, F.collect_set(F.struct(F.col("predicted_label").alias("l"))))
    pairs = (cnt.groupBy("model").agg(labels.alias("labels"))
             .select("model", "labels", F.inline("labels").alias("actual_label"))
             .select("model", "actual_label", F.inline("labels").alias("predicted_label")))
    of = cnt.select(F.col("model").alias("_m"), F.col("actual_label").alias("_a"), F.col("predicted_label").alias("_p"), "count")
    same = F.col("model").eqNullSafe(F.col("_m")) & F.col("actual_label").eqNullSafe(F.col("_a")) \
        & F.col("predicted_label").eqNullSafe(F.col("_p"))
    return pairs.join(of, same, "left").select("model", "actual_label", "predicted_label",
                                               F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def confusion_long(pred: DataFrame, true_only: bool = False, **cols) -> DataFrame:
    """Zero-filled long confusion matrix over true ∪ predicted labels (or true labels
    only, in which case predictions outside them are dropped).  One pass over the rows."""
    return _grid(confusion_counts(pred, **cols), true_only)


def confusion_restricted(pred: DataFrame, **cols) -> DataFrame:
    """Benchmark form: true classes only, columns ``model, true, predicted, count``."""
    cm = confusion_long(pred, true_only=True, **cols)
    return cm.select("model", F.col("actual_label").alias("true"), F.col("predicted_label").alias("predicted"), "count")


def confusion_wide(cm_long: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Rows actual label, one column per predicted label, missing cells 0."""
    piv = cm_long.groupBy("model", "actual_label").pivot("predicted_label", labels).agg(F.sum("count"))
    value_cols = [c for c in piv.columns if c not in ("model", "actual_label")]
    return piv.na.fill(0, subset=value_cols)


def _class_stats(cnt: DataFrame) -> DataFrame:
    """tp / support / predicted counts per (model, label) from the count table, one aggregation."""
    y, p, n = F.col("actual_label"), F.col("predicted_label"), F.col("count")
    zero = F.lit(0).cast("long")
    rows = F.array(
        F.struct(y.alias("label"), F.when(y == p, n).otherwise(zero).alias("tp"), n.alias("sup"), zero.alias("pr")),
        F.struct(p.alias("label"), zero.alias("tp"), zero.alias("sup"), n.alias("pr")),
    )
    e = cnt.select("model", F.inline(rows))
    return e.groupBy("model", "label").agg(F.sum("tp").alias("tp"), F.sum("sup").alias("sup"),
                                           F.sum("pr").alias("pr"))


def _metrics(stats: DataFrame) -> DataFrame:
    tp, sup, pr = (F.col(c).cast("double") for c in ("tp", "sup", "pr"))
    return stats.select(
        "model", "label",
        F.when(pr > 0, tp / pr).otherwise(F.lit(0.0)).alias("precision"),
        F.when(sup > 0, tp / sup).otherwise(F.lit(0.0)).alias("recall"),
        F.when(sup + pr > 0, 2.0 * tp / (sup + pr)).otherwise(F.lit(0.0)).alias("f1_score"),
        sup.alias("support"),
    )


def per_class(pred: DataFrame, with_averages: bool = True, **cols) -> DataFrame:
    """Precision / recall / F1 / support per label over true ∪ predicted labels
    (zero division → 0), plus the ``macro avg`` and ``weighted avg`` rows — all from
    one pass over the predictions (the per-model rows are few: one per label)."""
    m = _metrics(_class_stats(confusion_counts(pred, **cols)))
    if not with_averages:
        return m
    s = F.sum("support")
    per_model = m.groupBy("model").agg(
        F.collect_list(F.struct("label", "precision", "recall", "f1_score", "support")).alias("rows"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"), s.alias("n"),
        (F.sum(F.col("precision") * F.col("support")) / s).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / s).alias("wr"),
        (F.sum(F.col("f1_score") * F.col("support")) / s).alias("wf"),
    )
    avg_rows = F.array(
        F.struct(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1_score"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                 F.col("wf").alias("f1_score"), F.col("n").alias("support")),
    )
    return per_model.select("model", F.inline(F.concat("rows", avg_rows)))


def per_class_restricted(pred: DataFrame, **cols) -> DataFrame:
    """Per-class rows for the true classes only (no average rows)."""
    cnt = confusion_counts(pred, **cols)
    m = _metrics(_class_stats(cnt))
    true_labels = cnt.select("model", F.col("actual_label").alias("label")).distinct()
    return m.join(true_labels, ["model", "label"], "left_semi")


def f1_summary(pred: DataFrame, **cols) -> DataFrame:
    """Accuracy, macro-F1 (over true ∪ predicted labels) and weighted-F1 per model."""
    m = _class_stats(confusion_counts(pred, **cols))
    f1 = F.when(F.col("sup") + F.col("pr") > 0, 2.0 * F.col("tp") / (F.col("sup") + F.col("pr"))).otherwise(0.0)
    return m.groupBy("model").agg(
        F.sum("sup").alias("n_eval_samples"),
        (F.sum("tp") / F.sum("sup")).alias("accuracy"),
        F.avg(f1).alias("macro_f1"),
        (F.sum(f1 * F.col("sup")) / F.sum("sup")).alias("weighted_f1"),
    )


def lift(summary: DataFrame, ml_model: str = "ml_tfidf_lr", baseline: str = "keyword_baseline") -> DataFrame:
    """One comparison row: model vs keyword baseline and their differences."""
    def pick(model, c):
        return F.max(F.when(F.col("model") == model, F.col(c)))

    row = summary.agg(
        pick(ml_model, "n_eval_samples").alias("n_eval_samples"),
        pick(ml_model, "accuracy").alias("ml_accuracy"), pick(baseline, "accuracy").alias("keyword_baseline_accuracy"),
        pick(ml_model, "macro_f1").alias("ml_macro_f1"), pick(baseline, "macro_f1").alias("keyword_macro_f1"),
        pick(ml_model, "weighted_f1").alias("ml_weighted_f1"), pick(baseline, "weighted_f1").alias("keyword_weighted_f1"),
    )
    return row.select(
        F.lit("measured_eval_set").alias("metric_type"), "n_eval_samples",
        "ml_accuracy", "keyword_baseline_accuracy",
        (F.col("ml_accuracy") - F.col("keyword_baseline_accuracy")).alias("ml_accuracy_lift"),
        "ml_macro_f1", "keyword_macro_f1", (F.col("ml_macro_f1") - F.col("keyword_macro_f1")).alias("ml_macro_f1_lift"),
        "ml_weighted_f1", "keyword_weighted_f1",
        (F.col("ml_weighted_f1") - F.col("keyword_weighted_f1")).alias("ml_weighted_f1_lift"),
    )


def benchmark_summary(summary: DataFrame, n_train: dict[str, int] | None = None) -> DataFrame:
    """Benchmark comparison rows with provenance columns."""
    n_train = n_train or {}
    nt = F.lit(0).cast("long")
    for name, n in n_train.items():
        nt = F.when(F.col("model") == name, F.lit(int(n)).cast("long")).otherwise(nt)
    return summary.select(
        F.col("model").alias("model_name"), "accuracy", "macro_f1", "weighted_f1", nt.alias("n_train"),
        F.col("n_eval_samples").alias("n_test"),
        F.lit("measured_holdout_metadata_labels").alias("metric_type"),
        F.lit("metadata_ticket_type").alias("label_source"),
        F.lit("structured support tickets").alias("dataset_source"),
    )


def keyword_predictions(df: DataFrame, text_col: str, label_col: str, model: str = "keyword_baseline",
                        keyword_fn=None) -> DataFrame:
    """Predictions of a keyword classifier in ``(id, model, y, p)`` form."""
    from ..functions import text as TX

    fn = keyword_fn or TX.keyword_issue
    return df.select("id", F.lit(model).alias("model"), F.col(label_col).alias("y"), fn(F.col(text_col)).alias("p"))


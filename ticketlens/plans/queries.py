"""Registered queries: one per operator group, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (through the fixture views derived from
them) in full.  Double-valued metrics are rounded to 6 digits so that results
can be compared with an independent SQL engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import lookup as LK
from ..functions import text as TX
from ..operators import evalset as ES
from ..operators import evaluation as EV
from ..operators import kpis as KP
from ..operators import labels as LB
from ..operators import policy as PO
from ..operators import reports as RP
from ..operators import routing as RT
from ..operators import sampling as SM
from ..operators import unify as UN
from ..sources import fixtures as FX

DIGITS = 6


def r6(df: DataFrame, *cols: str) -> DataFrame:
    """Round the named double columns (all doubles when none are named)."""
    names = cols or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(F.col(c), DIGITS) for c in names})


# ----------------------------------------------------------------------------- text functions

def q_normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = FX.read_table(spark, sf, "documents")
    return docs.select("doc_id", TX.normalize_text("text").alias("norm"))


def q_clean_placeholders(spark: SparkSession, sf: str) -> DataFrame:
    t = FX.tickets_raw(spark, sf)
    return t.select("id", TX.clean_placeholders("subject").alias("subject_clean"),
                    TX.clean_placeholders("description").alias("description_clean"))


def _social_norm(spark, sf):
    return FX.social_raw(spark, sf).select("id", TX.normalize_text("text").alias("text"))


def q_keyword_issue(spark: SparkSession, sf: str) -> DataFrame:
    return _social_norm(spark, sf).select("id", TX.keyword_issue("text").alias("issue_type"))


def q_keyword_issue_bench(spark: SparkSession, sf: str) -> DataFrame:
    t = FX.tickets_raw(spark, sf)
    text = TX.null_safe_concat(TX.strip_ws(F.col("subject")), TX.clean_placeholders(F.coalesce("description", F.lit(""))))
    return t.select("id", TX.keyword_issue_bench(text).alias("predicted"))


def q_keyword_urgency(spark: SparkSession, sf: str) -> DataFrame:
    return _social_norm(spark, sf).select("id", TX.keyword_urgency("text").alias("urgency"))


def q_complexity(spark: SparkSession, sf: str) -> DataFrame:
    s = _social_norm(spark, sf)
    return s.select("id", TX.word_count("text").cast("long").alias("n_words"), TX.complexity("text").alias("complexity"))


def q_rule_match(spark: SparkSession, sf: str) -> DataFrame:
    s = _social_norm(spark, sf)
    m = LK.rule_match(F.col("text"))
    return s.select("id", m["queue"].alias("rule_queue"), m["issue_type"].alias("rule_issue_type"))


def q_rule_match_table(spark: SparkSession, sf: str) -> DataFrame:
    s = _social_norm(spark, sf)
    out = LK.rule_match_table(s, "text", LK.rule_registry(spark))
    return out.select("id", "rule_queue", "rule_issue_type")


def q_rule_match_wide(spark: SparkSession, sf: str) -> DataFrame:
    """A registry that Spark derives from the tables (a pattern per part and per order), over
    tickets whose ids repeat: the plan and the answer per row do not depend on either."""
    t = FX.tickets_raw(spark, sf).select((F.col("id") % 7).alias("id"), F.lower("description").alias("text"))
    part = FX.read_table(spark, sf, "part").select((F.col("p_partkey") * 7 % 10007).alias("n"))
    order = FX.read_table(spark, sf, "orders").select((F.col("o_orderkey") * 3 + 100).alias("n"))
    rules = part.unionByName(order).distinct().select(
        F.col("n").cast("int").alias("ord"), F.concat(F.lit("ref "), F.col("n").cast("string")).alias("pattern"),
        F.concat(F.lit("queue_"), (F.col("n") % 11).cast("string")).alias("queue"),
        F.concat(F.lit("issue_"), (F.col("n") % 5).cast("string")).alias("issue_type"))
    return LK.rule_match_table(t, "text", rules).select("id", "text", "rule_queue", "rule_issue_type")


# ----------------------------------------------------------------------------- unify / labels

def q_inbound_filter(spark: SparkSession, sf: str) -> DataFrame:
    return UN.inbound_only(FX.social_raw(spark, sf))


def q_map_structured(spark: SparkSession, sf: str) -> DataFrame:
    return UN.map_structured(FX.tickets_raw(spark, sf), **UN.FIXTURE_TICKET_COLUMNS)


def q_unify(spark: SparkSession, sf: str) -> DataFrame:
    return FX.unified(spark, sf)


def q_weak_labels(spark: SparkSession, sf: str) -> DataFrame:
    return FX.labeled(spark, sf).select("id", "source", "text", "issue_type", "urgency", "complexity", "label_quality")


def q_label_composition(spark: SparkSession, sf: str) -> DataFrame:
    return r6(LB.label_composition(FX.labeled(spark, sf)))


# ----------------------------------------------------------------------------- routing

def q_route_offline(spark: SparkSession, sf: str) -> DataFrame:
    return r6(RT.route(FX.scored(spark, sf)))


def q_route_with_replies(spark: SparkSession, sf: str) -> DataFrame:
    return r6(RT.route(FX.scored(spark, sf), replies=FX.llm_replies(spark, sf)))


def q_route_staged(spark: SparkSession, sf: str) -> DataFrame:
    """The job's path: the scored table with its band stored, then the staged router."""
    staged = RT.stage_table(FX.scored(spark, sf))
    return r6(RT.route(staged, replies=FX.llm_replies(spark, sf), staged=True))


def q_urgency_suffix(spark: SparkSession, sf: str) -> DataFrame:
    return RT.urgency_suffix_routes(FX.scored(spark, sf))


def routed_with_replies(spark: SparkSession, sf: str) -> DataFrame:
    return RT.route(FX.scored(spark, sf), replies=FX.llm_replies(spark, sf))


def q_routing_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return r6(KP.routing_kpis(routed_with_replies(spark, sf)))


REPORT_PCT_COLUMNS = ("human_triage_rate", "llm_invocation_rate", "rule_based_rate", "ml_high_confidence_rate",
                      "human_fallback_rate")
REPORT_NUM_COLUMNS = ("avg_routing_confidence", "cost_per_ticket_usd_estimated")


def q_report_format(spark: SparkSession, sf: str) -> DataFrame:
    k = r6(KP.routing_kpis(routed_with_replies(spark, sf)))
    return RP.format_report(k, REPORT_PCT_COLUMNS, REPORT_NUM_COLUMNS, digits=4) \
        .select("tickets", *REPORT_PCT_COLUMNS, *REPORT_NUM_COLUMNS)


def q_queue_share(spark: SparkSession, sf: str) -> DataFrame:
    return r6(KP.queue_share(routed_with_replies(spark, sf)))


# ----------------------------------------------------------------------------- policy

def q_threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return r6(PO.threshold_sweep(FX.scored(spark, sf)))


def q_recommend_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return r6(PO.recommend(PO.threshold_sweep(FX.scored(spark, sf))))


# ----------------------------------------------------------------------------- evaluation

def q_confusion_long(spark: SparkSession, sf: str) -> DataFrame:
    return EV.confusion_long(FX.predictions(spark, sf))


def q_confusion_restricted(spark: SparkSession, sf: str) -> DataFrame:
    return EV.confusion_restricted(FX.predictions(spark, sf))


def q_confusion_wide(spark: SparkSession, sf: str) -> DataFrame:
    return EV.confusion_wide(EV.confusion_long(FX.predictions(spark, sf)), list(C.ISSUE_TYPES))


def q_per_class(spark: SparkSession, sf: str) -> DataFrame:
    return r6(EV.per_class(FX.predictions(spark, sf)))


def q_per_class_restricted(spark: SparkSession, sf: str) -> DataFrame:
    return r6(EV.per_class_restricted(FX.predictions(spark, sf)))


def q_f1_summary(spark: SparkSession, sf: str) -> DataFrame:
    return r6(EV.f1_summary(FX.predictions(spark, sf)))


def q_benchmark_summary_table(spark: SparkSession, sf: str) -> DataFrame:
    return r6(EV.benchmark_summary(EV.f1_summary(FX.predictions(spark, sf))))


def q_benchmark_compat(spark: SparkSession, sf: str) -> DataFrame:
    from . import jobs as JB

    summary = EV.benchmark_summary(EV.f1_summary(FX.predictions(spark, sf)))
    return r6(JB.benchmark_compat_row(summary, model="ml_tfidf_lr"))


def q_lift(spark: SparkSession, sf: str) -> DataFrame:
    return r6(EV.lift(EV.f1_summary(FX.predictions(spark, sf))))


# ----------------------------------------------------------------------------- sampling

def q_dedup_norm(spark: SparkSession, sf: str) -> DataFrame:
    s = _social_norm(spark, sf)
    return SM.dedup_keep_first(s, "text").select("id", F.col("text").alias("norm"))


def q_per_class_sample(spark: SparkSession, sf: str) -> DataFrame:
    lab = FX.labeled(spark, sf).select("id", "issue_type")
    return SM.per_class_sample(lab, "issue_type", C.EVAL_ROWS_PER_CLASS, "id", C.SEED)


def q_stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    lab = FX.labeled(spark, sf).select("id", "issue_type")
    return SM.stratified_split(lab, "issue_type", "id", C.SEED)


def q_kfold_assign(spark: SparkSession, sf: str) -> DataFrame:
    lab = FX.labeled(spark, sf).select("id", "issue_type")
    return SM.kfold_assign(lab, "issue_type", "id", 5, C.SEED)


def q_hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    lab = FX.labeled(spark, sf).select("id", "text")
    return SM.hash_sample(lab, C.ROUTING_SAMPLE_CAP, "id", C.SEED)


def q_hash_sample_small(spark: SparkSession, sf: str) -> DataFrame:
    """A cap that bites at every scale."""
    return SM.hash_sample(FX.labeled(spark, sf).select("id", "text"), 50, "id", C.SEED)


def _null_labels(spark, sf):
    lab = FX.labeled(spark, sf).select("id", "issue_type")
    return lab.withColumn("issue_type", F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("issue_type")))


def q_stratified_split_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the labels null: a label of their own, no row dropped."""
    return SM.stratified_split(_null_labels(spark, sf), "issue_type", "id", C.SEED)


def q_kfold_assign_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return SM.kfold_assign(_null_labels(spark, sf), "issue_type", "id", 5, C.SEED)


def q_confusion_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Null true and predicted labels are labels of their own in the grid."""
    pred = FX.predictions(spark, sf)
    return EV.confusion_long(pred.withColumns({
        "y": F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("y")),
        "p": F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("p"))}))


def q_route_nan(spark: SparkSession, sf: str) -> DataFrame:
    """A NaN probability meets no threshold: a human, not the top band."""
    s = FX.scored(spark, sf)
    s = s.withColumn("prob", F.when(F.col("id") % 4 == 1, F.lit(float("nan"))).otherwise(F.col("prob")))
    return RT.route(s).select("id", "route", "stage")


def q_route_repeated_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Reply rows that repeat: every ticket is still routed once."""
    replies = FX.llm_replies(spark, sf)
    return r6(RT.route(FX.scored(spark, sf), replies=replies.unionByName(replies)))


def q_positional_split(spark: SparkSession, sf: str) -> DataFrame:
    lab = FX.labeled(spark, sf).select("id")
    return SM.positional_split(lab, "id", C.SEED)


# ----------------------------------------------------------------------------- eval set

def _candidates(spark, sf):
    return ES.candidate_rows(FX.tickets_raw(spark, sf))


def _base(spark, sf):
    return ES.base_from_labeled(FX.labeled(spark, sf))


def q_anti_join_eval(spark: SparkSession, sf: str) -> DataFrame:
    return ES.new_candidates(_base(spark, sf), _candidates(spark, sf))


def q_eval_set(spark: SparkSession, sf: str) -> DataFrame:
    return ES.merge_eval_set(_base(spark, sf), _candidates(spark, sf))


def q_eval_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ES.eval_summary(ES.merge_eval_set(_base(spark, sf), _candidates(spark, sf)))


def q_eval_set_checks(spark: SparkSession, sf: str) -> DataFrame:
    return r6(ES.eval_set_checks(ES.merge_eval_set(_base(spark, sf), _candidates(spark, sf))))


def q_unmapped_count(spark: SparkSession, sf: str) -> DataFrame:
    return ES.unmapped_count(FX.tickets_raw(spark, sf))


# ----------------------------------------------------------------------------- reports

def routed_enriched(spark: SparkSession, sf: str) -> DataFrame:
    return RT.route(FX.scored(spark, sf), replies=FX.llm_replies(spark, sf),
                    enrichment=FX.llm_enrichment(spark, sf))


def q_route_enriched(spark: SparkSession, sf: str) -> DataFrame:
    return r6(routed_enriched(spark, sf))


def q_freq_tables(spark: SparkSession, sf: str) -> DataFrame:
    return RP.frequency_tables(routed_with_replies(spark, sf))


def q_confidence_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return RP.confidence_histogram(routed_with_replies(spark, sf))


def q_urgency_order(spark: SparkSession, sf: str) -> DataFrame:
    return RP.urgency_counts_ordered(routed_with_replies(spark, sf))


def q_stage_display(spark: SparkSession, sf: str) -> DataFrame:
    return RP.stage_display(routed_with_replies(spark, sf))


def q_rates_long(spark: SparkSession, sf: str) -> DataFrame:
    return r6(RP.rates_long(PO.threshold_sweep(FX.scored(spark, sf))))


def q_cost_curve(spark: SparkSession, sf: str) -> DataFrame:
    return r6(RP.cost_curve(PO.threshold_sweep(FX.scored(spark, sf))))


def q_f1_by_label_outer(spark: SparkSession, sf: str) -> DataFrame:
    return r6(RP.f1_by_label(EV.per_class(FX.predictions(spark, sf))))


def q_best_model(spark: SparkSession, sf: str) -> DataFrame:
    return r6(RP.best_model(EV.f1_summary(FX.predictions(spark, sf))))


def q_enriched_listing(spark: SparkSession, sf: str) -> DataFrame:
    return r6(RP.enriched_listing(routed_enriched(spark, sf)))


def q_queue_counts(spark: SparkSession, sf: str) -> DataFrame:
    return RP.queue_counts(routed_with_replies(spark, sf))


def q_local_training_frame(spark: SparkSession, sf: str) -> DataFrame:
    from . import jobs as JB

    return JB.local_training_frame(ES.merge_eval_set(_base(spark, sf), _candidates(spark, sf)))


def q_benchmark_rows(spark: SparkSession, sf: str) -> DataFrame:
    from . import jobs as JB

    return JB.benchmark_rows(FX.tickets_raw(spark, sf))


def q_benchmark_dedup_dropped(spark: SparkSession, sf: str) -> DataFrame:
    from . import jobs as JB

    return SM.dedup_dropped(JB.benchmark_candidates(FX.tickets_raw(spark, sf)), "text")


# ----------------------------------------------------------------------------- models (rows-only checks)

def q_char_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import ml as ML

    g = ML.char_wb_ngrams(F.col("text"))
    return FX.social_raw(spark, sf).select("id", F.size(g).cast("long").alias("n_ngrams"),
                                           F.size(F.array_distinct(g)).cast("long").alias("n_distinct"))


def q_label_index(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import ml as ML

    return ML.label_index(FX.labeled(spark, sf).select("id", "issue_type"), "issue_type") \
        .select("id", "issue_type", "label_index")


def _labelled_texts(spark, sf):
    """Every labelled text, derived once: splits, folds and fits read it several times."""
    from ..operators import ml as ML

    return ML._kept(FX.labeled(spark, sf).select("id", "text", "issue_type"))


def _train_test(spark, sf):
    return SM.stratified_split(_labelled_texts(spark, sf), "issue_type", "id", C.SEED)


def q_tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    """L2-normalised smooth TF-IDF weight of every term of every labelled text."""
    from ..operators import ml as ML

    rows = FX.labeled(spark, sf).select("id", "text")
    model = ML.fit_tfidf(rows, ML.TfidfSpec(ngram_max=1, vocab_size=None))
    return r6(ML.tfidf_rows(rows, model))


def q_tfidf_weights_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Sublinear weights of whole documents (terms of two documents or more): count of terms and the
    sum of the weights' squares per document, which is 1 where a term is left."""
    from ..operators import ml as ML

    docs = FX.read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), TX.normalize_text("text").alias("text"))
    rows = ML.tfidf_rows(docs, ML.fit_tfidf(docs, ML.BASELINE_SPEC))
    return r6(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum(F.col("weight") * F.col("weight")).alias("norm")))


def q_balanced_weights(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import ml as ML

    lab = FX.labeled(spark, sf).select("id", "issue_type")
    _, labels = ML.label_indexer(lab, "issue_type")      # null labels are an error there
    return r6(ML.balanced_weights(lab, "issue_type", labels, "weight"))


def _score_checks(scored: DataFrame, k: int) -> DataFrame:
    """Facts that hold for any fitted classifier: rows per split, probabilities that sum to 1, the
    confidence their greatest and the prediction its label."""
    p = F.col("probabilities")
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    rules = F.when((F.abs(total - 1) < 1e-6) & (F.size(p) == k) & (F.array_min(p) >= 0)
                   & (F.abs(F.array_max(p) - F.col("confidence")) < 1e-12)
                   & F.col("confidence").between(1.0 / k - 1e-9, 1.0 + 1e-9), 1).otherwise(0)
    return scored.groupBy("split", "issue_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(rules).alias("n_sound"), F.count("prediction").alias("n_predicted"))


def q_tfidf_lr_score(spark: SparkSession, sf: str) -> DataFrame:
    """Fit on the train split, score all rows; the facts any fit must meet, per split and label."""
    from ..operators import ml as ML

    sp = _train_test(spark, sf)
    clf = ML.fit_classifier(sp.filter(F.col("split") == "train"), "issue_type", calibrate=False)
    return _score_checks(clf.transform(sp), len(clf.labels))


def q_calibrated_score(spark: SparkSession, sf: str) -> DataFrame:
    """The same for the fold-averaged, calibrated model."""
    from ..operators import ml as ML

    sp = _train_test(spark, sf)
    clf = ML.fit_classifier(sp.filter(F.col("split") == "train"), "issue_type", calibrate=True)
    return _score_checks(clf.transform(sp), len(clf.labels))


def q_cv_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Five folds, each accuracy a share of its rows, mean and deviation those of the folds."""
    from ..operators import ml as ML

    cv = ML.cv_accuracy(_labelled_texts(spark, sf), "issue_type")
    return cv.select("fold", F.col("accuracy").between(0, 1).alias("is_share"),
                     (F.abs(F.col("cv_mean") - F.avg("accuracy").over(Window.partitionBy())) < 1e-9).alias("mean_fits"),
                     (F.abs(F.col("cv_std") - F.stddev_pop("accuracy").over(Window.partitionBy())) < 1e-9).alias("std_fits"))


def q_benchmark_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark run's row counts per model, and whether its scores are shares."""
    from . import jobs as JB

    out = JB.run_benchmark(spark, FX.tickets_raw(spark, sf))["benchmark_summary"]
    return out.select(F.col("model_name").alias("model"), "n_train", "n_test",
                      (F.col("accuracy").between(0, 1) & F.col("macro_f1").between(0, 1)
                       & F.col("weighted_f1").between(0, 1)).alias("are_shares"))


def q_model_to_route(spark: SparkSession, sf: str) -> DataFrame:
    """A fitted model's label and confidence through the cascade: rule rows by stage, and no row lost."""
    from ..operators import ml as ML
    from . import jobs as JB

    lab = _labelled_texts(spark, sf)
    sp = SM.stratified_split(lab, "issue_type", "id", C.SEED)
    clf = ML.fit_classifier(sp.filter(F.col("split") == "train"), "issue_type", calibrate=False, max_iter=50)
    routed = RT.route(JB.score(lab, clf))
    return routed.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("stage") == C.STAGE_RULE).alias("n_rule"),
                      F.count_if(F.col("route").isNull()).alias("n_without_route"))


# ----------------------------------------------------------------------------- checks that a wrong model or job fails

def _weak_rows(spark, sf):
    """Every labelled text with the label that the keyword rules give it, stored: a label that its words decide."""
    from ..operators import ml as ML

    lab = FX.labeled(spark, sf).select("id", "text")
    return ML._kept(lab.withColumn("label", TX.keyword_issue("text")))


def q_sweep_nan(spark: SparkSession, sf: str) -> DataFrame:
    """NaN scores: counted, but in no band of the sweep."""
    s = FX.scored(spark, sf)
    return r6(PO.threshold_sweep(s.withColumn("prob", F.when(F.col("id") % 4 == 1, F.lit(float("nan"))).otherwise(F.col("prob")))))


def _curve(points: DataFrame) -> DataFrame:
    """The fitted value at each summarised point."""
    from ..operators import ml as ML

    model = ML.isotonic_fit(points).setFeaturesCol("score").setPredictionCol("fitted")
    return model.transform(points)


def q_calibration_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Isotonic curve through the summary of all scores; each score has a cell of its own, so it is the exact fit."""
    from ..operators import ml as ML

    won = (F.col("id") * 7919) % 101 < (F.col("id") * 37) % 71 + 29
    rows = FX.scored(spark, sf).select(F.col("prob").alias("score"), won.alias("hit"))
    return r6(_curve(ML.calibration_points(rows, [])).select("score", "n", "fitted"))


def q_calibration_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The same where a cell holds many scores: the fit of the cells' shares."""
    from ..operators import ml as ML

    z = (F.col("n_chars") % 997).cast("double") / 200 - 2.5
    won = (F.col("doc_id") * 7919) % 101 < (F.col("n_chars") % 997) / 10
    rows = FX.read_table(spark, sf, "documents").select(z.alias("score"), won.alias("hit"))
    return r6(_curve(ML.calibration_points(rows, [], cells=64)).select("cell", "n", F.col("hits").cast("long").alias("hits"), "fitted"))


def q_fold_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences and rows of every term in each fold's training rows: the total minus the fold's own share."""
    from ..operators import ml as ML

    rows = FX.labeled(spark, sf).select("id", "text", "issue_type")
    terms = SM.kfold_assign(ML.tokenised(rows, ML.TfidfSpec(ngram_max=1)).drop("text"), "issue_type", "id", 5, C.SEED)
    totals = ML._kept(ML.term_totals(terms, "_tf_terms", {str(f): F.col("fold") == f for f in range(5)}))
    out = None
    for f in range(5):
        own = ML.without_part(totals, str(f)).where("df > 0").select(F.lit(f).alias("fold"), "term", "tf", "df")
        out = own if out is None else out.unionByName(own)
    return out


def q_lr_optimality(spark: SparkSession, sf: str) -> DataFrame:
    """A fitted logistic regression stands at the one optimum of its objective: gradient plus penalty near 0, per class."""
    from ..operators import ml as ML
    from . import checks as CK

    rows = _weak_rows(spark, sf)
    spec = ML.TfidfSpec(ngram_max=1)
    clf = ML.fit_classifier(rows, "label", spec, calibrate=False, max_iter=300)
    data = ML.drop_internal(clf.features.transform(rows)).select("label", "features")
    model = clf.lr_models[0]
    found = CK.optimality(data, "label", clf.labels, model.coefficientMatrix.toArray(), model.interceptVector.toArray())
    return found.select("label", "n_terms", (F.col("residual") < 0.02).alias("at_optimum"))


def q_learned_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out rows of every label, and whether a model fitted on the others tells nine of ten of them."""
    from ..operators import ml as ML

    sp = SM.stratified_split(_weak_rows(spark, sf), "label", "id", C.SEED)
    clf = ML.fit_classifier(sp.where("split = 'train'"), "label", calibrate=False, max_iter=50)
    out = clf.transform(sp.where("split = 'test'"))
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n_test"),
                                    (F.avg((F.col("prediction") == F.col("label")).cast("double")) >= 0.9).alias("is_learned"))


def q_calibrated_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The same for the calibrated model, and whether its confidence is right on average, within a tenth."""
    from ..operators import ml as ML

    sp = SM.stratified_split(_weak_rows(spark, sf), "label", "id", C.SEED)
    clf = ML.fit_classifier(sp.where("split = 'train'"), "label", ML.TfidfSpec(ngram_max=1), calibrate=True, folds=3, max_iter=50)
    hit = (F.col("prediction") == F.col("label")).cast("double")
    out = clf.transform(sp.where("split = 'test'"))
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n_test"), (F.avg(hit) >= 0.9).alias("is_learned"),
                                    (F.abs(F.avg("confidence") - F.avg(hit)) <= 0.1).alias("is_calibrated"))


def q_cv_learned(spark: SparkSession, sf: str) -> DataFrame:
    """Each fold tells nine of ten of its rows; the mean and deviation are those of the folds."""
    from ..operators import ml as ML

    cv = ML.cv_accuracy(_weak_rows(spark, sf), "label", ML.TfidfSpec(ngram_max=1), max_iter=50)
    w = Window.partitionBy()
    return cv.select("fold", (F.col("accuracy") >= 0.9).alias("is_learned"), (F.abs(F.col("cv_mean") - F.avg("accuracy").over(w)) < 1e-9).alias("mean_fits"),
                     (F.abs(F.col("cv_std") - F.stddev_pop("accuracy").over(w)) < 1e-9).alias("std_fits"))


def q_train_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Two targets trained from one tokenised table: held-out support of every label, and whether a target that the words
    decide is learned."""
    from ..operators import ml as ML

    rows = FX.labeled(spark, sf).select("id", "text", "issue_type", TX.keyword_issue("text").alias("keyword"))
    got = ML.train_text_models(rows, ["issue_type", "keyword"], with_cv=False, calibrate=False, max_iter=40)
    out = None
    for target, r in got.items():
        own = r.report.where("label NOT LIKE '% avg'").select(F.lit(target).alias("target"), "label", F.col("support").cast("long").alias("support"),
                                                             F.lit(bool(target == "issue_type" or r.accuracy >= 0.9)).alias("is_learned"))
        out = own if out is None else out.unionByName(own)
    return out


def q_model_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """A saved and loaded model predicts what the fitted one does: rows per label, and how many predictions are equal."""
    import uuid

    from ..operators import ml as ML
    from ..session import shared_path
    from ..sources import sinks as SK

    rows = _weak_rows(spark, sf)
    clf = ML.fit_classifier(rows, "label", ML.TfidfSpec(ngram_max=1), calibrate=False, max_iter=20)
    path = shared_path(spark, "roundtrip", uuid.uuid4().hex)
    SK.save_classifier(clf, path)
    back = SK.load_classifier(spark, path)
    a = clf.transform(rows).withColumnsRenamed({"prediction": "first", "confidence": "c"}).drop("probabilities")
    both = back.transform(a)
    same = (F.col("first") == F.col("prediction")) & (F.abs(F.col("c") - F.col("confidence")) < 1e-12)
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("n_equal"))


def q_sublinear_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weight of every term of every document in the benchmark baseline's features (1 + ln tf, terms of two documents or more)."""
    from ..operators import ml as ML

    docs = FX.read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), TX.normalize_text("text").alias("text"))
    return r6(ML.tfidf_rows(docs, ML.fit_tfidf(docs, ML.BASELINE_SPEC)))


def q_benchmark_models(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark's two models on labels that the words decide: held-out rows per label, and whether nine of ten are told."""
    from ..operators import ml as ML

    sp = ML._kept(SM.stratified_split(_weak_rows(spark, sf).withColumnRenamed("label", "issue_type"), "issue_type", "id", C.SEED))
    train, test = sp.where("split = 'train'").drop("split"), sp.where("split = 'test'")
    out = None
    for name, clf in (("ml_baseline", ML.fit_baseline(train, "issue_type", max_iter=60)),
                      ("ml_improved", ML.fit_improved(train, "issue_type", max_iter=60))):
        own = clf.transform(test).groupBy(F.lit(name).alias("model"), F.col("issue_type").alias("label")).agg(
            F.count(F.lit(1)).alias("n_test"), (F.avg((F.col("prediction") == F.col("issue_type")).cast("double")) >= 0.9).alias("is_learned"))
        out = own if out is None else out.unionByName(own)
    return out


def q_local_run(spark: SparkSession, sf: str) -> DataFrame:
    """The local run on the merged eval set: rows per label of its training frame, rows routed, rows of the sweep."""
    from . import jobs as JB

    cfg = JB.TriageConfig(label_targets=("issue_type", "urgency"), with_cv=False, max_iter=10, folds=2, fit_rows=2000)
    es = ES.merge_eval_set(_base(spark, sf), _candidates(spark, sf))
    res = JB.run_local(spark, es, _ledger(spark), cfg)
    parts = res["issue_counts"].select(F.col("issue_type").alias("name"), F.col("count").alias("n"))
    parts = parts.unionByName(res["routed"].agg(F.lit("routed").alias("name"), F.count(F.lit(1)).alias("n")))
    return parts.unionByName(res["threshold_sweep"].agg(F.lit("sweep").alias("name"), F.count(F.lit(1)).alias("n")))


# ----------------------------------------------------------------------------- calls, files, jobs

def _answering_client():
    """A client that answers with the prompt's length and refuses prompts about opening hours."""
    import json

    def call(prompt: str) -> str:
        if "opening hours" in prompt:
            raise RuntimeError("refused")
        return json.dumps({"issue_type": "ads", "suggested_path": "queue", "length": len(prompt)})

    return call


def _ledger(spark) -> str:
    import uuid

    from ..session import shared_path

    return shared_path(spark, "ledger", uuid.uuid4().hex)


def q_classify_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Every low-band ticket called once through the ledger, twice over: the second run finds all replies there."""
    from ..operators import model_calls as MC

    band, ledger = RT.low_band(FX.scored(spark, sf)), _ledger(spark)
    MC.classify_replies(band, _answering_client, ledger=ledger, unit_calls=500)
    return MC.classify_replies(band, _answering_client, ledger=ledger, unit_calls=500)


def q_enrichment_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Summary and resolution of every middle-band ticket through the ledger."""
    from ..operators import model_calls as MC

    return MC.enrichment_replies(RT.middle_band(FX.scored(spark, sf)), _answering_client, ledger=_ledger(spark), unit_calls=2000)


CSV_ROWS = 200_000      # in a file at most: a file with line breaks in its fields is read by one task


def _as_csv(rows: DataFrame, path: str) -> None:
    rows.write.options(header=True, maxRecordsPerFile=CSV_ROWS, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def q_csv_folder(spark: SparkSession, sf: str) -> DataFrame:
    """Messages written as CSV, quotes and line breaks in the texts, and read back from the folder."""
    import uuid

    from ..session import shared_path
    from ..sources import readers as RD
    from ..sources import sinks as SK

    path = shared_path(spark, "csv", uuid.uuid4().hex)
    rows = FX.social_raw(spark, sf).withColumn("text", F.concat(F.lit('"quoted", '), F.col("text"), F.lit("\n, end")))
    _as_csv(rows, path)
    back = RD.require_rows(RD.first_table(RD.read_folder(spark, path)), "messages")
    return back.select(F.col("id").cast("long").alias("id"), "text", F.col("inbound").cast("boolean").alias("inbound"))


def q_labeled_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled rows as a CSV without a text column: the text is built from subject and description."""
    import uuid

    from ..session import shared_path
    from ..sources import readers as RD

    path = shared_path(spark, "csv", uuid.uuid4().hex)
    rows = FX.labeled(spark, sf).select("id", "subject", "description", "issue_type")
    _as_csv(rows, path)
    return RD.read_labeled_eval(spark, path).select(F.col("id").cast("long").alias("id"), "text", "issue_type")


def q_result_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Routed rows written by stage and small results written as one file, read back; a stale result emptied, a missing one none."""
    import uuid

    from .. import schemas as SC
    from ..session import shared_path
    from ..sources import readers as RD
    from ..sources import sinks as SK

    at = shared_path(spark, "results", uuid.uuid4().hex)
    routed = SK.materialize(spark, routed_with_replies(spark, sf), f"{at}/routed", ["stage"])
    SK.write_small(KP.queue_share(routed), f"{at}/share")
    SK.write_small(KP.queue_share(routed), f"{at}/stale")
    SK.overwrite_empty(spark, SC.EVAL_COMPARISON, f"{at}/stale")
    share, stale, missing = (RD.read_result(spark, f"{at}/{n}") for n in ("share", "stale", "never"))
    out = routed.groupBy(F.col("stage").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    for name, df in (("share", share), ("stale", stale), ("missing", missing)):
        own = spark.range(1).select(F.lit(name).alias("name"), F.lit(-1).cast("long").alias("n")) if df is None else \
            df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = out.unionByName(own)
    return out


def q_kpis_empty(spark: SparkSession, sf: str) -> DataFrame:
    """KPIs of a routed table without a row: the ids of all tickets are below zero in none."""
    return r6(KP.routing_kpis(RT.route(FX.scored(spark, sf)).where("id < 0")))


def q_cross_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Tickets without a subject column, and without a description column: each takes the other."""
    t = FX.tickets_raw(spark, sf)
    a = UN.map_structured(t.drop("subject"), **UN.FIXTURE_TICKET_COLUMNS).select("id", F.lit("no subject").alias("case"), "subject", "description")
    b = UN.map_structured(t.drop("description"), **UN.FIXTURE_TICKET_COLUMNS).select("id", F.lit("no description").alias("case"), "subject", "description")
    return a.unionByName(b)


def q_triage_job(spark: SparkSession, sf: str) -> DataFrame:
    """The whole triage job: rows of its tables, tickets that rules route, and whether its own KPIs are those of its routed table."""
    from . import jobs as JB

    cfg = JB.TriageConfig(label_targets=("issue_type",), with_cv=False, max_iter=10, folds=2, fit_rows=2000, unit_calls=100_000)
    res = JB.run_triage(spark, FX.social_raw(spark, sf), FX.tickets_raw(spark, sf), _ledger(spark), client_factory=_answering_client, cfg=cfg,
                        ticket_aliases=UN.FIXTURE_TICKET_COLUMNS["aliases"])
    routed = res["routed"]
    again = KP.routing_kpis(routed).select(*(F.col(c).alias(f"a_{c}") for c in ("tickets", "rule_based_rate", "human_triage_rate")))
    same = (F.col("tickets") == F.col("a_tickets")) & (F.abs(F.col("rule_based_rate") - F.col("a_rule_based_rate")) < 1e-9) \
        & (F.abs(F.col("human_triage_rate") - F.col("a_human_triage_rate")) < 1e-9)
    kpis = res["routing_metrics"].select("tickets", "rule_based_rate", "human_triage_rate").join(again, F.col("tickets") == F.col("a_tickets"))
    parts = [res["labeled"].agg(F.lit("labeled").alias("name"), F.count(F.lit(1)).alias("n")),
             routed.agg(F.lit("routed").alias("name"), F.count(F.lit(1)).alias("n")),
             routed.agg(F.lit("by_rule").alias("name"), F.count_if(F.col("stage") == C.STAGE_RULE).alias("n")),
             res["threshold_sweep"].agg(F.lit("sweep").alias("name"), F.count(F.lit(1)).alias("n")),
             kpis.agg(F.lit("kpis_fit").alias("name"), F.count_if(same).alias("n"))]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


QUERIES = {
    "normalize_text": q_normalize_text,
    "clean_placeholders": q_clean_placeholders,
    "keyword_issue": q_keyword_issue,
    "keyword_issue_bench": q_keyword_issue_bench,
    "keyword_urgency": q_keyword_urgency,
    "complexity": q_complexity,
    "rule_match": q_rule_match,
    "rule_match_table": q_rule_match_table,
    "inbound_filter": q_inbound_filter,
    "map_structured": q_map_structured,
    "unify": q_unify,
    "weak_labels": q_weak_labels,
    "label_composition": q_label_composition,
    "route_offline": q_route_offline,
    "route_with_replies": q_route_with_replies,
    "route_staged": q_route_staged,
    "urgency_suffix": q_urgency_suffix,
    "routing_kpis": q_routing_kpis,
    "report_format": q_report_format,
    "queue_share": q_queue_share,
    "threshold_sweep": q_threshold_sweep,
    "recommend_threshold": q_recommend_threshold,
    "confusion_long": q_confusion_long,
    "confusion_restricted": q_confusion_restricted,
    "confusion_wide": q_confusion_wide,
    "per_class": q_per_class,
    "per_class_restricted": q_per_class_restricted,
    "f1_summary": q_f1_summary,
    "lift": q_lift,
    "benchmark_summary_table": q_benchmark_summary_table,
    "benchmark_compat": q_benchmark_compat,
    "dedup_norm": q_dedup_norm,
    "per_class_sample": q_per_class_sample,
    "stratified_split": q_stratified_split,
    "kfold_assign": q_kfold_assign,
    "hash_sample": q_hash_sample,
    "hash_sample_small": q_hash_sample_small,
    "stratified_split_nulls": q_stratified_split_nulls,
    "kfold_assign_nulls": q_kfold_assign_nulls,
    "confusion_nulls": q_confusion_nulls,
    "route_nan": q_route_nan,
    "route_repeated_replies": q_route_repeated_replies,
    "rule_match_wide": q_rule_match_wide,
    "positional_split": q_positional_split,
    "anti_join_eval": q_anti_join_eval,
    "eval_set": q_eval_set,
    "eval_summary": q_eval_summary,
    "eval_set_checks": q_eval_set_checks,
    "unmapped_count": q_unmapped_count,
    "route_enriched": q_route_enriched,
    "freq_tables": q_freq_tables,
    "confidence_histogram": q_confidence_histogram,
    "urgency_order": q_urgency_order,
    "stage_display": q_stage_display,
    "rates_long": q_rates_long,
    "cost_curve": q_cost_curve,
    "f1_by_label_outer": q_f1_by_label_outer,
    "best_model": q_best_model,
    "enriched_listing": q_enriched_listing,
    "queue_counts": q_queue_counts,
    "local_training_frame": q_local_training_frame,
    "benchmark_rows": q_benchmark_rows,
    "benchmark_dedup_dropped": q_benchmark_dedup_dropped,
    "char_ngrams": q_char_ngrams,
    "label_index": q_label_index,
    "tfidf_weights": q_tfidf_weights,
    "tfidf_weights_documents": q_tfidf_weights_documents,
    "balanced_weights": q_balanced_weights,
    "model_to_route": q_model_to_route,
    "tfidf_lr_score": q_tfidf_lr_score,
    "calibrated_score": q_calibrated_score,
    "cv_accuracy": q_cv_accuracy,
    "benchmark_summary": q_benchmark_summary,
    "sweep_nan": q_sweep_nan,
    "calibration_curve": q_calibration_curve,
    "calibration_cells": q_calibration_cells,
    "fold_terms": q_fold_terms,
    "lr_optimality": q_lr_optimality,
    "learned_labels": q_learned_labels,
    "calibrated_labels": q_calibrated_labels,
    "cv_learned": q_cv_learned,
    "train_targets": q_train_targets,
    "model_roundtrip": q_model_roundtrip,
    "sublinear_weights": q_sublinear_weights,
    "benchmark_models": q_benchmark_models,
    "local_run": q_local_run,
    "classify_calls": q_classify_calls,
    "enrichment_calls": q_enrichment_calls,
    "csv_folder": q_csv_folder,
    "labeled_csv": q_labeled_csv,
    "result_tables": q_result_tables,
    "kpis_empty": q_kpis_empty,
    "cross_fill": q_cross_fill,
    "triage_job": q_triage_job,
}

"""Bench: headline operators on $BENCH_SF_DIR with local[$BENCH_CPUS].

Two groups, each stage executed in full (``noop`` sink or a parquet write; no
driver collect) and timed:

* registered queries over the driver tables (unify, labels, text, evaluation,
  sampling, eval set, rule table);
* the triage job shape: the scored table (with its routing band, partitioned by it) and the
  reply tables are written once under the checkpoint folder, then routing (written, partitioned by stage), KPIs,
  shares, reports and the sweep read those tables — as ``plans.jobs.run_triage`` does.

Prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

QUERY_GROUP = (
    "normalize_text", "unify", "weak_labels", "rule_match_table", "per_class", "confusion_long", "f1_summary",
    "stratified_split", "kfold_assign", "per_class_sample", "eval_set", "eval_summary",
)


def _noop(df):
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    from ticketlens.operators import kpis as KP
    from ticketlens.operators import policy as PO
    from ticketlens.operators import reports as RP
    from ticketlens.operators import routing as RT
    from ticketlens.plans.queries import QUERIES
    from ticketlens.session import local_session, shared_path, use_local_folder
    from ticketlens.sources import fixtures as FX
    from ticketlens.sources import sinks as SK

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8")),
                          app="ticketlens-bench")
    use_local_folder(spark)
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t0, 3)
        return out

    _noop(QUERIES["unify"](spark, sf_dir))      # warm-up: JVM classes, parquet footers

    for name in QUERY_GROUP:
        timed(name, lambda n=name: _noop(QUERIES[n](spark, sf_dir)))

    run = shared_path(spark, "bench", uuid.uuid4().hex[:8])
    scored = timed("job_materialize_scored", lambda: SK.materialize(
        spark, RT.stage_table(FX.scored(spark, sf_dir)), f"{run}/scored", [RT.BAND_COL]))
    replies = timed("job_materialize_replies", lambda: SK.materialize(
        spark, FX.llm_replies(spark, sf_dir).join(RT.low_band(scored, staged=True).select("id"), "id", "left_semi"),
        f"{run}/replies"))
    enrichment = timed("job_materialize_enrichment", lambda: SK.materialize(
        spark, FX.llm_enrichment(spark, sf_dir).join(RT.middle_band(scored, staged=True).select("id"), "id",
                                                     "left_semi"),
        f"{run}/enrichment"))
    routed = timed("job_route_write", lambda: SK.materialize(
        spark, RT.route(scored, replies=replies, enrichment=enrichment, staged=True), f"{run}/routed", ["stage"]))
    timed("job_routing_kpis", lambda: _noop(KP.routing_kpis(routed)))
    timed("job_queue_share", lambda: _noop(KP.queue_share(routed)))
    timed("job_freq_tables", lambda: _noop(RP.frequency_tables(routed)))
    timed("job_confidence_histogram", lambda: _noop(RP.confidence_histogram(routed)))
    timed("job_enriched_listing", lambda: _noop(RP.enriched_listing(routed)))
    timed("job_threshold_sweep", lambda: _noop(PO.threshold_sweep(scored)))
    timed("job_recommend", lambda: _noop(PO.recommend(PO.threshold_sweep(scored))))

    # Training and scoring: the costliest part of the job (fit rows bounded as in the job).
    from ticketlens import config as C
    from ticketlens.operators import ml as ML
    from ticketlens.operators import sampling as SM
    from ticketlens.plans import jobs as JB

    labeled = SK.materialize(spark, FX.labeled(spark, sf_dir).select("id", "text", "issue_type"), f"{run}/labeled")
    split = SM.stratified_split(labeled, "issue_type", "id", C.SEED)
    clf = timed("job_fit", lambda: ML.fit_classifier(split.where("split = 'train'"), "issue_type", calibrate=False, max_iter=50))
    timed("job_score", lambda: _noop(JB.score(labeled, clf)))

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()

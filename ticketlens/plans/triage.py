"""The triage job for ``spark-submit``: folders in, tables out.

    spark-submit --py-files ticketlens.zip ticketlens/plans/triage.py --social DIR --tickets DIR --out DIR [--eval CSV] [--high 0.85] [--low 0.55]
        [--weight-auto 1 --weight-human 1 --weight-llm 1] [--sample N] [--fit-rows N] [--client module:factory]
        [--enrich | --summarize] [--no-cv] [--single-line]

``--social`` and ``--tickets`` are folders of CSV files (the first by name is read); ``--client`` names a function that
returns a callable from prompt to reply. Executors need the package too, hence ``--py-files`` with a zip of the folder
``ticketlens`` (and the client's module). ``--single-line`` reads large files in several tasks and is right only where no quoted
field has a line break. The cluster names the shared folder in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketlens import config as C
from ticketlens.functions.names import free_names
from ticketlens.plans import jobs as JB
from ticketlens.sources import readers as RD


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    base, sweep = C.RoutingThresholds(), JB.TriageConfig()
    p = argparse.ArgumentParser(prog="triage")
    for name in ("--social", "--tickets", "--out"):
        p.add_argument(name, required=True)
    p.add_argument("--eval")
    p.add_argument("--high", type=float, default=base.high_confidence)
    p.add_argument("--low", type=float, default=base.low_confidence)
    p.add_argument("--sample", type=int)
    p.add_argument("--fit-rows", type=int, default=sweep.fit_rows)
    p.add_argument("--max-iter", type=int, default=sweep.max_iter)
    p.add_argument("--folds", type=int, default=sweep.folds)
    p.add_argument("--targets", nargs="+", default=list(sweep.label_targets))
    p.add_argument("--client", help="module:function that makes a client")
    p.add_argument("--enrich", action="store_true")
    p.add_argument("--summarize", action="store_true")
    p.add_argument("--no-cv", action="store_true")
    p.add_argument("--single-line", action="store_true")
    weights = C.SweepWeights()
    p.add_argument("--weight-auto", type=float, default=weights.auto_weight)
    p.add_argument("--weight-human", type=float, default=weights.human_penalty)
    p.add_argument("--weight-llm", type=float, default=weights.llm_penalty)
    return p.parse_args(argv)


def client_factory(name: str | None):
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


FILE_BITS = 36      # rows of a file that its ids have room for


def with_id(df: DataFrame, offset: int) -> DataFrame:
    """An id of our own where the file has none: even for messages, odd for tickets.

    It is made of the file's place among the table's files, by name, and the row's place in its file, so the same files give the
    same ids however Spark splits them: a block's rows are counted, and a row's place is its place in its block after the
    rows of the blocks before.
    """
    if "id" in df.columns:
        return df.withColumn("id", F.col("id").cast("long"))
    path, start, line, of, of_start, first, before, file = free_names(
        [*df.columns, "id"], "_path", "_start", "_line", "_of", "_of_start", "_first", "_before", "_file")
    rows = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.file_block_start").alias(start),
                     F.monotonically_increasing_id().alias(line))
    blocks = rows.groupBy(F.col(path).alias(of), F.col(start).alias(of_start)).agg(F.min(line).alias(first), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(of).orderBy(of_start).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(of, of_start, first, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before),
                           (F.dense_rank().over(Window.orderBy(of)) - 1).cast("long").alias(file))      # a row per block of a file
    place = F.shiftleft(F.col(file), FILE_BITS) + F.col(before) + F.col(line) - F.col(first)
    return (rows.join(blocks, (F.col(path) == F.col(of)) & (F.col(start) == F.col(of_start)))
            .withColumn("id", place * 2 + offset).drop(path, start, line, of, of_start, first, before, file))


def run(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    social = with_id(RD.first_table(RD.read_folder(spark, a.social, multi_line=not a.single_line)), 0)
    social = social.withColumn("inbound", F.lower(F.col("inbound").cast("string")).eqNullSafe(F.lit("true")))
    tickets = with_id(RD.first_table(RD.read_folder(spark, a.tickets, multi_line=not a.single_line)), 1)
    rows = RD.read_labeled_eval(spark, a.eval, not a.single_line) if a.eval else None
    cfg = JB.TriageConfig(
        thresholds=C.RoutingThresholds(high_confidence=a.high, low_confidence=a.low),
        weights=C.SweepWeights(auto_weight=a.weight_auto, human_penalty=a.weight_human, llm_penalty=a.weight_llm), enrich_human=a.enrich,
        summarize_human=a.summarize, sample_cap=a.sample, fit_rows=a.fit_rows, with_cv=not a.no_cv,
        max_iter=a.max_iter, folds=a.folds, label_targets=tuple(a.targets))
    return JB.run_triage(spark, social, tickets, a.out, client_factory=client_factory(a.client),
                         eval_rows=None if rows is None else with_id(rows, 0), cfg=cfg)


if __name__ == "__main__":
    run(SparkSession.builder.appName("triage").getOrCreate(), arguments())

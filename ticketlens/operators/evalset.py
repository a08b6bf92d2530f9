"""Evaluation-set builder: labelled candidates from structured tickets, merged with a
base set after removing candidates whose normalised text the base already has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import lookup as LK
from ..functions import text as TX
from . import sampling as SM

EVAL_COLUMNS = ("id", "text", "issue_type", "urgency", "eval_label_source", "raw_ticket_type", "raw_priority")


def candidate_text(subject, description) -> F.Column:
    """``strip(strip(subject) + '. ' + clean(description))``; null description → ''."""
    subj = TX.strip_ws(F.coalesce(subject, F.lit("")))
    desc = TX.clean_placeholders(F.coalesce(description, F.lit("")))
    return TX.strip_ws(F.concat(subj, F.lit(". "), desc))


def candidate_rows(tickets: DataFrame, subject: str = "subject", description: str = "description",
                   type_col: str = "type", priority_col: str = "priority", id_col: str = "id",
                   type_map: dict[str, str] | None = None, min_len: int = C.EVAL_MIN_TEXT_LEN,
                   per_class: int = C.EVAL_ROWS_PER_CLASS, seed: int = C.SEED) -> DataFrame:
    """Length filter → type label (unmapped rows dropped) → urgency (default medium) →
    keep-first dedup on normalised text → up to ``per_class`` rows per label."""
    type_map = C.TICKET_TYPE_MAP if type_map is None else type_map
    c = tickets.select(
        F.col(id_col).alias("id"),
        TX.evaluated_once(candidate_text(F.col(subject), F.col(description))).alias("text"),
        F.col(type_col).alias("raw_ticket_type"), F.col(priority_col).alias("raw_priority"),
    ).filter(F.length("text") >= min_len)
    c = c.withColumn("issue_type", LK.map_lookup(TX.canon_key("raw_ticket_type"), type_map)) \
        .filter(F.col("issue_type").isNotNull())
    c = c.withColumn("urgency", F.coalesce(LK.map_lookup(TX.canon_key("raw_priority"), C.TICKET_PRIORITY_MAP),
                                           F.lit("medium")))
    c = SM.dedup_keep_first(c.withColumn("_norm", TX.normalize_text("text")), "_norm").drop("_norm")
    s = SM.per_class_sample(c, "issue_type", per_class, "id", seed)
    return s.select("id", "text", "issue_type", "urgency", F.lit("metadata_ticket_type").alias("eval_label_source"),
                    "raw_ticket_type", "raw_priority")


def unmapped_count(tickets: DataFrame, type_col: str = "type", type_map: dict[str, str] | None = None) -> DataFrame:
    type_map = C.TICKET_TYPE_MAP if type_map is None else type_map
    return tickets.agg(F.count_if(LK.map_lookup(TX.canon_key(type_col), type_map).isNull()).alias("unmapped"))


def base_from_labeled(labeled: DataFrame) -> DataFrame:
    """A base ("manually written") set: the rows whose labels are real."""
    b = labeled.filter(F.col("label_quality") == "real")
    return tag_base(b.select("id", "text", "issue_type", "urgency"))


def tag_base(base: DataFrame) -> DataFrame:
    """Back-fill the tag columns of a base set that lacks them."""
    cols = set(base.columns)
    return base.select(
        "id", "text", "issue_type", "urgency",
        (F.col("eval_label_source") if "eval_label_source" in cols else F.lit("manually_written")).alias("eval_label_source"),
        (F.col("raw_ticket_type") if "raw_ticket_type" in cols else F.lit("")).alias("raw_ticket_type"),
        (F.col("raw_priority") if "raw_priority" in cols else
         (F.col("urgency") if "urgency" in cols else F.lit(""))).alias("raw_priority"),
    )


def new_candidates(base: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates whose normalised text is not in the base set (left anti join).  The base
    keys are de-duplicated first: a partial aggregate collapses a hot text on the map side,
    and its shuffle already satisfies the join's distribution on ``_norm``."""
    seen = base.select(TX.normalize_text("text").alias("_norm")).distinct()
    return (candidates.withColumn("_norm", TX.normalize_text("text"))
            .join(seen, "_norm", "left_anti").drop("_norm"))


def merge_eval_set(base: DataFrame, candidates: DataFrame) -> DataFrame:
    return base.select(*EVAL_COLUMNS).unionByName(new_candidates(base, candidates).select(*EVAL_COLUMNS))


def eval_summary(eval_set: DataFrame) -> DataFrame:
    """Counts per (source, issue type) over every source × every issue type present, zeros
    kept.  One aggregation pass; the two lists of distinct values make the grid, which is left-joined to the counts."""
    counts = eval_set.groupBy("eval_label_source", "issue_type").agg(F.count(F.lit(1)).alias("count")).where("count > 0")
    grid = (counts.agg(F.collect_set(F.struct("eval_label_source")).alias("s"), F.collect_set(F.struct("issue_type")).alias("i"))
            .select("i", F.inline("s")).select("eval_label_source", F.inline("i")))
    of = counts.select(F.col("eval_label_source").alias("_s"), F.col("issue_type").alias("_i"), "count")
    same = F.col("eval_label_source").eqNullSafe(F.col("_s")) & F.col("issue_type").eqNullSafe(F.col("_i"))
    return (grid.join(of, same, "left")
            .select("eval_label_source", "issue_type", F.coalesce("count", F.lit(0)).cast("long").alias("count"))
            .orderBy("eval_label_source", "issue_type"))


CHECK_COLUMNS = ("check_name", "value")


def eval_set_checks(eval_set: DataFrame, min_per_class: int = C.EVAL_MIN_PER_CLASS,
                    taxonomy: tuple[str, ...] = C.ISSUE_TYPES, text_col: str = "text",
                    label_col: str = "issue_type") -> DataFrame:
    """Eval-set quality checks as a long table ``(check_name, value)``:

    * ``rows``; ``missing_text`` (null or blank text); ``label_outside_taxonomy``;
    * ``duplicate_rows`` — rows with text minus distinct normalised texts — and
      ``duplicate_rate`` over rows with text;
    * ``classes_below_min`` — taxonomy classes with fewer than ``min_per_class`` rows;
    * ``keyword_recoverable`` — rows whose keyword rules fire and give the row's label
      (easy rows that flatter a keyword baseline) — and ``keyword_recoverable_rate``.

    Two partial aggregates and no join: one over the rows (the distinct count of
    normalised texts shuffles map-side de-duplicated keys), one over the per-class
    count table (one row per label).
    """
    text, label = F.col(text_col), F.col(label_col)
    norm = TX.normalize_text(text)
    kw = TX.keyword_issue(norm)
    d = eval_set.select(label.alias("_y"), text.isNull().alias("_null"),
                        (text.isNull() | (TX.strip_ws(text) == "")).alias("_missing"),
                        norm.alias("_norm"), ((kw != "other") & (kw == label)).alias("_easy"))
    y = F.col("_y")
    r = d.agg(
        F.count(F.lit(1)).cast("double").alias("rows"),
        F.count_if("_missing").cast("double").alias("missing_text"),
        F.count_if(y.isNull() | ~y.isin(*taxonomy)).cast("double").alias("label_outside_taxonomy"),
        F.count("_norm").alias("_with_text"),
        F.count_distinct("_norm").alias("_distinct"),
        F.count_if(F.coalesce(F.col("_easy"), F.lit(False))).cast("double").alias("keyword_recoverable"),
    )
    dup = (F.col("_with_text") - F.col("_distinct")).cast("double")
    row_checks = r.select(F.inline(F.array(
        *[F.struct(F.lit(c).alias("check_name"), F.col(c).alias("value"))
          for c in ("rows", "missing_text", "label_outside_taxonomy")],
        F.struct(F.lit("duplicate_rows").alias("check_name"), dup.alias("value")),
        F.struct(F.lit("duplicate_rate").alias("check_name"),
                 (dup / F.greatest(F.col("_with_text"), F.lit(1))).alias("value")),
        F.struct(F.lit("keyword_recoverable").alias("check_name"), F.col("keyword_recoverable").alias("value")),
        F.struct(F.lit("keyword_recoverable_rate").alias("check_name"),
                 (F.col("keyword_recoverable") / F.greatest(F.col("rows"), F.lit(1.0))).alias("value")),
    )))
    per_class = eval_set.groupBy(label.alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    ok = F.count_if(F.col("_y").isin(*taxonomy) & (F.col("_n") >= min_per_class))
    class_checks = per_class.agg((F.lit(len(taxonomy)) - ok).cast("double").alias("value")) \
        .select(F.lit("classes_below_min").alias("check_name"), "value")
    return row_checks.unionByName(class_checks)

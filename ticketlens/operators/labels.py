"""Weak labels: issue type, urgency, complexity and label provenance, in one ``select``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as TX

LABEL_COLUMNS = ("text", "issue_type", "urgency", "complexity", "label_quality")


def add_weak_labels(df: DataFrame, keyword_map=C.KEYWORD_MAP) -> DataFrame:
    """Real label when the row's provenance is ``real`` and the value is in the taxonomy,
    else the keyword fallback on the normalised ``subject + ' ' + description``."""
    cols = set(df.columns)
    subject = F.col("subject") if "subject" in cols else F.lit(None).cast("string")
    description = F.col("description") if "description" in cols else F.lit(None).cast("string")
    category = F.coalesce(F.col("category"), F.lit("")) if "category" in cols else F.lit("")
    priority = F.coalesce(F.col("priority"), F.lit("")) if "priority" in cols else F.lit("")
    source = F.coalesce(F.col("label_source"), F.lit("weak")) if "label_source" in cols else F.lit("weak")
    is_real = source == F.lit("real")

    with_text = df.withColumn("text", TX.normalize_text(TX.null_safe_concat(subject, description)))
    text = F.col("text")
    return with_text.withColumns({
        "issue_type": F.when(is_real & category.isin(*C.ISSUE_TYPES), category)
        .otherwise(TX.keyword_issue(text, keyword_map)),
        "urgency": F.when(is_real & priority.isin(*C.URGENCY_LEVELS), priority)
        .otherwise(TX.keyword_urgency(text)),
        "complexity": TX.complexity(text),
        "label_quality": source,
    })


def label_composition(labeled: DataFrame) -> DataFrame:
    """Real / weak counts and their share of all rows (denominator at least 1)."""
    counts = labeled.groupBy("label_quality").agg(F.count(F.lit(1)).alias("count"))
    return with_share(counts, "count", "pct", scale=100.0)


def with_share(counts: DataFrame, count_col: str, out_col: str, scale: float = 1.0) -> DataFrame:
    """Add ``count / total`` to an *aggregated* frame (one row per group, few groups):
    the un-partitioned window runs over the aggregate, never over the raw rows."""
    total = F.greatest(F.sum(count_col).over(Window.partitionBy()), F.lit(1))
    return counts.withColumn(out_col, F.col(count_col) * F.lit(scale) / total)

"""Readers with explicit schemas (no inference on the hot path)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def read_csv(spark: SparkSession, path: str | list[str], schema=None, multi_line: bool = True) -> DataFrame:
    """CSV with header and an explicit schema when given.  Line breaks inside quoted fields are part of the
    field; such a file cannot be split, so a file is one task.  ``multi_line=False`` reads large files of which it is known
    that no field has a line break in several tasks."""
    r = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def read_table_set(spark: SparkSession, paths: dict[str, str | list[str]], schemas: dict | None = None,
                   multi_line: bool = True) -> dict[str, DataFrame]:
    """Named tables (name → path)."""
    schemas = schemas or {}
    return {name: read_csv(spark, p, schemas.get(name), multi_line) for name, p in paths.items()}


def read_folder(spark: SparkSession, folder: str, schemas: dict | None = None, multi_line: bool = True) -> dict[str, DataFrame]:
    """The CSV files of a folder as tables named by file (without the ending), in name order.

    The part files of one Spark job are one table.  Files are listed by Spark, so the folder may be in any store; only paths are read.  A folder
    without a CSV file is an error.
    """
    try:
        listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path").collect()
    except AnalysisException as exc:
        raise FileNotFoundError(f"no folder at {folder}") from exc
    paths: dict[str, list[str]] = {}
    for at in sorted(r["path"] for r in listed):
        name = at.rsplit("/", 1)[-1].removesuffix(".csv")
        paths.setdefault(re.sub(r"^part-\d+-([0-9a-f-]{36})-c\d+$", r"part-\1", name), []).append(at)
    if not paths:
        raise FileNotFoundError(f"no CSV file in {folder}")
    return read_table_set(spark, dict(sorted(paths.items())), schemas, multi_line)


def first_table(tables: dict[str, DataFrame]) -> DataFrame:
    """The table whose name comes first."""
    return tables[min(tables)]


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail the job early when an input is empty (one cheap ``isEmpty`` probe)."""
    if df.isEmpty():
        raise RuntimeError(f"{what} is empty: no input rows found")
    return df


def read_required(spark: SparkSession, path: str, schema=None, what: str = "input", multi_line: bool = True) -> DataFrame:
    try:
        return read_csv(spark, path, schema, multi_line)
    except AnalysisException as exc:
        raise FileNotFoundError(f"{what} not found at {path}") from exc


def read_labeled_eval(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Labeled eval rows; ``text`` is built from subject and description when absent."""
    df = read_csv(spark, path, multi_line=multi_line)
    if "text" not in df.columns:
        subj = F.col("subject") if "subject" in df.columns else F.lit("")
        desc = F.col("description") if "description" in df.columns else F.lit("")
        df = df.withColumn("text", F.concat(F.coalesce(subj, F.lit("")), F.lit(" "), F.coalesce(desc, F.lit(""))))
    return df


def first_present(df: DataFrame, *names: str, default: Column | None = None) -> Column:
    """Per row, the first non-null of the alias columns that exist (current name first,
    then legacy names); ``default`` (or null) when none exists or all are null."""
    present = [F.col(f"`{n}`") for n in names if n in df.columns]
    if default is not None:
        present.append(default)
    if not present:
        return F.lit(None)
    return present[0] if len(present) == 1 else F.coalesce(*present)


def read_result(spark: SparkSession, path: str) -> DataFrame | None:
    """A result table if it exists (parquet), else None — readers tolerate missing outputs."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def empty(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)


"""Shared helpers: table access, shared scratch tables, byte views of Arrow batches."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ticketlens.functions.names import free_names  # noqa: F401 - used by the operators
from ticketlens.session import CHECKPOINT_CONF, named_folder, use_local_folder

#: Text bytes that one vectorised step works on: bounds a Python worker's memory
#: whatever the number of rows in an Arrow batch.
STEP_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder under ``spark.checkpoint.dir``.

    Only where the session names none and runs in local mode (tests) is a folder
    of our own set; on a cluster an unset folder is an error.
    """
    base = named_folder(use_local_folder(spark))
    if not base:
        raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
    path = os.path.join(base, "llm", f"{tag}-{uuid.uuid4().hex}")
    for made in _WATCHED:
        made.append(path)
    return path


_WATCHED: list[list[str]] = []      # of the blocks of ``only_keeping`` that are open


@contextmanager
def only_keeping(spark: SparkSession) -> Iterator[list[str]]:
    """Scratch tables made within the block are deleted at its end, but for the paths put into the list it gives.

    For a caller that writes its result within the block: what was stored on the way is then read by nothing more. Only
    folders that ``scratch`` named in this block are touched.
    """
    made: list[str] = []
    kept: list[str] = []
    _WATCHED.append(made)
    try:
        yield kept
    finally:
        _WATCHED.remove(made)
        for path in made:
            if path not in kept:
                delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete one scratch folder, through Spark's own file system."""
    if not re.search(r"/llm/[\w-]+-[0-9a-f]{32}$", path):
        raise ValueError(f"not a scratch folder: {path}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later stages neither
    recompute it nor depend on the executors that made it."""
    return stored_at(df, tag)[0]


def stored_at(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """The same, and the folder."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def extended(schema: StructType, **more: str | DataType) -> StructType:
    """``schema`` with further columns (name to type); the argument itself stays as it is."""
    out = StructType(list(schema.fields))
    for name, kind in more.items():
        out = out.add(name, kind)
    return out


def rate_sample(df: DataFrame, id_col: str, most: int, total: int, seed: int = 7) -> DataFrame:
    """About ``most`` of ``total`` rows (all, when there are no more), chosen by a hash
    of the id; used only where a bounded sample of labelled rows may fit a model."""
    if total <= most:
        return df
    cut = int(most / total * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 30)) < cut)


def crc_mod(id_col: str, mod: int):
    """crc32 of the id as text, modulo ``mod`` (a null id: as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    col = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    col = col.cast(kind)
    if col.null_count:
        col = col.fill_null(b"")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset: col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0]: off[-1]], off - off[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES):
    """Row ranges (a, b) of about ``most`` bytes each; a longer row stands alone."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def merged_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the half-open spans as maximal, disjoint, ordered spans."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.r_[True, start[1:] > end[:-1]]
    last = np.r_[first[1:], True]
    return start[first], end[last]

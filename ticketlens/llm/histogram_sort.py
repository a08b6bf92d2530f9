"""Sharding by histogram sort: near-equal bytes per shard, one exchange.

Rows are ordered by (hash of the text, id, a stored row number). Candidate boundaries (probes) between keys are
counted exactly: every round, each partition adds up the bytes between neighbouring probes,
the sums meet in one small table, and only the gap that holds a target is probed again, until a
boundary lies within the tolerance or a single key is left. Then rows are exchanged once, by cell
(a fixed fraction of a shard), and get their place from exact cell counts plus their rank in
the cell. Equal texts are neighbours in this order: a group of copies is split only where a
boundary has to cut it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import free_names, stored

PROBES = 64           # new probes per unresolved boundary and round
TOLERANCE = 1e-4      # of a shard's mean bytes
KEY_BYTES = 24
_COUNTS = "cell int, bytes long, n long, lo binary, hi binary"


def _keys(*parts) -> np.ndarray:
    """The 24-byte big-endian form of (hash, id, row number): byte order equals the signed order."""
    key = np.empty((len(parts[0]), 3), ">u8")
    for k, c in enumerate(parts):
        key[:, k] = c.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return key.view(f"S{KEY_BYTES}").ravel()


def _as_key(x: int) -> bytes:
    return x.to_bytes(KEY_BYTES, "big")


def _as_int(b: bytes) -> int:
    return int.from_bytes(bytes(b).ljust(KEY_BYTES, b"\0"), "big")


def _count(narrow: DataFrame, probes: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Per non-empty cell between probes: (cell, bytes, rows, least key, greatest key).
    At most len(probes) + 1 rows reach the driver."""
    bounds = np.array([_as_key(p) for p in probes], f"S{KEY_BYTES}")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            keys = _keys(pdf["h"], pdf["id"], pdf["line"])
            cell = np.searchsorted(bounds, keys, "right") if len(bounds) else np.zeros(len(keys), np.int64)
            order = np.lexsort((keys, cell))
            cell, keys, size = cell[order], keys[order], pdf["size"].to_numpy()[order]
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            last = np.r_[first[1:], len(cell)] - 1
            yield pd.DataFrame({"cell": cell[first].astype(np.int32), "bytes": np.add.reduceat(size, first),
                                "n": last - first + 1, "lo": [k.ljust(KEY_BYTES, b"\0") for k in keys[first]],
                                "hi": [k.ljust(KEY_BYTES, b"\0") for k in keys[last]]})

    rows = (narrow.select("h", "id", "line", "size").mapInPandas(partial, _COUNTS).groupBy("cell")
            .agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("lo").alias("lo"),
                 F.max("hi").alias("hi")).collect())
    return sorted((r["cell"], r["bytes"], r["n"], _as_int(r["lo"]), _as_int(r["hi"])) for r in rows)


def _splitters(narrow: DataFrame, cells: int, tolerance: float) -> tuple[list[int], list[tuple]]:
    """The keys at which cells 1, 2, ... begin, and the exact counts of the cells."""
    whole = _count(narrow, [])
    if not whole:
        return [], []
    _, total, _, least, greatest = whole[0]
    targets = [total * k / cells for k in range(1, cells)]
    open_gaps = {k: (least, greatest) for k in range(len(targets))}
    found: dict[int, int] = {}
    while open_gaps:
        probes = set()
        for lo, hi in set(open_gaps.values()):
            count = min(PROBES, hi - lo)
            probes.update(lo + 1 + (hi - lo) * j // count for j in range(count))
            probes.update((lo, hi + 1))     # keys outside the gap stay out of its cells
        probes = sorted(p for p in probes if p <= greatest)
        counts = _count(narrow, probes)
        ends = np.cumsum([c[1] for c in counts]).tolist()
        for k in list(open_gaps):
            j = min(bisect_right(ends, targets[k]), len(counts) - 1)
            below, above = ends[j] - counts[j][1], ends[j]
            after = counts[j + 1][3] if j + 1 < len(counts) else min(greatest + 1, (1 << 8 * KEY_BYTES) - 1)
            near = min((abs(below - targets[k]), counts[j][3]), (abs(above - targets[k]), after))
            if near[0] <= tolerance or counts[j][3] == counts[j][4]:
                found[k] = near[1]
                del open_gaps[k]
            else:
                open_gaps[k] = counts[j][3], counts[j][4]
    splitters = [found[k] for k in range(len(targets))]
    for k in range(1, len(splitters)):
        splitters[k] = max(splitters[k], splitters[k - 1])
    return splitters, _count(narrow, splitters)


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
                    tolerance: float = TOLERANCE) -> DataFrame:
    """``docs``, all columns, with shard and slot; whole rows are exchanged once, by cell.

    A row weighs its text's UTF-8 bytes plus 1 (null: 1). Shards hold near-equal bytes: each boundary is
    within ``tolerance`` of a shard's mean bytes or at the nearest row. Slots are gapless from 0 in a shard, in
    the order (text hash, id, row number). Rows are numbered and written once, so rows that repeat an id and a text are dealt like any
    others. A null id sorts first; an empty table gives an empty result. Columns named shard or slot are replaced, all others kept.
    """
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    h, i, line, cell = free_names([*columns, "shard", "slot"], "own_h", "own_id", "own_line", "own_cell")
    docs = stored(docs.select(*(F.col(f"`{c}`") for c in columns)).withColumn(line, F.monotonically_increasing_id()), "histogram-sort-rows")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = {h: F.xxhash64(text), i: F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63)))}
    narrow = stored(docs.select((F.octet_length(text).cast("long") + 1).alias("size"), key[h].alias("h"), key[i].alias("id"),
                                F.col(line).alias("line")), "histogram-sort")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = max(8, -(-parts // shards))
    total = narrow.agg(F.sum("size")).first()[0] or 0
    splitters, counts = _splitters(narrow, shards * per, tolerance * total / shards)
    rows = {c[0]: c[2] for c in counts}
    before, at = [], 0
    for k in range(shards * per):
        at = 0 if k % per == 0 else at
        before.append(at)
        at += rows.get(k, 0)
    bounds = np.array([_as_key(s) for s in splitters], f"S{KEY_BYTES}")

    @F.pandas_udf("int")
    def cell_of(h: pd.Series, i: pd.Series, line: pd.Series) -> pd.Series:
        """Only the key of a row goes to Python."""
        keys = _keys(h, i, line)
        return pd.Series((np.searchsorted(bounds, keys, "right") if len(bounds) else np.zeros(len(keys))).astype(np.int32))

    rank = F.row_number().over(Window.partitionBy(cell).orderBy(h, i, line))
    start = F.element_at(F.lit(before), F.col(cell) + 1)
    return (docs.withColumns(key).withColumn(cell, cell_of(h, i, line))
            .withColumn("slot", start.cast("long") + rank - 1)
            .select(*(F.col(f"`{c}`") for c in columns), F.floor(F.col(cell) / per).cast("int").alias("shard"), "slot"))


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
                   tolerance: float = TOLERANCE) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot, from the rows of ``shard_documents``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return shard_documents(docs, shards, id_col, text_col, tolerance).select(
        F.col(id_col).cast("long").alias(id_col), (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), "shard", "slot")

"""Suffix-array dedup: remove repeated byte strings, by external induced sorting.

Every byte is removed that lies in a string of ``width`` bytes which also starts in a document with a
smaller id. The work is cut so that no shard needs the whole corpus:

1. Documents are packed into chunks (rows of about two megabytes, written once).
2. Every window of ``width`` bytes has an anchor, the 16-byte string with the least hash in it. Equal windows have equal
   anchors, so anchors (each once per chunk) are dealt to buckets by hash, and each bucket tells its chunks
   which of them occur in more than one document. Nothing else can hold a repeated window.
   Copies of whole texts, found by a hash, are marked and take no part in what follows.
3. The texts around shared anchors (each distinct text once per chunk, with its least id) go to the bucket of
   the anchor. A bucket sorts their suffixes by external induced sorting, with common-prefix values; a run of
   suffixes that share ``width`` bytes is one string, whose least id goes back to the chunks.
4. Each chunk marks the windows that have a smaller id elsewhere and removes what they cover.

A passage held by a third of all documents is one entry per chunk, not one per document. Where such a passage meets the
differing text around it, its anchor has a text of its own per document; the windows of such a hot anchor are
dealt one by one, by their own text, so that no bucket grows with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ticketlens.llm.common import extended, merged_spans, steps, stored, text_bytes
from ticketlens.llm.induced_sort import sorted_suffixes

WIDTH = 50
ANCHOR = 16
BUCKET_BYTES = 4 << 20        # text bytes per bucket
LEAST_BUCKETS = 64
_BLOCK = 1 << 15              # windows handled at a time
_SPANS = 1 << 14              # spans handled at a time
_ANCHOR_BYTES = 5             # of an anchor's hash within its bucket; a clash only adds a candidate
QUEUE_BYTES = 4 << 20         # of the sort's queues that stand in memory; the rest is on disk
HOT_RUNS = 1 << 15            # an anchor with more runs has its windows dealt one by one
_NO_ID = np.iinfo(np.int64).max

_VALUE = np.random.default_rng(20240602).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.random.default_rng(20240603).integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _least_in(h: np.ndarray, width: int) -> np.ndarray:
    """Least value in every window of ``width`` neighbours."""
    out, have = h, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have:]) if have < width else out


def anchor_runs(buf: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, one past the last, anchor hash) of runs of windows with one anchor, per text."""
    starts, stops, hashes = [], [], []
    for a in range(0, len(buf) - width + 1, _BLOCK):
        part = buf[a: a + _BLOCK + width - 1]
        h, size = _VALUE[part], 1
        for k in range(4):      # 16 bytes by doubling
            h, size = h[:-size] * _STEP[k] + h[size:], size * 2
        h ^= h >> np.uint64(29)
        h *= _STEP[5]
        h ^= h >> np.uint64(32)
        place = np.arange(len(h), dtype=np.uint64) & np.uint64(127)
        least = _least_in(h & ~np.uint64(127) | place, width - ANCHOR + 1)
        window = np.arange(len(least))
        anchor = window + (((least & np.uint64(127)).astype(np.int64) - window) & 127)
        valid = np.ones(len(least), bool)
        for edge in off[np.searchsorted(off, a + 1): np.searchsorted(off, a + len(part))] - a:
            valid[max(0, edge - width + 1): edge] = False
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | ~valid[:-1]]
        first = np.flatnonzero(valid & new)
        last = np.flatnonzero(valid & np.r_[new[1:] | ~valid[1:], True])
        starts.append(first + a)
        stops.append(last + 1 + a)
        hashes.append(least[first] >> np.uint64(7))
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(stops), np.concatenate(hashes)


def _matrix(buf: np.ndarray, start: np.ndarray, size: np.ndarray, wide: int) -> np.ndarray:
    """One row of ``wide`` bytes per span, zeros past its end."""
    out = np.zeros((len(start), wide), np.uint8)
    for a in range(0, len(start), _SPANS):
        at = start[a: a + _SPANS, None] + np.arange(wide)
        inside = np.arange(wide) < size[a: a + _SPANS, None]
        out[a: a + _SPANS] = np.where(inside, buf[np.minimum(at, len(buf) - 1)], 0)
    return out


def _joined(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of the spans, one after the other."""
    out = []
    for a in range(0, len(start), _SPANS):
        n = size[a: a + _SPANS]
        out.append(buf[np.repeat(start[a: a + _SPANS] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
    return np.concatenate(out) if out else buf[:0]


def distinct_spans(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first span of each distinct text, number of its text for every span, a hash of each span); exact."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    wide = -(-int(size.max()) // 8) * 8
    rows = _matrix(buf, start, size, wide)
    words = rows.view(np.uint64)
    h = size.astype(np.uint64) * _STEP[6]
    for k in range(words.shape[1]):      # only words that the text reaches: the hash is the same in every chunk
        mixed = (h ^ words[:, k]) * _STEP[7]
        h = np.where(size > 8 * k, mixed ^ (mixed >> np.uint64(31)), h)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    same = True
    for a in range(0, len(size), _SPANS):
        own, its = slice(a, a + _SPANS), first[number[a: a + _SPANS]]
        same &= bool((words[own] == words[its]).all() and (size[own] == size[its]).all())
    if not same:      # two texts with one hash
        full = np.c_[rows, size.astype("<u4").view(np.uint8).reshape(-1, 4)]
        keys = np.ascontiguousarray(full).view(f"V{full.shape[1]}").ravel()
        _, first, number = np.unique(keys, return_index=True, return_inverse=True)
    return first, number, h


def _chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk, bytes, data): rows of ``docs`` as compressed Arrow batches of about two megabytes of text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number = 0
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        for batch in batches:
            _, off = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            for a, b in steps(off):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                    out.write_batch(batch.slice(a, b - a))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task << 32 | number], pa.int64()), pa.array([int(off[b] - off[a])], pa.int64()),
                     pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "bytes", "data"])
                number += 1

    return stored(docs.mapInArrow(cut, "chunk long, bytes long, data binary"), "chunks")


class _Chunk:
    """A chunk's rows, with the runs of windows in its texts and their buckets."""

    def __init__(self, data: bytes, id_col: str, text_col: str, width: int, buckets: int):
        table = pa.ipc.open_stream(data).read_all().combine_chunks()
        self.rows = table.to_batches()[0] if table.num_rows else None
        ids = table.column(id_col)
        self.ids = ids.fill_null(_NO_ID).to_numpy().astype(np.int64)
        self.buf, self.off = text_bytes(table.column(text_col))
        self.start, self.stop, anchor = anchor_runs(self.buf, self.off, width)
        self.doc = np.searchsorted(self.off, self.start, "right") - 1
        self.anchors, self.anchor = np.unique(anchor, return_inverse=True)
        self.bucket = ((self.anchors >> np.uint64(8 * _ANCHOR_BYTES)) % np.uint64(buckets)).astype(np.int64)
        self.by_bucket = np.argsort(self.bucket, kind="stable")
        self.width, self.buckets = width, buckets

    def _marked(self, told: list[tuple[int, bytes, bytes]], which: int) -> np.ndarray:
        """Anchors that some bucket has marked, in the order in which they were listed to it."""
        flag = np.zeros(len(self.anchors), bool)
        cut = np.searchsorted(self.bucket[self.by_bucket], [t[0] for t in told])
        for at, t in zip(cut.tolist(), told, strict=True):
            one = np.unpackbits(np.frombuffer(t[which], np.uint8), bitorder="little")
            n = min(len(one), len(flag) - at)
            flag[self.by_bucket[at: at + n][one[:n] == 1]] = True
        return flag

    def regions(self, told: list[tuple[int, bytes, bytes]], copies: list[int]) -> _Regions:
        """The texts around shared anchors, but for those in copies of whole texts.

        A run's text goes to the bucket of its anchor. The runs of a hot anchor (one with very many runs in
        the corpus) stand window by window, each in the bucket of its own text.
        """
        alone = np.ones(len(self.off), bool)
        alone[copies] = False
        runs = np.flatnonzero(self._marked(told, 1)[self.anchor] & alone[self.doc])
        hot = self._marked(told, 2)[self.anchor[runs]]
        cold, warm = runs[~hot], runs[hot]
        each = self.stop[warm] - self.start[warm]
        place = np.repeat(self.start[warm] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        start = np.r_[self.start[cold], place]
        windows = np.r_[self.stop[cold] - self.start[cold], np.ones(len(place), np.int64)]
        doc = np.r_[self.doc[cold], np.repeat(self.doc[warm], each)]
        first, number, h = distinct_spans(self.buf, start, windows + self.width - 1)
        own = ((h[len(cold):] >> np.uint64(8)) % np.uint64(self.buckets)).astype(np.int64)
        return _Regions(start, windows, doc, np.r_[self.bucket[self.anchor[cold]], own], first, number)


class _Regions(NamedTuple):
    start: np.ndarray       # first window of each text
    windows: np.ndarray     # how many windows it holds
    doc: np.ndarray         # its document in the chunk
    bucket: np.ndarray
    first: np.ndarray       # one of each distinct text
    number: np.ndarray      # the distinct text of each


def _short(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_ANCHOR_BYTES].tobytes()


def _long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // _ANCHOR_BYTES, 8), np.uint8)
    out[:, :_ANCHOR_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, _ANCHOR_BYTES)
    return out.view("<u8").ravel()


def _copies(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk, copies: array of row numbers): rows whose whole text a smaller id has too."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chunk, data in zip(pdf["chunk"], pdf["data"], strict=True):
                table = pa.ipc.open_stream(data).read_all().combine_chunks()
                buf, off = text_bytes(table.column(text_col))
                raw, off = buf.tobytes(), off.tolist()
                yield pd.DataFrame({"chunk": chunk, "row": np.arange(len(off) - 1, dtype=np.int32),
                                    "id": table.column(id_col).fill_null(_NO_ID).to_numpy().astype(np.int64),
                                    "key": [blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(off, off[1:], strict=False)]})

    rows = stored(chunks.select("chunk", "data").mapInPandas(hashed, "chunk long, row int, id long, key binary"), "texts")
    first = stored(rows.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
                   .select("key", "least"), "first-texts")      # a table of its own: Spark can split the join's hot keys
    return (rows.join(first, "key").where("id > least")
            .groupBy("chunk").agg(F.collect_list("row").alias("copies")))


def _shared_anchors(chunks: DataFrame, make, copies: DataFrame, hot_runs: int) -> DataFrame:
    """(chunk, told: array of (bucket, bits, hot), copies): which of a chunk's anchors occur in two documents or
    more, and which have more than ``hot_runs`` runs."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chunk, data in zip(pdf["chunk"], pdf["data"], strict=True):
                c = make(data)
                pairs = np.unique(c.anchor.astype(np.int64) * len(c.off) + c.doc)
                many = np.bincount(pairs // len(c.off), minlength=len(c.anchors)) > 1
                times = np.minimum(np.bincount(c.anchor, minlength=len(c.anchors)), 255).astype(np.uint8)
                order = c.by_bucket
                cut = np.flatnonzero(np.r_[True, np.diff(c.bucket[order]) > 0]) if len(order) else np.zeros(0, int)
                yield pd.DataFrame({
                    "bucket": c.bucket[order][cut], "chunk": chunk,
                    "anchors": [_short(x) for x in np.split(c.anchors[order], cut[1:])] if len(cut) else [],
                    "many": [np.packbits(x, bitorder="little").tobytes() for x in np.split(many[order], cut[1:])] if len(cut) else [],
                    "times": [x.tobytes() for x in np.split(times[order], cut[1:])] if len(cut) else []})

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [_long(x) for x in pdf["anchors"]]
        flags = [np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")[: len(a)].astype(bool)
                 for x, a in zip(pdf["many"], lists, strict=True)]
        _, number, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        shared = count > 1
        shared |= np.bincount(number[np.concatenate(flags)], minlength=len(count)) > 0
        times = np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["times"]])
        hot = np.bincount(number, times, len(count)) > hot_runs
        ends = np.cumsum([len(a) for a in lists])[:-1]
        out = pdf[["chunk", "bucket"]].assign(
            bits=[np.packbits(x, bitorder="little").tobytes() if x.any() else None for x in np.split(shared[number], ends)],
            hot=[np.packbits(x, bitorder="little").tobytes() if x.any() else b"" for x in np.split(hot[number], ends)])
        return out[out["bits"].notna()]

    lists = chunks.select("chunk", "data").mapInPandas(listed, "bucket long, chunk long, anchors binary, many binary, times binary")
    told = (lists.groupBy("bucket").applyInPandas(told, "chunk long, bucket long, bits binary, hot binary")
            .groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits", "hot")).alias("told")))
    return stored(told.join(copies, "chunk", "full"), "shared-anchors")


def _settle(least: np.ndarray, held: list[np.ndarray], low: int) -> None:
    for place in held:
        least[place] = low


def _bucket_suffixes(text: np.ndarray, size: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(least id of every window of the distinct regions, place of each region's first window)."""
    ends = np.cumsum(size)
    windows = size - width + 1
    at = np.cumsum(windows) - windows
    region = np.repeat(np.arange(len(size), dtype=np.int32), size + 1)      # by place in the marked text
    inside = (np.arange(len(region)) - np.repeat(ends - size + np.arange(len(size)), size + 1)).astype(np.int32)
    whole = inside < windows.astype(np.int32)[region]
    least = np.empty(int(windows.sum()), np.int64)
    held, low = [], _NO_ID      # the string that the batch before ended in: its windows so far, their least id
    for suffix, common in sorted_suffixes(text, ends, width, QUEUE_BYTES):
        fresh = common < width      # a shared prefix of the width: the same string
        real = np.flatnonzero(suffix < len(region))
        real = real[whole[suffix[real]]]
        group, suffix = np.cumsum(fresh)[real], suffix[real]
        place, own = at[region[suffix]] + inside[suffix], ids[region[suffix]]
        if len(place):
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            value = np.minimum.reduceat(own, first)
            size_of = np.diff(np.r_[first, len(place)])
            if held and group[0] == 0:      # goes on
                low = min(low, int(value[0]))
                held.append(place[: size_of[0]])
                first, value, size_of = first[1:], value[1:], size_of[1:]
                place = place[len(held[-1]):]
            if len(value):
                _settle(least, held, low)
                done = size_of[:-1].sum()
                least[place[:done]] = np.repeat(value[:-1], size_of[:-1])
                held, low, last = [place[done:]], int(value[-1]), int(group[-1])
                open_ = last == int(fresh.sum())      # no string began after it
            else:
                open_ = not fresh.any()
        else:
            open_ = not fresh.any()
        if held and not open_:
            _settle(least, held, low)
            held, low = [], _NO_ID
    _settle(least, held, low)
    return least, at


def _least_ids(chunks: DataFrame, told: DataFrame, make, width: int) -> DataFrame:
    """(chunk, runs: array of binary): for a chunk's distinct regions, the least id of their windows."""

    def shipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chunk, data, bits, copies in zip(pdf["chunk"], pdf["data"], pdf["told"], pdf["copies"], strict=True):
                c = make(data)
                r = c.regions(_sorted_told(bits), _row_list(copies))
                if not len(r.first):
                    continue
                least, most = np.full(len(r.first), _NO_ID), np.full(len(r.first), np.iinfo(np.int64).min)
                np.minimum.at(least, r.number, c.ids[r.doc])
                np.maximum.at(most, r.number, c.ids[r.doc])
                start, size, bucket = r.start[r.first], r.windows[r.first] + width - 1, r.bucket[r.first]
                order = np.argsort(bucket, kind="stable")
                cut = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0])
                rows = []
                for own in np.split(order, cut[1:]):
                    text = _joined(c.buf, start[own], size[own]).tobytes()
                    rows.append((int(bucket[own[0]]), chunk, own.astype("<u4").tobytes(), size[own].astype("<u2").tobytes(),
                                 least[own].tobytes(), most[own].tobytes(), pa.compress(text, "zstd", asbytes=True)))
                yield pd.DataFrame(rows, columns=["bucket", "chunk", "number", "size", "least", "most", "text"])

    def resolved(pdf: pd.DataFrame) -> pd.DataFrame:
        size = np.concatenate([np.frombuffer(x, "<u2") for x in pdf["size"]]).astype(np.int64)
        least = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["least"]])
        most = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["most"]])
        number = np.concatenate([np.frombuffer(x, "<u4") for x in pdf["number"]])
        chunk = np.repeat(pdf["chunk"].to_numpy(), [len(x) // 2 for x in pdf["size"]])
        lengths = [int(np.frombuffer(x, "<u2").sum(dtype=np.int64)) for x in pdf["size"]]
        text = np.concatenate([np.frombuffer(pa.decompress(x, n, "zstd", asbytes=True), np.uint8)
                               for x, n in zip(pdf["text"], lengths, strict=True)])
        start = np.cumsum(size) - size
        first, same, _ = distinct_spans(text, start, size)
        ids = np.full(len(first), _NO_ID)
        np.minimum.at(ids, same, least)
        text = _joined(text, start[first], size[first])
        value, at = _bucket_suffixes(text, size[first], ids, width)
        # runs of windows with one least id, per distinct region
        edge = np.r_[True, value[1:] != value[:-1]]
        edge[at] = True
        begin = np.flatnonzero(edge)
        stop = np.r_[begin[1:], len(value)]
        region = np.searchsorted(at, begin, "right") - 1
        n = np.bincount(region, minlength=len(first))
        run_at = np.cumsum(n) - n
        # every chunk's region gets the runs that some of its documents lose
        of = np.repeat(np.arange(len(size)), n[same])
        run = np.repeat(run_at[same], n[same]) + np.arange(len(of)) - np.repeat(np.cumsum(n[same]) - n[same], n[same])
        keep = value[begin[run]] < most[of]
        of, run = of[keep], run[keep]
        row = np.repeat(np.arange(len(pdf)), [len(x) // 2 for x in pdf["size"]])[of]
        cut = np.flatnonzero(np.r_[True, np.diff(row) > 0]) if len(row) else np.zeros(0, int)
        lists = zip(np.split(of, cut[1:]), np.split(run, cut[1:]), strict=True) if len(cut) else []
        return pd.DataFrame([(int(chunk[o[0]]), number[o].astype("<u4").tobytes(),
                              (begin[r] - at[region[r]]).astype(np.uint8).tobytes(),
                              (stop[r] - at[region[r]]).astype(np.uint8).tobytes(), value[begin[r]].tobytes())
                             for o, r in lists], columns=["chunk", "number", "begin", "stop", "least"])

    regions = chunks.select("chunk", "data").join(told, "chunk").mapInPandas(
        shipped, "bucket long, chunk long, number binary, size binary, least binary, most binary, text binary")
    return stored(regions.groupBy("bucket").applyInPandas(resolved, "chunk long, number binary, begin binary, stop binary, least binary")
                  .groupBy("chunk").agg(F.collect_list(F.struct("number", "begin", "stop", "least")).alias("runs")), "least-ids")


def _sorted_told(bits) -> list[tuple[int, bytes, bytes]]:
    return sorted((t["bucket"], t["bits"], t["hot"]) for t in bits) if bits is not None else []


def _row_list(rows) -> list[int]:
    return list(rows) if rows is not None else []


RESULT = ("n_bytes", "n_removed", "n_spans", "kept")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                   bucket_bytes: int = BUCKET_BYTES, whole_characters: bool = False,
                   hot_runs: int = HOT_RUNS) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans (maximal removed runs) and kept (the other bytes).

    Texts are UTF-8 bytes; a null is an empty text. A null id counts as greater than any other. Rows that share an id
    do not remove each other's bytes. Input columns named like a result column are replaced; an
    empty table gives an empty result. ``width`` is from 24 to 128. With ``whole_characters`` a
    character is removed only with all its bytes, so that what is kept is UTF-8 again.
    """
    if not 24 <= width <= 128:
        raise ValueError("width must be from 24 to 128")
    docs = docs.drop(*RESULT).withColumn(id_col, F.col(id_col).cast("long"))
    chunks = _chunked(docs, id_col, text_col)
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // bucket_bytes))

    def make(data: bytes) -> _Chunk:
        return _Chunk(data, id_col, text_col, width, buckets)

    told = _shared_anchors(chunks, make, _copies(chunks, id_col, text_col), hot_runs)
    runs = _least_ids(chunks, told, make, width)
    schema = extended(docs.schema, n_bytes="long", n_removed="long", n_spans="long", kept="binary")
    arrow = to_arrow_schema(schema)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, bits, copies, lists in zip(*(batch.column(k) for k in range(4)), strict=True):
                c = make(data.as_py())
                if c.rows is not None:
                    yield _clean(c, _sorted_told(bits.as_py()), copies.as_py() or [], lists.as_py() or [], arrow, whole_characters)

    both = chunks.select("chunk", "data").join(told, "chunk", "left").join(runs, "chunk", "left")
    return both.select("data", "told", "copies", "runs").mapInArrow(cleaned, schema)


def _clean(c: _Chunk, bits: list, copies: list[int], lists: list, arrow: pa.Schema,
           whole_characters: bool) -> pa.RecordBatch:
    n = len(c.off) - 1
    start = end = np.zeros(0, np.int64)
    if lists:
        r = c.regions(bits, copies)
        region = np.concatenate([np.frombuffer(x["number"], "<u4") for x in lists]).astype(np.int64)
        begin = np.concatenate([np.frombuffer(x["begin"], np.uint8) for x in lists]).astype(np.int64)
        stop = np.concatenate([np.frombuffer(x["stop"], np.uint8) for x in lists]).astype(np.int64)
        least = np.concatenate([np.frombuffer(x["least"], np.int64) for x in lists])
        order = np.argsort(region, kind="stable")
        region, begin, stop, least = region[order], begin[order], stop[order], least[order]
        lo, hi = np.searchsorted(region, r.number, "left"), np.searchsorted(region, r.number, "right")
        each = hi - lo
        of = np.repeat(np.arange(len(r.number)), each)
        k = np.repeat(lo, each) + np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
        lost = least[k] < c.ids[r.doc[of]]
        of, k = of[lost], k[lost]
        gap = r.doc[of]                 # one free place between documents keeps their spans apart
        start = r.start[of] + begin[k] + gap
        end = r.start[of] + stop[k] + c.width - 1 + gap
    # a copy loses all of its text, if that holds a string of the width at all
    whole = np.array([k for k in copies if c.off[k + 1] - c.off[k] >= c.width], np.int64)
    start, end = merged_spans(np.r_[start, c.off[whole] + whole], np.r_[end, c.off[whole + 1] + whole])
    doc = np.searchsorted(c.off + np.arange(n + 1), start, "right") - 1
    start, end = start - doc, end - doc
    if whole_characters and len(start):
        # inwards to the next beginnings of characters; a span within one character vanishes
        begins = np.flatnonzero(np.r_[(c.buf & 0xC0) != 0x80, True])
        start = begins[np.searchsorted(begins, start)]
        end = begins[np.searchsorted(begins, end, "right") - 1]
        real = start < end
        start, end, doc = start[real], end[real], doc[real]
    delta = np.zeros(len(c.buf) + 1, np.int8)
    delta[start] += 1
    np.subtract.at(delta, end, 1)
    keep = np.cumsum(delta[:-1], dtype=np.int8) == 0
    sums = np.r_[0, np.cumsum(keep)]
    kept_off = sums[c.off]
    sizes = np.diff(c.off)
    kept = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(kept_off.astype(np.int32).tobytes()),
                                                  pa.py_buffer(c.buf[keep].tobytes())])
    columns = [*c.rows.columns, pa.array(sizes, pa.int64()), pa.array(sizes - np.diff(kept_off), pa.int64()),
               pa.array(np.bincount(doc, minlength=n).astype(np.int64), pa.int64()), kept]
    names = [*c.rows.schema.names, *RESULT]
    return pa.RecordBatch.from_arrays([x.cast(arrow.field(k).type) if x.type != arrow.field(k).type else x
                                       for x, k in zip(columns, names, strict=True)], names=names)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

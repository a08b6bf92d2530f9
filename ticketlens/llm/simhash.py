"""SimHash near-duplicates by a self-join of the binary trie of fingerprints.

Equal fingerprints are one class from the start. The distinct fingerprints form a binary trie; node
pairs are traversed together, each step adds the differing bits, and a pair whose bits exceed the budget
is dropped with everything below it.

Two fingerprints within a budget of b bits agree in at least one of b + 1 bands of bits. So the trie is built b + 1 times, rotated to
begin with each band in turn, and there the first band has budget 0: a part of the trie below one value of the band pairs with
nothing but itself. Counts per band value (some 40,000 numbers) cut each rotated trie into blocks of bounded size, and every fingerprint is
shipped b + 1 times whatever their number. A band value with more than a block is cut by a hash into blocks that are all
paired with each other. A task traverses blocks to the leaves, level by level in numpy, in
bounded slices, and emits the links of a spanning forest only, so a group of near copies never
becomes all its pairs; components of those links are the classes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import STEP_BYTES, free_names, stored, text_bytes
from ticketlens.llm.components import component_roots

SHINGLE = 4
MAX_BITS = 4
SEED = 42
_TOP_BITS = 13        # bits of a band that are counted
_ROTATION = 40        # a block's number holds its rotation above these bits
_SLICE = 200_000      # node pairs expanded at a time
_LEAF = 16            # leaf pairs below which a node pair is compared directly


def _slices(text: bytes, most: int) -> Iterator[bytes]:
    """Parts of about ``most`` bytes, cut where no word is."""
    at = 0
    while at < len(text):
        cut = at + most
        if cut < len(text):
            space = _WHITE.search(text, cut)
            cut = space.start() if space else len(text)
        yield text[at:cut]
        at = max(cut, at + 1)


_WHITE = re.compile(rb"[ \t-\r]")


def fingerprint(text: bytes, shingle: int = SHINGLE, most: int = STEP_BYTES) -> int:
    """64-bit SimHash of a UTF-8 text: bit 1 where over half the shingles' XXH64 have it.

    A long text is read in parts; the last words of a part begin the next one's shingles.
    """
    digest = xxhash.xxh64_intdigest
    ones, total, held = np.zeros(64, np.int64), 0, []
    for part in _slices(text, most):
        words = held + part.lower().split()      # bytes: A-Z only; splits at x20 and x09-x0D only
        if len(words) < shingle:
            held = words
            continue
        flat = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.r_[0, ends[:-1] + 1]
        hashes = np.array([digest(flat[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1:].tolist(), strict=False)], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(hashes)
        held = words[len(words) - shingle + 1:]
    if not total and held:      # fewer words than a shingle: all of them
        total = 1
        ones = np.unpackbits(np.array([digest(b" ".join(held), SEED)], ">u8").view(np.uint8)).astype(np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big") if total else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 with_md5: bool = False) -> DataFrame:
    """(id, fp) and, on demand, the text's md5: the fingerprint as a signed long; null, empty and blank texts have 0."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_bytes(batch.column(1))
            raw, off = buf.tobytes(), off.tolist()
            fps = [fingerprint(raw[a:b], shingle) for a, b in zip(off, off[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)),
                                              *batch.columns[2:]], names=[id_col, "fp", *batch.schema.names[2:]])

    more = [_md5(text_col).alias("md5")] if with_md5 else []
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text"), *more).mapInArrow(
        hashed, f"`{id_col}` long, fp long" + (", md5 string" if with_md5 else ""))


def _md5(text_col: str):
    """The text's md5; a null is an empty text."""
    return F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))


class Trie:
    """Levels of the binary trie over sorted distinct fingerprints, as index arrays."""

    def __init__(self, values: np.ndarray):
        self.values, n = values, len(values)
        self.start, self.kid, self.kids, self.bit = [np.zeros(1, np.int64)], [], [], [np.zeros(1, np.int8)]
        for depth in range(64):
            if len(self.start[-1]) == n:
                break
            top = values >> np.uint64(63 - depth)
            start = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
            kid = np.searchsorted(start, self.start[-1])
            self.kid.append(kid)
            self.kids.append(np.diff(np.r_[kid, len(start)]))
            self.start.append(start)
            self.bit.append((top[start] & np.uint64(1)).astype(np.int8))
        self.depth = len(self.start) - 1

    def bounds(self, depth: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = self.start[depth]
        lo = start[node]
        nxt = np.minimum(node + 1, len(start) - 1)
        return lo, np.where(node + 1 < len(start), start[nxt], len(self.values))


def close_pairs(a: Trie, b: Trie, budget: int, same: bool, exact: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of a, j of b) at ``budget`` differing bits or fewer; i < j where ``same``. Pairs that differ in
    the first ``exact`` bits need not be found."""
    one = np.zeros(1, np.int64)
    stack = [(0, one, one, np.zeros(1, np.int8))]
    last = min(a.depth, b.depth)
    while stack:
        depth, x, y, diff = stack.pop()
        if len(x) > _SLICE:
            half = len(x) // 2
            stack += [(depth, x[:half], y[:half], diff[:half]), (depth, x[half:], y[half:], diff[half:])]
            continue
        xlo, xhi = a.bounds(depth, x)
        ylo, yhi = b.bounds(depth, y)
        area = (xhi - xlo) * (yhi - ylo)
        done = (area <= _LEAF) if depth < last else np.ones(len(x), bool)
        if done.any():
            yield from _compared(a.values, b.values, xlo[done], xhi[done], ylo[done], yhi[done], budget, same)
        x, y, diff = x[~done], y[~done], diff[~done]
        if not len(x):
            continue
        xk, yk, twox, twoy = a.kid[depth][x], b.kid[depth][y], a.kids[depth][x] > 1, b.kids[depth][y] > 1
        level = []
        for i in (0, 1):
            for j in (0, 1):
                ok = np.ones(len(x), bool)
                if i:
                    ok &= twox
                if j:
                    ok &= twoy
                if same and i > j:
                    ok &= x != y
                cx, cy = xk[ok] + i, yk[ok] + j
                d = diff[ok] + (a.bit[depth + 1][cx] ^ b.bit[depth + 1][cy])
                ok = d <= (0 if depth < exact else budget)
                level.append((cx[ok], cy[ok], d[ok]))
        stack.append((depth + 1, *(np.concatenate(c) for c in zip(*level, strict=True))))


def _compared(a, b, xlo, xhi, ylo, yhi, budget, same):
    """Leaf ranges compared by xor and population count, in bounded slices."""
    area = (xhi - xlo) * (yhi - ylo)
    ends = np.cumsum(area)
    at = 0
    while at < len(area):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4 * _SLICE, "right")))
        size, wide = area[at:to], (yhi - ylo)[at:to]
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        w = np.repeat(wide, size)
        i = np.repeat(xlo[at:to], size) + k // w
        j = np.repeat(ylo[at:to], size) + k % w
        ok = np.bitwise_count(a[i] ^ b[j]) <= budget
        if same:
            ok &= i < j
        if ok.any():
            yield i[ok], j[ok]
        at = to


class Forest:
    """Least labels of the nodes linked so far."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        label = self.label
        while True:
            lu, lv = label[u], label[v]
            open_ = lu != lv
            if not open_.any():
                return
            u, v, lu, lv = u[open_], v[open_], lu[open_], lv[open_]
            np.minimum.at(label, np.maximum(lu, lv), np.minimum(lu, lv))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up


def _bands(budget: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the budget + 1 bands."""
    edges = [64 * k // (budget + 1) for k in range(budget + 2)]
    return [(x, y - x) for x, y in zip(edges, edges[1:], strict=False)]


def _rotated(v: np.ndarray, by: int) -> np.ndarray:
    """The fingerprints with bit ``by`` (from the top) first."""
    return v if by % 64 == 0 else v << np.uint64(by % 64) | v >> np.uint64(64 - by % 64)


def _layout(counts: dict[tuple[int, int], int], bands: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """(first block, blocks) of every rotation and band value: neighbouring values share a block of at most ``target``
    fingerprints, a value with more has several."""
    first, chunks = np.zeros((bands, 1 << _TOP_BITS), np.int64), np.ones((bands, 1 << _TOP_BITS), np.int64)
    made, held, at = 0, 0, -1
    for (r, value), n in sorted(counts.items()):
        if n > target or held + n > target or r != at:
            made, held = made + (held > 0), 0
        first[r, value] = made + (r << _ROTATION)
        held, at = held + n, r
        if n > target:
            chunks[r, value] = -(-n // target)
            made, held = made + int(chunks[r, value]), 0
    return first, chunks


def close_links(fps: DataFrame, budget: int = MAX_BITS, least_block: int = 4096, most_block: int = 1 << 17,
                blocks: int = 48) -> DataFrame:
    """(u, v): links that connect all distinct fingerprints (column fp) at ``budget`` bits or fewer."""
    spark = fps.sparkSession
    bands = _bands(budget)
    tops = [min(width, _TOP_BITS) for _, width in bands]
    values = F.array(*(F.struct(F.lit(r).alias("r"), F.shiftrightunsigned(_turned(F.col("fp"), at), 64 - tops[r]).cast("int").alias("value"))
                       for r, (at, _) in enumerate(bands)))
    counts = {(x[0], x[1]): x[2] for x in fps.select(F.inline(values)).groupBy("r", "value").count().collect()}
    n = sum(c for (r, _), c in counts.items() if r == 0)
    target = min(most_block, max(least_block, -(-n // blocks)))
    first, chunks = _layout(counts, len(bands), target)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            for r, (at, _) in enumerate(bands):
                v = _rotated(own, at)
                top = (v >> np.uint64(64 - tops[r])).astype(np.int64)
                block = first[r, top] + (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % chunks[r, top]
                order = np.argsort(block, kind="stable")
                cut = np.flatnonzero(np.r_[True, np.diff(block[order]) > 0]) if len(v) else []
                yield pd.DataFrame({"block": block[order][cut],
                                    "data": [x.tobytes() for x in np.split(v[order], cut[1:])] if len(v) else []})

    # first blocks of band values with several: at most a number per counted value
    several = np.sort(first[chunks > 1])
    last = dict(zip(first[chunks > 1].tolist(), (first + chunks)[chunks > 1].tolist(), strict=True))

    def gathered(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = int(np.searchsorted(several, key[0], "right")) - 1
        low = int(several[at]) if at >= 0 and key[0] < last[int(several[at])] else -1
        return pd.DataFrame({"block": [key[0]], "low": [low],
                             "data": [np.sort(np.frombuffer(b"".join(pdf["data"]), np.uint64)).tobytes()]})

    made = stored(fps.select("fp").mapInPandas(packed, "block long, data binary")
                  .groupBy("block").applyInPandas(gathered, "block long, low long, data binary"), "blocks")
    left = made.select(F.col("block").alias("a"), F.col("data").alias("left"), "low")
    pairs = left.select("a", F.col("a").alias("b"), "left", F.lit(None).cast("binary").alias("right"))
    if len(several):
        right = made.where("low >= 0").select(F.col("block").alias("b"), F.col("data").alias("right"), F.col("low").alias("of"))
        pairs = pairs.unionByName(left.join(right, (F.col("low") == F.col("of")) & (F.col("a") < F.col("b"))).select("a", "b", "left", "right"))
    per_task = max(1, (32 << 20) // (16 * target))
    rows = sum(int(c * (c + 1) // 2) for c in chunks[chunks > 1]) + len(np.unique(first))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))

    def traversed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b, one, other in pdf[["a", "b", "left", "right"]].itertuples(index=False):
                at, width = bands[a >> _ROTATION]
                x = Trie(np.frombuffer(one, np.uint64))
                y = x if a == b else Trie(np.frombuffer(other, np.uint64))
                shift = 0 if a == b else len(x.values)
                forest = Forest(len(x.values) + (len(y.values) if shift else 0))
                for i, j in close_pairs(x, y, budget, a == b, width):
                    forest.link(i, j + shift)
                v = _rotated(np.r_[x.values, y.values] if shift else x.values, 64 - at)
                tied = np.flatnonzero(forest.label != np.arange(len(v)))
                yield pd.DataFrame({"u": v[tied].view(np.int64), "v": v[forest.label[tied]].view(np.int64)})

    return pairs.repartition(parts, "a", "b").mapInPandas(traversed, "u long, v long")


def _turned(fp, by: int):
    """``_rotated`` as an expression."""
    return fp if by % 64 == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    budget: int = MAX_BITS) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (least id reachable).

    Null, empty and blank texts have fingerprint zero and are linked like any other. Repeated rows get
    equal results; null ids get their class's least id and never name a class; an empty
    table gives an empty result. Other columns are not read.
    """
    marked = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    rooted = _rooted(marked, id_col, budget)
    named = (rooted.groupBy("root").agg(F.min("least").alias("component_id"))
             .join(rooted.select("fp", "root"), "root").select("fp", "component_id"))
    return (marked.join(named, "fp")
            .select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def _rooted(marked: DataFrame, id_col: str, budget: int) -> DataFrame:
    """(fp, least, root): every fingerprint with its least id and the least fingerprint of its class."""
    classes = stored(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    roots = component_roots(close_links(classes, budget))
    return stored(classes.join(roots, F.col("fp") == F.col("node"), "left")
                  .select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                budget: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each class: the least id, a null after every other, and of one id the least md5 of the text.

    Of rows that repeat that id with that text one stays.
    """
    own_id, own_md5, of_id, of_md5 = free_names(docs.columns, "own_id", "own_md5", "of_id", "of_md5")
    marked = stored(fingerprints(docs, id_col, text_col, shingle, with_md5=True), "fingerprints")
    rooted = _rooted(marked, id_col, budget)
    least = F.min(F.struct(F.col(id_col).isNull().alias("nameless"), F.col(id_col).alias("id"), "md5")).alias("k")
    each = marked.groupBy("fp").agg(least).join(rooted.select("fp", "root"), "fp")
    again = marked.groupBy(F.col(id_col).alias("again_id"), F.col("md5").alias("again_md5")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = each.groupBy("root").agg(F.min("k").alias("k")).select(F.col("k.id").alias(of_id), F.col("k.md5").alias(of_md5))
    kept = stored(kept.join(again, F.col(of_id).eqNullSafe(F.col("again_id")) & (F.col(of_md5) == F.col("again_md5")), "left")
                  .select(of_id, of_md5, F.col("n").isNotNull().alias("repeated")), "kept")
    keyed = docs.withColumns({own_id: F.col(id_col).cast("long"), own_md5: _md5(text_col)})
    same = F.col(own_id).eqNullSafe(F.col(of_id)) & (F.col(own_md5) == F.col(of_md5))
    single = keyed.join(kept.where("not repeated"), same, "left_semi")
    several = keyed.join(kept.where("repeated"), same, "left_semi").dropDuplicates([own_id, own_md5])      # few: rows read twice
    return single.unionByName(several).select(*(F.col(f"`{c}`") for c in docs.columns))

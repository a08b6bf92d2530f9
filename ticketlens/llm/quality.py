"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in numpy over the bytes of a batch. Training bins each statistic at its
quantiles and grows trees level by level from histograms of gradients, on about ``MOST_LABELLED`` labelled rows (a bound on
the numbers that reach the driver: one row of statistics each). Trees are complete and flattened into arrays, so scoring
walks all trees of a batch at once by index arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ticketlens.llm.common import STEP_BYTES, extended, steps, text_bytes
from ticketlens.llm.toxicity import labelled_sample

MOST_LABELLED = 20_000
TREES, DEPTH, RATE, BINS = 80, 4, 0.15, 64
LEAST_HESSIAN, RIDGE = 5.0, 1.0

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "upper", "lower", "digit", "space", "newline", "end_marks",
    "commas", "other_signs", "high", "bytes_per_line", "distinct_words", "most_common_word", "short_words", "long_words",
    "capital_words", "sign_words", "upper_words", "words_per_end", "longest_word", "distinct_signs", "repeated_signs",
)

_KIND = np.full(256, 7, np.int8)           # signs
_KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[0x30:0x3A], _KIND[0x80:] = 0, 1, 2, 8
_KIND[[0x20, 0x09, 0x0D, 0x0B, 0x0C]] = 3
_KIND[0x0A] = 4
_KIND[[0x2E, 0x21, 0x3F]] = 5              # . ! ?
_KIND[[0x2C, 0x3B, 0x3A]] = 6              # , ; :
_VALUE = np.random.default_rng(20240605).integers(1, 1 << 63, 256, dtype=np.uint64)


class _Raw(NamedTuple):
    """What is counted in texts, so that parts of one text add up."""

    sums: np.ndarray        # per text: bytes by kind (9), words, their bytes, squares of these, and the counts below
    longest: np.ndarray     # bytes of the longest word
    signs: np.ndarray       # (text, sign): does it occur?
    own: np.ndarray         # text, hash and times of every distinct word, by text and hash
    hash: np.ndarray
    times: np.ndarray


_COUNTS = ("short_words", "long_words", "capital_words", "sign_words", "upper_words", "repeated_signs")


def _raw(buf: np.ndarray, off: np.ndarray) -> _Raw:
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    kind = _KIND[buf]
    each = np.bincount(doc * 9 + kind, minlength=n * 9).reshape(n, 9)
    inside = (kind != 3) & (kind != 4)
    begins, ends = inside.copy(), inside.copy()
    if len(buf):
        begins[1:] &= ~inside[:-1] | (doc[1:] != doc[:-1])
        ends[:-1] &= ~inside[1:] | (doc[1:] != doc[:-1])
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    own, length = doc[start], (end - start + 1).astype(float)
    # words by hash: sums of place-mixed byte values
    place = np.arange(len(buf)) - np.maximum.accumulate(np.where(begins, np.arange(len(buf)), 0))
    mixed = (_VALUE[buf] ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    sums = np.cumsum(np.where(inside, mixed ^ (mixed >> np.uint64(29)), np.uint64(0)), dtype=np.uint64)
    h = sums[end] - np.where(start > 0, sums[np.maximum(start - 1, 0)], np.uint64(0))
    order = np.lexsort((h, own))
    ho, oo = h[order], own[order]
    first = np.flatnonzero(np.r_[True, (ho[1:] != ho[:-1]) | (oo[1:] != oo[:-1])]) if len(ho) else np.zeros(0, int)
    sign = kind == 7
    signs = np.zeros((n, 256), bool)
    signs[doc[sign], buf[sign]] = True
    again = np.r_[False, sign[1:] & sign[:-1] & (buf[1:] == buf[:-1]) & (doc[1:] == doc[:-1])] if len(buf) else sign
    upper = np.r_[0, np.cumsum(kind == 0)]
    longest = np.zeros(n)
    np.maximum.at(longest, own, length)
    counts = {
        "short_words": own[length <= 3], "long_words": own[length >= 9], "capital_words": own[kind[start] == 0], "sign_words": own[kind[end] == 7],
        "upper_words": own[(upper[end + 1] - upper[start] >= 2) & (length >= 2)], "repeated_signs": doc[again],
    }
    columns = [*each.T, np.bincount(own, minlength=n), np.bincount(own, length, n), np.bincount(own, length ** 2, n),
               *(np.bincount(counts[c], minlength=n) for c in _COUNTS)]
    return _Raw(np.stack(columns, axis=1).astype(float), longest, signs, oo[first], ho[first], np.diff(np.r_[first, len(ho)]))


def _finished(size: np.ndarray, r: _Raw) -> np.ndarray:
    n = len(size)
    each, (words, total, squares) = r.sums[:, :9], r.sums[:, 9:12].T
    count = dict(zip(_COUNTS, r.sums[:, 12:].T, strict=True))
    some, w = np.maximum(size, 1), np.maximum(words, 1)
    mean = total / w
    most = np.zeros(n)
    np.maximum.at(most, r.own, r.times)
    columns = {
        "log_bytes": np.log1p(size), "log_words": np.log1p(words), "word_bytes": mean,
        "word_bytes_sd": np.sqrt(np.maximum(0, squares / w - mean ** 2)),
        **{name: each[:, k] / some for k, name in enumerate(
            ("upper", "lower", "digit", "space", "newline", "end_marks", "commas", "other_signs", "high"))},
        "bytes_per_line": np.log1p(size / (each[:, 4] + 1)),
        "distinct_words": np.bincount(r.own, minlength=n) / w, "most_common_word": most / w,
        **{name: count[name] / w for name in _COUNTS[:5]},
        "words_per_end": np.log1p(words / (each[:, 5] + 1)),
        "longest_word": np.log1p(r.longest), "distinct_signs": r.signs.sum(axis=1),
        "repeated_signs": count["repeated_signs"] / some,
    }
    out = np.stack([columns[name] for name in STATISTICS], axis=1).astype(float)
    out[size == 0] = 0
    return out


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of STATISTICS per text; an empty text has zeros."""
    return _finished(np.diff(off).astype(float), _raw(buf, off))


def long_statistics(buf: np.ndarray, most: int = STEP_BYTES) -> np.ndarray:
    """The same for one text, counted in parts that end where no word is."""
    done, at = None, 0
    while at < len(buf):
        cut = min(at + most, len(buf))
        while cut < len(buf) and _KIND[buf[cut]] not in (3, 4):
            ahead = np.flatnonzero((_KIND[buf[cut: cut + most]] == 3) | (_KIND[buf[cut: cut + most]] == 4))
            cut = cut + int(ahead[0]) if len(ahead) else min(cut + most, len(buf))
        part = _raw(buf[at:cut], np.array([0, cut - at]))
        if done is not None:
            every, number = np.unique(np.r_[done.hash, part.hash], return_inverse=True)
            times = np.bincount(number, np.r_[done.times, part.times])
            part = _Raw(done.sums + part.sums, np.maximum(done.longest, part.longest), done.signs | part.signs,
                        np.zeros(len(every), np.int64), every, times)
        done, at = part, cut
    return _finished(np.array([float(len(buf))]), done)


class Model(NamedTuple):
    feature: np.ndarray     # (trees, inner nodes): node i has children 2i + 1 and 2i + 2
    cut: np.ndarray         # go right above this value
    leaf: np.ndarray        # (trees, 2 ** DEPTH)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row: all trees walked together, one level at a time."""
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        rows = np.arange(len(x))[:, None]
        depth = int(np.log2(self.leaf.shape[1]))
        for _ in range(depth):
            right = x[rows, self.feature[trees, node]] > self.cut[trees, node]
            node = 2 * node + 1 + right
        line = self.base + self.leaf[trees, node - (self.leaf.shape[1] - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(line, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE,
          bins: int = BINS) -> Model:
    """Boosted trees of logistic loss; without both labels only the base rate is learned."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    model = Model(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), base)
    if not len(y) or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    line = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-line))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            at = node - first
            best = np.zeros(width)
            for f in range(x.shape[1]):
                key = at * bins + binned[:, f]
                gs = np.bincount(key, g, width * bins).reshape(width, bins)
                hs = np.bincount(key, h, width * bins).reshape(width, bins)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                gt, ht = gs.sum(1)[:, None], hs.sum(1)[:, None]
                gain = gl ** 2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt ** 2 / (ht + RIDGE)
                gain = np.where((hl >= LEAST_HESSIAN) & (ht - hl >= LEAST_HESSIAN), gain, 0)[:, : len(cuts[f])]
                if not gain.shape[1]:
                    continue
                k = gain.argmax(1)
                value = gain[np.arange(width), k]
                for i in np.flatnonzero(value > best + 1e-9):
                    best[i] = value[i]
                    model.feature[t, first + i], model.cut[t, first + i] = f, cuts[f][k[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), model.feature[t, node]] > model.cut[t, node])
        at = node - inner
        model.leaf[t] = rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + RIDGE)
        line += model.leaf[t][at]
    return model


def _per_text(df: DataFrame, text_col: str, schema, make) -> DataFrame:
    """``df`` with the columns that ``make`` gives for the statistics of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            for a, b in steps(off):
                part = batch.slice(a, b - a)
                long = b - a == 1 and off[b] - off[a] > STEP_BYTES
                x = long_statistics(buf[off[a]: off[b]]) if long else statistics(buf[off[a]: off[b]], off[a: b + 1] - off[a])
                yield pa.RecordBatch.from_arrays([*part.columns, make(x)], names=schema.names)

    return df.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, held_out, label: str = "quality", most: int = MOST_LABELLED) -> Model:
    """Trees from labelled rows outside ``held_out`` (about ``most`` ids, as ``labelled_sample`` draws them)."""
    sample = labelled_sample(docs, labels, label, held_out, most)
    schema = extended(sample.schema, x=ArrayType(DoubleType()))
    got = _per_text(sample, "text", schema, lambda x: pa.array(x.tolist(), pa.list_(pa.float64()))).select("label", "x").collect()
    x = np.array([r["x"] for r in got]).reshape(-1, len(STATISTICS))
    return train(x, np.array([r["label"] for r in got], float))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with quality_score (0 to 1). Null and empty texts are scored as empty; a very long text is counted in parts; repeated rows
    get the same score; an input column named quality_score is replaced."""
    docs = docs.drop("quality_score")
    shipped = docs.sparkSession.sparkContext.broadcast(model)      # trees x nodes numbers
    return _per_text(docs, text_col, extended(docs.schema, quality_score="double"),
                     lambda x: pa.array(shipped.value.score(x), pa.float64()))

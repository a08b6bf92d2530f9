"""Importance resampling towards a target distribution, on hashed word n-grams.

A feature is a run of 1 to ``longest`` consecutive words, joined by one space; its bucket is the CRC-32 of its bytes
modulo ``buckets``. No feature is ever built as a string. The distinct words of a slice of text, bounded by spaces, form an
Aho-Corasick dictionary whose entries carry the word's CRC and length; a scan of the slice emits these payloads in
order, and payloads of neighbours compose: the CRC of "a b" is the CRC of "a " moved on by the length of "b", a linear
map, combined with the CRC of "b". The same scan serves the counts and the scores.

Counts leave each task as ``buckets`` numbers; one scan counts the corpus, one scores it, and neither shuffles texts. The
draw orders narrow rows by a range exchange in which equal scores of equal ids are told apart by a row number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import STEP_BYTES, extended, free_names, steps, stored, text_bytes

BUCKETS = 10_000
LONGEST = 2

_IS_WORD = np.zeros(256, bool)
_IS_WORD[list(range(0x30, 0x3A)) + list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
#: A-Z to lower case, every byte that no word holds to a space.
_FOLD = bytes((c + 32 if 0x41 <= c < 0x5B else c) if _IS_WORD[c] else 0x20 for c in range(256))


# -- composition of payloads -------------------------------------------------------------------------------------------

_BYTE = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)


def _apply(columns: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The linear map with these images of the 32 bits, applied to each value."""
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), columns[bit], np.uint32(0))
    return out


@lru_cache(maxsize=64)
def _moved_by_power(k: int) -> np.ndarray:
    """Images of the 32 bits when 2 ** k bytes follow."""
    if k == 0:
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        return _BYTE[bits & np.uint32(255)] ^ (bits >> np.uint32(8))
    half = _moved_by_power(k - 1)
    return _apply(half, half)


@lru_cache(maxsize=1024)
def _moved(length: int) -> np.ndarray:
    """Four tables of 256 entries, one per byte of a CRC: what it becomes when ``length`` bytes follow."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for k in range(length.bit_length()):
        if length >> k & 1:
            bits = _apply(_moved_by_power(k), bits)
    octets = np.arange(256, dtype=np.uint32)
    return np.stack([_apply(bits, octets << np.uint32(8 * j)) for j in range(4)])


def compose(left: np.ndarray, right: np.ndarray, tables: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """CRCs of joined texts: ``left`` moved on by the length of the right part (``tables[kind]``), with ``right``."""
    moved = tables[kind, 0, left & np.uint32(255)]
    for j in range(1, 4):
        moved ^= tables[kind, j, left >> np.uint32(8 * j) & np.uint32(255)]
    return moved ^ right


# -- scan --------------------------------------------------------------------------------------------------------------


class WordScan:
    """Dictionary of the distinct words of some pieces of text; word, piece and payloads of every occurrence."""

    def __init__(self, pieces: list[bytes]):
        hay = b" " + b" ".join(p.translate(_FOLD) for p in pieces) + b" "
        words = sorted(set(hay.split(b" ")) - {b""})
        self.crc = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.crc_spaced = np.array([zlib.crc32(b" ", zlib.crc32(w)) for w in words], np.uint32)
        self.length = np.array([len(w) for w in words], np.int64)
        self.word = self.piece = np.zeros(0, np.int64)
        if not words:
            return
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, w in enumerate(words):
            automaton.add_word(f" {w.decode('latin-1')} ", k)
        automaton.make_automaton()
        found = np.fromiter(chain.from_iterable(automaton.iter(hay.decode("latin-1"))), np.int64).reshape(-1, 2)
        self.word = found[:, 1]
        first = np.cumsum([1] + [len(p) + 1 for p in pieces[:-1]])
        self.piece = np.searchsorted(first, found[:, 0] - 1, "right") - 1      # the place before the closing space


def slices(buf: np.ndarray, off: np.ndarray, most: int = STEP_BYTES) -> Iterator[list[tuple[int, int, int]]]:
    """(document, begin, end) of the pieces of each slice: whole documents, or one part of a longer one, cut where no word is."""
    for a, b in steps(off, most):
        if off[b] - off[a] <= most:
            yield [(d, int(off[d]), int(off[d + 1])) for d in range(a, b)]
            continue
        begin, end = int(off[a]), int(off[a + 1])
        while begin < end:
            cut = min(begin + most, end)
            while cut < end and _IS_WORD[buf[cut]]:      # forward to the end of the word
                ahead = np.flatnonzero(~_IS_WORD[buf[cut: min(cut + most, end)]])
                cut = cut + int(ahead[0]) if len(ahead) else min(cut + most, end)
            yield [(a, begin, cut)]
            begin = cut


def feature_buckets(buf: np.ndarray, off: np.ndarray, buckets: int = BUCKETS, longest: int = LONGEST,
                    most: int = STEP_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document of each feature, its bucket, document of each word) slice by slice.

    The last words of a part of a long document go on to its next part, so no feature is lost where it is cut.
    """
    last, held = -1, [np.zeros(0, np.uint32)] * 3
    for pieces in slices(buf, off, most):
        scan = WordScan([buf[x:y].tobytes() for _, x, y in pieces])
        doc = np.array([d for d, _, _ in pieces], np.int64)[scan.piece] if len(scan.word) else scan.word
        crc, spaced = scan.crc[scan.word], scan.crc_spaced[scan.word]
        size = scan.length[scan.word]
        before = len(held[0]) if pieces[0][0] == last else 0
        if before:
            crc, spaced, size = (np.r_[h, x] for h, x in zip(held, (crc, spaced, size), strict=True))
            doc = np.r_[np.full(before, last), doc]
        lengths, kind = np.unique(size, return_inverse=True)
        tables = np.stack([_moved(int(n)) for n in lengths]) if len(lengths) else np.zeros((0, 4, 256), np.uint32)
        run = crc            # CRC of the runs of n words that end at each word
        docs, found = [doc[before:]], [run[before:]]
        for n in range(2, longest + 1):
            # a run of n words: a run of n - 1, a space, a word
            spaced_run = spaced[: len(crc) - 1] if n == 2 else compose(run[:-1], _SPACE, _moved(1)[None], 0)
            run = compose(spaced_run, crc[1:] if n == 2 else crc[n - 1:], tables, kind[n - 1:]) if len(crc) >= n else run[:0]
            ok = doc[n - 1:] == doc[: len(doc) - n + 1]
            ok &= np.arange(n - 1, n - 1 + len(ok)) >= before      # ends in this part
            docs.append(doc[n - 1:][ok])
            found.append(run[ok])
        yield np.concatenate(docs), np.concatenate(found) % np.uint32(buckets), doc[before:]
        last = pieces[-1][0]
        mine = slice(max(len(doc) - longest + 1, int(np.searchsorted(doc, last))), None)
        held = [crc[mine], spaced[mine], size[mine]]


_SPACE = np.uint32(zlib.crc32(b" "))


# -- operators ---------------------------------------------------------------------------------------------------------


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n) of all features of all texts (nulls: none); buckets without a feature are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            buf, off = text_bytes(batch.column(0))
            for _, bucket, _ in feature_buckets(buf, off, buckets, longest):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    parts = texts.select(text_col).mapInArrow(count, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket, floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))), from two tables of
    ``bucket_counts``: at most ``buckets`` numbers each reach the driver."""
    def whole(counts):
        out = np.zeros(buckets, np.float64)
        for row in counts.collect():
            out[row["bucket"]] = row["n"]
        return out

    s, t = whole(raw), whole(target)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


RESULTS = ("n_words", "n_features", "weight")


def weigh(docs: DataFrame, gain: np.ndarray, text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """``docs`` without its text, with n_words, n_features and weight, the floored mean of the gains of its features (0 where
    there are none). Null and empty texts have no words; a very long text is scanned in parts; repeated rows are treated
    alike; input columns named like a result are replaced."""
    others = [c for c in docs.columns if c not in (*RESULTS, text_col)]
    docs = docs.select(*(F.col(f"`{c}`") for c in others), F.col(f"`{text_col}`"))
    schema = extended(docs.drop(text_col).schema, n_words="long", n_features="long", weight="long")
    known = docs.sparkSession.sparkContext.broadcast(gain)      # one number per bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = known.value
        for batch in batches:
            n_docs = batch.num_rows
            buf, off = text_bytes(batch.column(batch.num_columns - 1))
            words, features, total = (np.zeros(n_docs, np.int64) for _ in range(3))
            for doc, bucket, word_doc in feature_buckets(buf, off, len(value), longest):
                if len(doc):
                    low, high = int(doc.min()), int(doc.max()) + 1
                    words[low:high] += np.bincount(word_doc - low, minlength=high - low)
                    features[low:high] += np.bincount(doc - low, minlength=high - low)
                    # sums of integers below 2 ** 53: exact in doubles
                    total[low:high] += np.bincount(doc - low, weights=value[bucket], minlength=high - low).astype(np.int64)
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array(x, pa.int64()) for x in (words, features, weight)]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, *RESULTS])

    return docs.mapInArrow(score, schema)


def draw(weighed: DataFrame, id_col: str = "doc_id", share: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """``weighed`` (n_words, n_features, weight) with score and rank.

    score is the weight plus floor(-1000 * ln(-ln((h + 0.5) / 2 ** 32))), h being the first 32 bits of sha256 of
    ``seed:id`` (a null id: as the empty text). Of the N rows with at least ``least_words`` words the floor(share * N /
    100) of the highest score are ranked 1, 2, 3, ... (ties to the smaller id, a null id last; equal rows in any order), the others' rank is null.
    """
    at, score, place = free_names([*weighed.columns, "score", "rank"], "at", "own_score", "place")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8),
               16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    kept = [c for c in weighed.columns if c not in ("score", "rank")]
    scored = stored(weighed.select(*(F.col(f"`{c}`") for c in kept), (F.col("weight") + noise).alias(score),
                                   F.monotonically_increasing_id().alias(at)), "importance-scores")
    able = scored.where(F.col("n_words") >= least_words)
    # scores are whole numbers within some 10 ** 5 of each other, so this table is small whatever the corpus
    per_score = able.groupBy(score).agg(F.count(F.lit(1)).alias("n"))
    above = per_score.select(score, F.sum("n").over(Window.orderBy(F.col(score).desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)).alias("upto"), "n", F.sum("n").over(Window.partitionBy()).alias("all"))
    most = F.expr(f"`all` * {int(share)} div 100")
    first = above.agg(F.max(F.when(F.col("upto") >= most, F.col(score))).alias("cut"), F.max(most).alias("most")).first()
    most = int(first["most"] or 0)
    able = able.where(F.col(score) >= (first["cut"] or 0)).select(at, F.col(id_col).alias("id"), score)
    order = [F.col(score).desc(), F.col("id").asc_nulls_last(), F.col(at).asc()]
    lined = stored(able.repartitionByRange(*order).sortWithinPartitions(*order)
                   .select(at, F.monotonically_increasing_id().alias(place)), "importance-order")
    part, index = F.shiftright(place, 33), F.col(place).bitwiseAND((1 << 33) - 1)
    sizes = lined.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))      # a row per range partition
    earlier = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    ranked = (lined.join(earlier, part == F.col("part")).select(F.col(at).alias("of"), (F.col("earlier") + index + 1).alias("rank"))
              .where(F.col("rank") <= most))
    return (scored.join(ranked, F.col(at) == F.col("of"), "left")
            .select(*(F.col(f"`{c}`") for c in kept), F.col(score).alias("score"), "rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
             buckets: int = BUCKETS, longest: int = LONGEST, share: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """``docs`` without its text, with n_words, n_features, weight, score and rank (null: not drawn)."""
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_text_col, buckets, longest), buckets)
    return draw(weigh(docs, gain, text_col, longest), id_col, share, least_words, seed)

"""Benchmark decontamination with suffix arrays over the training text.

Each task takes a shard of whole documents, builds the (word) suffix array of the
shard and binary-searches every suffix of the test items in it, which gives the longest
verbatim match and all places of a window. A match never leaves its document, so the rows
of a document are complete within its shard: no shuffle.

The suffix array of a shard holds the suffixes that start with the first words of some
test window (three words, fewer for shorter items): no other suffix can match. Words stand as 64-bit
hashes that mix all their bytes, and suffixes are ordered by them, which is as good an order as any; words of one test
block never share a hash, and every document word of an occurrence is compared with its test word byte by byte before it counts.

Windows that several items share, or one item repeats, are one window with a list of items, so repeated items cost nothing
more. Test items are dealt into blocks of about ``BLOCK_WORDS`` words, each built in a task. One block is one pass over the
documents. A larger test set is searched block after block; only row numbers and what was found at them are stored in between.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.llm.common import extended, free_names, merged_spans, steps, stored, text_bytes

WINDOW = 10
BLOCK_WORDS = 1_000_000
_PREFIX = 3
_LONG = 64      # bytes from which a word is hashed by itself

_IS_WORD = np.zeros(256, bool)
_IS_WORD[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of some texts: runs of 0-9, a-z (A-Z folded) and non-ASCII bytes; they end with their text."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, seed: int = 0):
        self.bytes = _FOLD[buf]
        inside = _IS_WORD[self.bytes]
        begins, ends = inside.copy(), inside.copy()
        if len(buf):
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            edges = offsets[1:-1]
            begins[edges[edges < len(buf)]] = inside[edges[edges < len(buf)]]
            ends[edges[edges > 0] - 1] = inside[edges[edges > 0] - 1]
        self.start = np.flatnonzero(begins)
        self.size = np.flatnonzero(ends) + 1 - self.start
        self.first = np.searchsorted(self.start, offsets)      # index of each text's first word, and the total
        self.hash = self._hashes(seed)

    def _hashes(self, seed: int) -> np.ndarray:
        h = _mix(self.size.astype(np.uint64) + np.uint64(seed) * _STEP)
        raw = np.zeros(len(self.bytes) + 8, np.uint8)
        raw[:len(self.bytes)] = self.bytes
        eight = np.ndarray(len(self.bytes) + 1, "<u8", raw, strides=(1,))      # the eight bytes from each place on
        keep = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
        short = np.flatnonzero(self.size <= _LONG)
        for at in range(0, _LONG, 8):
            short = short[self.size[short] > at]
            if not len(short):
                break
            part = eight[self.start[short] + at] & keep[np.minimum(self.size[short] - at, 8)]
            h[short] = _mix((h[short] + _STEP) ^ part)
        for k in np.flatnonzero(self.size > _LONG):
            word = self.bytes[self.start[k]: self.start[k] + self.size[k]].tobytes()
            h[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
        return h

    def text(self, k: int) -> bytes:
        return self.bytes[self.start[k]: self.start[k] + self.size[k]].tobytes()


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    h = words[: len(words) - size + 1].copy()
    for j in range(1, size):
        h = _mix(h * _STEP + words[j: len(words) - size + 1 + j])
    return h


def _depth_keys(words: np.ndarray, at: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """The first ``depth`` words of each suffix as one sortable byte string; past its end: zeros."""
    out = np.zeros((len(at), depth), ">u8")
    for j in range(depth):
        ok = at + j < end
        out[ok, j] = words[at[ok] + j]
    return out.view(f"S{8 * depth}").ravel()


class TestBlock:
    """A block of test items: words, distinct windows with their items and places, and what suffixes must start with."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        self.ids, self.window = ids, window
        raw = [(t or "").encode() for t in texts]
        buf, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
        self.seed = 0
        while True:      # words of the block have hashes of their own
            found = Words(buf, off, self.seed)
            known: dict[int, bytes] = {}
            if all(known.setdefault(int(h), found.text(k)) == found.text(k) for k, h in enumerate(found.hash)):
                break
            self.seed += 1
        self.words, self.off = found.hash, found.first
        self.known = np.array(sorted(known), np.uint64)
        self.spelt = [known[int(h)] for h in self.known]
        self._ready = False

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("ids", "window", "seed", "words", "off", "known", "spelt")} | {"_ready": False}

    def ready(self) -> TestBlock:
        """Windows and prefixes, made where they are used and not shipped."""
        if self._ready:
            return self
        sizes, window = np.diff(self.off), self.window
        n = np.where(sizes >= window, sizes - window + 1, np.minimum(sizes, 1))
        item = np.repeat(np.arange(len(sizes)), n)
        at = np.repeat(self.off[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        length = np.minimum(window, sizes[item])
        low = _depth_keys(self.words, at, at + length, window)
        # equal windows are one; a window of fewer words ends with zeros, which no hash of a word is taken for
        keyed = np.rec.fromarrays([low, length], names="low,length")
        _, first, of = np.unique(keyed, return_index=True, return_inverse=True)
        self.low, self.length = low[first], length[first]
        order = np.argsort(of, kind="stable")
        self.place_at, self.place_end = at[order], self.off[1:][item[order]]
        self.place_from = np.searchsorted(of[order], np.arange(len(first) + 1))
        self.item = item[order]
        self.starts = {}
        for size in sorted(set(np.minimum(self.length, _PREFIX).tolist())):
            own = at[first][np.minimum(self.length, _PREFIX) == size]
            self.starts[size] = np.unique(_grams(self.words, size)[own]) if size else own[:0]
        self.spelt_size = np.array([len(w) for w in self.spelt], np.int64)
        self.spelt_from = np.cumsum(self.spelt_size) - self.spelt_size
        self.spelt_bytes = np.frombuffer(b"".join(self.spelt), np.uint8)
        self._ready = True
        return self

    def items_of(self, windows: np.ndarray) -> set[str]:
        found = [np.unique(self.item[self.place_from[w]: self.place_from[w + 1]]) for w in windows]
        return {self.ids[i] for i in np.unique(np.concatenate(found))} if found else set()

    def candidates(self, words: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Positions whose suffix starts like some window, within its document."""
        keep = np.zeros(len(words), bool)
        for size, known in self.starts.items():
            if not size or len(words) < size or not len(known):
                continue
            gram = _grams(words, size)
            table = np.zeros(1 << 16, bool)
            table[known & np.uint64(0xFFFF)] = True
            maybe = np.flatnonzero(table[gram & np.uint64(0xFFFF)])
            place = np.minimum(np.searchsorted(known, gram[maybe]), len(known) - 1)
            maybe = maybe[known[place] == gram[maybe]]
            keep[maybe[maybe + size <= end[maybe]]] = True
        return np.flatnonzero(keep)

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, words, window) of every occurrence of a window in the shard."""
        doc_off = words.first
        end = np.repeat(doc_off[1:], np.diff(doc_off))
        at = self.candidates(words.hash, end) if len(doc_off) > 1 else np.zeros(0, np.int64)
        if not len(at):
            none = np.zeros(0, np.int64)
            return none, none, none
        keys = _depth_keys(words.hash, at, end[at], self.window)
        order = np.argsort(keys, kind="stable")
        array, keys = at[order], keys[order]
        first = np.searchsorted(keys, self.low, "left")
        # one past the last suffix that starts with the window: the window with its last word
        # followed by the greatest possible words
        high = self.low.astype(f"S{8 * self.window + 1}")
        raw = np.frombuffer(high.tobytes(), np.uint8).reshape(len(high), -1).copy()
        raw[np.arange(raw.shape[1])[None, :] >= 8 * self.length[:, None]] = 255
        last = np.searchsorted(keys, raw.view(high.dtype).ravel(), "right")
        n = np.maximum(last - first, 0)
        place = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        window = np.repeat(np.arange(len(n)), n)
        pos, length = array[place], self.length[window]
        ok = pos + length <= end[pos]
        pos, length, window = pos[ok], length[ok], window[ok]
        wrong = np.r_[0, np.cumsum(self._misspelt(words, pos, length))]
        ok = wrong[pos + length] == wrong[pos]
        return pos[ok], length[ok], window[ok]

    def _misspelt(self, words: Words, pos: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Which words of the occurrences are not, byte by byte, the test word with their hash."""
        wrong = np.zeros(len(words.hash), bool)
        cover = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(cover, pos, 1)
        np.add.at(cover, pos + length, -1)
        mine = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        theirs = np.searchsorted(self.known, words.hash[mine])
        same = words.size[mine] == self.spelt_size[theirs]
        wrong[mine[~same]] = True
        mine, theirs = mine[same], theirs[same]
        size = words.size[mine]
        if len(mine):
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            differ = words.bytes[np.repeat(words.start[mine], size) + step] != self.spelt_bytes[np.repeat(self.spelt_from[theirs], size) + step]
            wrong[mine[np.add.reduceat(differ, np.cumsum(size) - size) > 0]] = True
        return wrong

    def longest(self, words: Words, pos: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Words of the longest match, in any item, that begins at each found place.

        All places of the found windows go on word by word; those that have read the same stay one class, so equal items are
        one, and an occurrence follows the class that reads what it reads.
        """
        size = self.length[window].copy()
        seen = np.unique(window)
        n = self.place_from[seen + 1] - self.place_from[seen]
        place = np.repeat(self.place_from[seen], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        kind, at, stop = np.repeat(np.arange(len(seen)), n), self.place_at[place], self.place_end[place]
        live, mine = np.arange(len(pos)), np.searchsorted(seen, window)
        end = np.repeat(words.first[1:], np.diff(words.first))[pos]
        whole = self.length[seen] == self.window      # a shorter window is a whole item
        keep = whole[kind]
        kind, at, stop = kind[keep], at[keep] + self.window, stop[keep]
        keep = whole[mine]
        live, mine = live[keep], mine[keep]
        while len(live) and len(at):
            keep = at < stop
            kind, at, stop = kind[keep], at[keep], stop[keep]
            keep = pos[live] + size[live] < end[live]
            live, mine = live[keep], mine[keep]
            if not len(at) or not len(live):
                break
            spelt, code = np.unique(self.words[at], return_inverse=True)
            classes, kind = np.unique(kind * len(spelt) + code, return_inverse=True)
            read = words.hash[pos[live] + size[live]]
            code = np.minimum(np.searchsorted(spelt, read), len(spelt) - 1)
            key = mine * len(spelt) + code
            mine = np.minimum(np.searchsorted(classes, key), len(classes) - 1)
            ok = (spelt[code] == read) & (classes[mine] == key)
            live, mine = live[ok], mine[ok]
            size[live] += 1
            at = at + 1
        return size


_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int, most: int) -> Iterator[TestBlock]:
    """Test items in blocks of about ``most`` words (an item more at most), each built in a task and fetched when its turn comes; an empty
    block where there is no item.

    Items are dealt by the words of the items before them, in hash order: words are summed per hash bucket first.
    """
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("id", "text"), "n": F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)), "line": F.monotonically_increasing_id()})
    rows = stored(rows.withColumn("bucket", F.col("h").bitwiseAND(1023)), "decontaminate-items")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("bucket").agg(F.sum("n").alias("s"))
    sums = sums.select(F.col("bucket").alias("of"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("bucket").orderBy("h", "line").rowsBetween(Window.unboundedPreceding, -1)
    dealt = rows.join(sums, F.col("bucket") == F.col("of"))
    place = F.col("earlier") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    dealt = dealt.select("id", "text", F.floor(place / most).cast("long").alias("block"))

    def build(own: pd.DataFrame) -> pd.DataFrame:
        texts = [None if t is None or t != t else t for t in own["text"]]
        made = TestBlock(own["id"].tolist(), texts, window)
        return pd.DataFrame({"block": [own["block"].iloc[0]], "made": [pickle.dumps(made)]})

    made = stored(dealt.groupBy("block").applyInPandas(build, "block long, made binary"), "decontaminate-blocks")
    numbers = [r[0] for r in made.select("block").orderBy("block").collect()]
    for k in numbers:
        yield pickle.loads(made.where(F.col("block") == k).first()["made"])
    if not numbers:
        yield TestBlock([], [], window)


FOUND = ("n_words", "hit_spans", "items")
_SPANS = "array<struct<begin:int,end:int,longest:int>>"
_SPANS_TYPE = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("begin", "end", "longest")]))
_NAMES_TYPE = T.ArrayType(T.StringType())
_SPAN = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("longest", pa.int32())])


def find_matches(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                 item_text_col: str = "text", window: int = WINDOW,
                 block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, hit_spans (array of word spans begin, end, longest match within) and items
    (ids, as strings, of the test items with an occurring window, sorted).

    A window is ``window`` consecutive words of an item; an item of fewer, but not none, is
    one window. Null and empty texts have no words; a very long text is searched whole, in about 20 bytes of memory a byte. Input
    columns named like a result column are replaced; repeated rows are treated alike, repeated items are found once each; an empty
    test set finds nothing. Blocks of the test set are searched one after the other: one block at a time is at the driver and the
    executors, and only row numbers and finds are stored between them.
    """
    docs = docs.drop(*FOUND)
    context = docs.sparkSession.sparkContext
    rest = _blocks(items, item_id_col, item_text_col, window, block_words)
    block, after = next(rest), next(rest, None)
    shared = context.broadcast(block)
    if after is None:
        return _searched(docs, text_col, shared)
    row, of = free_names([*docs.columns, *FOUND], "_row", "_of")
    lined = stored(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate-rows")
    finds = []
    while after is not None:      # the block before is done and released before the next one is shipped
        found = _searched(lined.select(row, text_col), text_col, shared).where(F.size("hit_spans") > 0)
        finds.append(stored(found.select(F.col(row).alias(of), "hit_spans", "items"), "decontaminate-finds"))
        shared.destroy()
        block, after = after, next(rest, None)
        shared = context.broadcast(block)
    earlier = finds[0]
    for f in finds[1:]:
        earlier = earlier.unionByName(f)
    more_spans, more_items = free_names([*lined.columns, *FOUND, of], "_spans", "_items")
    earlier = earlier.groupBy(of).agg(F.flatten(F.collect_list("hit_spans")).alias(more_spans),      # a list per block
                                      F.flatten(F.collect_list("items")).alias(more_items))
    both = _searched(lined, text_col, shared).join(earlier, F.col(row) == F.col(of), "left")
    spans = F.when(F.col(more_spans).isNull(), F.col("hit_spans")).otherwise(_merged(F.concat("hit_spans", F.col(more_spans))))
    names = F.array_sort(F.array_distinct(F.concat("items", F.coalesce(F.col(more_items), F.array().cast("array<string>")))))
    return both.select(*(F.col(f"`{c}`") for c in docs.columns), "n_words", spans.alias("hit_spans"), names.alias("items"))


def _merged(spans: Column) -> Column:
    """Overlapping or touching spans as one, its longest match the longest of theirs."""
    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        one = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], s["end"]).alias("end"),
                       F.greatest(last["longest"], s["longest"]).alias("longest"))
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(one))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= s["begin"]), grown).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(_SPANS), add)


def _searched(docs: DataFrame, text_col: str, shared) -> DataFrame:
    """``docs`` with what the block finds."""
    schema = extended(docs.schema, n_words="long", hit_spans=_SPANS_TYPE, items=_NAMES_TYPE)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = shared.value.ready()
        for batch in batches:
            buf, off = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            for a, b in steps(off):
                yield _search_step(batch.slice(a, b - a), buf[off[a]: off[b]], off[a: b + 1] - off[a], test)

    return docs.mapInArrow(searched, schema)


def _search_step(part: pa.RecordBatch, buf: np.ndarray, off: np.ndarray, test: TestBlock) -> pa.RecordBatch:
    words = Words(buf, off, test.seed)
    pos, length, window = test.search(words)
    longest = test.longest(words, pos, window)
    doc_off = words.first
    doc = np.searchsorted(doc_off, pos, "right") - 1
    spans: list[list] = [[] for _ in range(part.num_rows)]
    names: list[list] = [[] for _ in range(part.num_rows)]
    order = np.lexsort((pos, doc))
    doc, pos, length, window, longest = (x[order] for x in (doc, pos, length, window, longest))
    cuts = np.r_[np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]), len(doc)] if len(doc) else np.zeros(1, int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        d = int(doc[a])
        begin, end = merged_spans(pos[a:b] - doc_off[d], pos[a:b] + length[a:b] - doc_off[d])
        in_span = np.searchsorted(begin, pos[a:b] - doc_off[d], "right") - 1
        best = np.zeros(len(begin), np.int64)
        np.maximum.at(best, in_span, longest[a:b])
        spans[d] = [{"begin": x, "end": y, "longest": z} for x, y, z in zip(begin.tolist(), end.tolist(), best.tolist(), strict=True)]
        names[d] = sorted(test.items_of(np.unique(window[a:b])))
    columns = [*part.columns, pa.array(np.diff(doc_off), pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array(names, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *FOUND])


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda x, s: x + (s["end"] - s["begin"]).cast("long"))
    return found.select(
        id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without an occurrence of any test window, columns as before."""
    return find_matches(docs, items, **options).where(F.size("hit_spans") == 0).select(*docs.columns)

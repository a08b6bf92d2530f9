"""Language ID with a bit-sliced Bloom filter of n-grams.

Every slot of the filter is a mask with one bit per language. A 4-gram sets, in each of its slots, the bits
of the languages that have it; the AND of its slots gives all languages that contain it at once. A
text's votes are the popcounts per language, corrected for the false positives expected from the
filter's fill, and the most votes decide.

A language has an n-gram when at least ``least_docs`` of its sampled documents have it and its share of documents is
no less than a quarter of the greatest share any language has: a passage quoted from another
language does not make its n-grams part of this one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import extended, steps, stored, text_bytes

GRAM = 4
SLOTS = 1 << 21
HASHES = 3
MOST_LABELLED = 20_000     # bound on the labelled rows that fit the filter (about; chosen by a hash)
UNDETERMINED = "und"
PART = 1 << 20             # code points of a long text that are looked up at a time
_STEP = np.random.default_rng(20240604).integers(1, 1 << 62, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    """For every code point: is it a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Model(NamedTuple):
    languages: list[str]
    slots: np.ndarray          # (SLOTS, words of 64 languages)
    false_rate: np.ndarray     # per language
    usual: int                 # the language with the most sampled documents


def grams_of(texts: list[str], framed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each n-gram, its text, letters of each text) of lower-cased texts.

    All that is not a letter counts as a space; a text is framed by spaces; n-grams of spaces only are left out.
    """
    low = [f" {t.lower()}  " for t in texts] if framed else texts
    size = np.array([len(t) for t in low], np.int64)
    cps = np.frombuffer("".join(low).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    letter = _is_letter()[cps]
    doc = np.repeat(np.arange(len(texts)), size)
    letters = np.bincount(doc[letter], minlength=len(texts))
    value = np.where(letter, cps, 32).astype(np.uint64)
    n = max(len(value) - GRAM + 1, 0)
    h = np.zeros(n, np.uint64)
    some = np.zeros(n, bool)
    for k in range(GRAM):
        h = (h ^ value[k: n + k]) * _STEP[0]
        h ^= h >> np.uint64(29)
        some |= letter[k: n + k]
    ok = np.flatnonzero(some & (doc[:n] == doc[GRAM - 1:][:n]))
    return h[ok], doc[ok], letters


def _parts(text: str, most: int) -> Iterator[tuple[np.ndarray, int]]:
    """(n-gram hashes, letters) of the parts of a long text; n-grams across a cut are those of the part before."""
    low = f" {text.lower()}  "      # once: a part would not know what its last letter is followed by
    starts = len(low) - GRAM + 1
    for at in range(0, starts, most):
        h, _, _ = grams_of([low[at: at + most + GRAM - 1]], framed=False)
        yield h, sum(c.isalpha() for c in (low[at: at + most] if at + most < starts else low[at:]))


def _slots(h: np.ndarray, k: int, slots: int) -> np.ndarray:
    return ((h * _STEP[k + 1]) >> np.uint64(20)).astype(np.int64) % slots


def _text_steps(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, list[str]]]:
    _, off = text_bytes(column)
    for a, b in steps(off, most):
        yield a, b, [t or "" for t in column.slice(a, b - a).to_pylist()]


def fit(docs: DataFrame, held_out, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        most: int = MOST_LABELLED, least_docs: int = 3, slots: int = SLOTS) -> Model:
    """The filter of the languages of labelled rows outside ``held_out`` (about ``most`` of them).

    Of rows that repeat an id with a language the least text counts; null texts have no n-grams; long texts count like any other.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & ~held_out)
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}      # a row per language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((slots, 1), np.uint64), np.zeros(0), 0)
    # every language keeps at least its share of the bound, so that a rare one is learned too
    share = F.lit(0.0)
    per = max(1, most // len(languages))
    rates = {name: min(1.0, per / n) for name, n in sizes.items()}
    for name, rate in rates.items():
        share = F.when(F.col(lang_col) == name, F.lit(rate)).otherwise(share)
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 30)) < share * (1 << 30)
    sample = labelled.where(part).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
                                         F.col(id_col).alias("id"))
    # one text for each id and language: rows that repeat an id do not enlarge the sample
    sample = stored(sample.groupBy("id", "lang").agg(F.min("text").alias("text")).select("lang", "text"), "language-sample")
    number = {name: k for k, name in enumerate(languages)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for a, b, texts in _text_steps(batch.column(1)):
                if len(texts) == 1 and len(texts[0]) > PART:
                    h = np.zeros(0, np.uint64)
                    for part, _ in _parts(texts[0], PART):
                        h = np.union1d(h, part)
                    doc = np.zeros(len(h), np.int64)
                else:
                    h, doc, _ = grams_of(texts)
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                once = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
                h, own = h[once], code[a:b][doc[once]]
                order = np.lexsort((own, h))
                h, own = h[order], own[order]
                first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])]) if len(h) else np.zeros(0, int)
                n = np.diff(np.r_[first, len(h)])
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(own[first].astype(np.int32)),
                                                  pa.array(n.astype(np.int64))], names=["gram", "lang", "n"])

    sampled = {r[0]: r[1] for r in sample.groupBy("lang").count().collect()}
    docs_of = F.lit(1.0)
    for name, n in sampled.items():
        docs_of = F.when(F.col("lang") == number[name], F.lit(float(n))).otherwise(docs_of)
    grams = (sample.mapInArrow(counted, "gram long, lang int, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
             .where(F.col("n") >= least_docs).withColumn("share", F.col("n") / docs_of)
             .groupBy("gram").agg(F.collect_list(F.struct("lang", "share")).alias("own"), F.max("share").alias("top"))
             .select("gram", F.explode("own").alias("one"), "top").where(F.col("one.share") * 4 >= F.col("top"))
             .select("gram", F.col("one.lang").alias("lang")))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            lang = batch.column(1).to_numpy().astype(np.int64)
            place = np.concatenate([_slots(h, k, slots) for k in range(HASHES)])
            lang = np.tile(lang, HASHES)
            word, bit = lang // 64, np.uint64(1) << (lang % 64).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(word.astype(np.int32)), pa.array(bit.view(np.int64))],
                                             names=["slot", "word", "mask"])

    masks = (grams.mapInArrow(placed, "slot long, word int, mask long").groupBy("slot", "word")
             .agg(F.bit_or("mask").alias("mask")))
    table = np.zeros((slots, -(-len(languages) // 64)), np.uint64)
    got = masks.toPandas()                                     # at most one row per slot and 64 languages
    table[got["slot"], got["word"]] = got["mask"].to_numpy(np.int64).view(np.uint64)
    fill = np.array([(table[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).mean() for k in range(len(languages))])
    usual = max(range(len(languages)), key=lambda k: sizes[languages[k]])
    return Model(languages, table, fill ** HASHES, usual)


def _hits(model: Model, h: np.ndarray, doc: np.ndarray, n_texts: int) -> np.ndarray:
    """Raw hits per text and language."""
    mask = model.slots[_slots(h, 0, len(model.slots))]
    for k in range(1, HASHES):
        mask = mask & model.slots[_slots(h, k, len(model.slots))]
    out = np.zeros((n_texts, len(model.languages)))
    for k in range(len(model.languages)):
        out[:, k] = np.bincount(doc[(mask[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).astype(bool)], minlength=n_texts)
    return out


def votes(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(corrected votes per text and language, n-grams per text, letters per text); a long text alone is read in parts."""
    if len(texts) == 1 and len(texts[0]) > PART:
        hits, n, letters = np.zeros((1, len(model.languages))), np.zeros(1), np.zeros(1, np.int64)
        for h, some in _parts(texts[0], PART):
            hits += _hits(model, h, np.zeros(len(h), np.int64), 1)
            n += len(h)
            letters += some
    else:
        h, doc, letters = grams_of(texts)
        hits, n = _hits(model, h, doc, len(texts)), np.bincount(doc, minlength=len(texts)).astype(float)
    rate = model.false_rate[None, :]
    return np.maximum(0, hits - n[:, None] * rate) / (1 - np.minimum(rate, 0.99)), n, letters


RESULT = ("lang_pred", "lang_score", "lang_votes")


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, lang_score (0 to 1: the winner's votes per n-gram, times its lead over the second) and
    lang_votes (the winner's corrected votes; 0 where no n-gram of any learned language is found).

    Null texts and texts without a letter are ``und`` with score 0; a text that no n-gram of any
    language fits gets the most frequent language with score 0; ties go to the first name. Input
    columns named like a result column are replaced.
    """
    docs = docs.drop(*RESULT)
    shipped = docs.sparkSession.sparkContext.broadcast(model)      # bounded by the number of slots

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        names = np.array([*model.languages, UNDETERMINED], object)
        for batch in batches:
            for a, b, texts in _text_steps(batch.column(batch.schema.get_field_index(text_col))):
                if not model.languages:
                    best, score, top = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts))
                else:
                    got, n, letters = votes(model, texts)
                    best = got.argmax(axis=1)
                    top = got.max(axis=1)
                    second = np.partition(got, -2, axis=1)[:, -2] if got.shape[1] > 1 else np.zeros(len(texts))
                    score = np.where(top > 0, np.minimum(1, top / np.maximum(n, 1)) * (top - second) / np.maximum(top, 1e-9), 0)
                    best = np.where(top > 0, best, model.usual)
                    best = np.where(letters > 0, best, len(model.languages))
                    score = np.where(letters > 0, score, 0)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(top, pa.float64())],
                    names=[*part.schema.names, *RESULT])

    return docs.mapInArrow(judged, extended(docs.schema, lang_pred="string", lang_score="double", lang_votes="double"))

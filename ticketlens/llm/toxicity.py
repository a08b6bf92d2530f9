"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text.

Texts are lower-cased and folded one code point for one (homoglyphs, digit and sign substitutions), so a match's place in the
folded text is its place in the text, where word boundaries are looked up. Lexicon entries are words, or stems that a word
starts with (``stem*``); their weights are log odds learned from labelled rows, entries whose odds could be
chance are left out. A word of an exception phrase does not count. The weights found are normalised by length and a logistic
curve over both makes the score.

Fitting reads at most about ``MOST_LABELLED`` labelled ids, one text of each; the weights a fitting row is calibrated with leave that
row out. Every entry and exception that passes its test is kept, so their number is bounded by that sample's texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import free_names, rate_sample, stored

MOST_LABELLED = 20_000     # bound on the labelled rows used for fitting (about; chosen by a hash)
MOST_ENTRIES = 5_000_000   # entries and exceptions; more is an error, none is left out
LEAST_DOCS = 4             # toxic rows an entry must occur in
LEAST_ODDS = 1.5           # lower bound of an entry's log odds
STEMS = range(3, 10)       # lengths of stems

#: Look-alike letters and the substitutions of digits and signs for letters.
HOMOGLYPHS = ("аa", "еe", "оo", "рp", "сc", "уy", "хx", "іi", "ѕs", "ԁd", "һh", "ոn", "ѵv", "кk", "тt", "мm", "вb", "нh",
              "αa", "εe", "ιi", "κk", "νv", "οo", "ρp", "τt", "υu", "χx", "ɑa", "ɡg", "ⅰi", "ⅼl", "０o", "１i")
SUBSTITUTIONS = ("0o", "1i", "3e", "4a", "5s", "7t", "@a", "$s")
_FOLD = str.maketrans({p[0]: p[1] for p in HOMOGLYPHS + SUBSTITUTIONS})
_WORD = re.compile(r"[\w@$]+")


class Lexicon(NamedTuple):
    entries: dict[str, tuple[int, int]]     # entry → (toxic rows, other rows) it occurs in
    exceptions: frozenset[str]              # two neighbouring folded words
    toxic: int
    other: int
    curve: tuple[float, ...]                # of 1, log(1 + weight), weight per word

    def weight(self, entry: str, without: int | None = None) -> float:
        """Log odds of an entry; ``without``: as if one row of that label did not exist."""
        a, b = self.entries[entry]
        p, n = self.toxic, self.other
        if without is not None:
            a, b, p, n = (a - 1, b, p - 1, n) if without else (a, b - 1, p, n - 1)
        return max(0.0, log_odds(a, b, p, n)[1])


def log_odds(a: float, b: float, toxic: int, other: int) -> tuple[float, float]:
    """(log odds, its lower bound of two standard errors)."""
    odds = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (other + 1))
    low = odds - 2 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    return float(odds), float(odds if low >= LEAST_ODDS else 0.0)


def folded(text: str) -> tuple[str, str]:
    """(lower-cased text, its folded form), place by place alike."""
    low = text.lower()
    return low, low.translate(_FOLD)


def _entries(text: str) -> set[str]:
    out = set()
    for w in {w.translate(_FOLD) for w in _WORD.findall(text.lower())}:
        if len(w) >= STEMS[0]:
            out.add(w)
            out.update(w[:n] + "*" for n in STEMS if n < len(w))
    return out


def automaton(entries) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    by_word: dict[str, list[str]] = {}
    for e in entries:
        by_word.setdefault(e.rstrip("*"), []).append(e)
    for word, own in by_word.items():
        found.add_word(word, (len(word), own))
    if by_word:
        found.make_automaton()
    return found


def matches(find: ahocorasick.Automaton, text: str, exceptions=frozenset()) -> list[tuple[str, str, str]]:
    """(entry, phrase with the word before, phrase with the word after) per matched word: the longest entry of a word."""
    if not len(find):
        return []
    low, fold = folded(text)
    at: dict[int, str] = {}
    for last, (size, own) in find.iter(fold):
        start = last - size + 1
        if start and low[start - 1].isalnum():
            continue
        open_ = last + 1 == len(low) or not low[last + 1].isalnum()
        for e in own:
            if (e[-1] == "*" or open_) and len(e) > len(at.get(start, "")):
                at[start] = e
    out = []
    for start, e in at.items():
        end = _WORD.match(low, start)
        end = end.end() if end else start + len(e)
        word = fold[start:end]
        before = _word_before(fold, start)
        after = _WORD.search(fold, end)
        phrases = (" ".join([*before, word]), f"{word} {after[0]}" if after else word)
        if not exceptions.intersection(phrases):
            out.append((e, *phrases))
    return out


def _word_before(fold: str, start: int) -> list[str]:
    """The whole word before a place, if there is one."""
    end = start
    while end and not _WORD.match(fold[end - 1]):
        end -= 1
    begin = end
    while begin and _WORD.match(fold[begin - 1]):
        begin -= 1
    return [fold[begin:end]] if begin < end else []


def _counts(seen: Counter) -> pd.DataFrame:
    return pd.DataFrame({"entry": pd.Series(list(seen), dtype=object), "n": np.array(list(seen.values()), np.int64)})


def _features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.c_[np.ones(len(weight)), np.log1p(weight), 10 * weight / (words + 10)]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - p) - ridge * beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out, most: int, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(text, label) of about ``most`` labelled ids outside ``held_out``, written once.

    An id that labels repeat has its greatest label, one that documents repeat its least text, so the bound is on rows; a null
    text is empty, a null id or label is left out, and a very long text is one text like any other.
    """
    own = (labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out)
           .groupBy(id_col).agg(F.max(label).cast("int").alias("label")))
    some = rate_sample(own, id_col, most, own.count())
    some = stored(some, "labels")
    n = some.count()
    if n <= 2 * most:      # two numbers a row; a hash that deals ids unevenly is left to an ordinary join
        some = F.broadcast(some)
    found = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(some, id_col)
    return stored(found.groupBy(id_col).agg(F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label"), "labelled")


def fit(docs: DataFrame, labels: DataFrame, held_out, label: str = "toxic", most: int = MOST_LABELLED) -> Lexicon:
    """The lexicon, its exceptions and the curve, from labelled rows outside ``held_out``."""
    sample = labelled_sample(docs, labels, label, held_out, most)
    sizes = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    empty = Lexicon({}, frozenset(), toxic, other, (float(np.log((toxic + 0.5) / (other + 0.5))), 0.0, 0.0))
    if not toxic or not other:
        return empty

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                seen.update(_entries(text))
            if len(seen) > 500_000:
                yield _counts(seen)
                seen.clear()
        yield _counts(seen)

    rows = (sample.where("label = 1").select("text").mapInPandas(counted, "entry string, n long").groupBy("entry")
            .agg(F.sum("n").alias("n")).where(F.col("n") >= _least_count(toxic, other)))
    candidates = {r[0]: r[1] for r in _all(rows)}
    shipped = docs.sparkSession.sparkContext.broadcast(frozenset(candidates))

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                seen.update(_entries(text) & shipped.value)
        yield _counts(seen)

    clean = {r[0]: r[1] for r in sample.where("label = 0").select("text").mapInPandas(others, "entry string, n long")
             .groupBy("entry").agg(F.sum("n").alias("n")).collect()}
    entries = _lexicon(candidates, clean, toxic, other)
    lexicon = Lexicon(entries, frozenset(), toxic, other, empty.curve)
    shipped_lexicon = docs.sparkSession.sparkContext.broadcast(lexicon)

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, seen = automaton(shipped_lexicon.value.entries), {0: Counter(), 1: Counter()}
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["label"], strict=True):
                seen[int(bool(y))].update({p for _, a, b in matches(find, text) for p in (a, b) if " " in p})
        keys = list({*seen[0], *seen[1]})
        yield pd.DataFrame({"phrase": pd.Series(keys, dtype=object),
                            "toxic": np.array([seen[1][k] for k in keys], np.int64),
                            "other": np.array([seen[0][k] for k in keys], np.int64)})

    spared = (sample.mapInPandas(phrases, "phrase string, toxic long, other long").groupBy("phrase")
              .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
              .where(f"other >= {LEAST_DOCS} and other > 4 * toxic"))
    spared = _all(spared)
    lexicon = lexicon._replace(exceptions=frozenset(r[0] for r in spared))
    shipped_both = docs.sparkSession.sparkContext.broadcast(lexicon)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = shipped_both.value
        find = automaton(lexicon.entries)
        for pdf in batches:
            weight = [sum(lexicon.weight(e, int(y)) for e, *_ in matches(find, t, lexicon.exceptions))
                      for t, y in zip(pdf["text"], pdf["label"], strict=True)]
            yield pd.DataFrame({"weight": np.array(weight, float), "words": [float(t.count(" ") + 1) for t in pdf["text"]],
                                "label": pdf["label"].astype("int64")})

    # three numbers for each row of the bounded sample
    got = sample.mapInPandas(measured, "weight double, words double, label long").toPandas()
    curve = _logistic(_features(got["weight"].to_numpy(), got["words"].to_numpy()), got["label"].to_numpy(float))
    return lexicon._replace(curve=tuple(curve.tolist()))


def _least_count(toxic: int, other: int) -> int:
    """Toxic rows from which an entry of no other row passes the test of odds: entries below it cannot."""
    n = LEAST_DOCS
    while n <= toxic and log_odds(n, 0, toxic, other)[1] <= 0:
        n += 1
    return n


def _all(rows: DataFrame) -> list:
    """Rows for the driver, an error where they are more than the lexicon can have."""
    found = rows.limit(MOST_ENTRIES + 1).collect()
    if len(found) > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} entries in the labelled sample")
    return found


def _lexicon(candidates: dict[str, int], clean: dict[str, int], toxic: int, other: int) -> dict[str, tuple[int, int]]:
    """Entries whose odds are sure. A stem gives way to a longer entry found in the same toxic rows, then an entry to a
    stem of it that is as clean."""
    sure = {e: (a, clean.get(e, 0)) for e, a in candidates.items() if log_odds(a, clean.get(e, 0), toxic, other)[1] > 0}
    loose = set()
    for e, (a, b) in sure.items():
        word = e.rstrip("*")
        stems = [s for n in STEMS if n < len(word) + (e[-1] != "*") and (s := word[:n] + "*") in sure]
        loose.update(s for s in stems if sure[s][0] == a and sure[s][1] >= b)
    sure = {e: n for e, n in sure.items() if e not in loose}
    out: dict[str, tuple[int, int]] = {}
    ranked = sorted(sure, key=lambda e: (len(e.rstrip("*")), e[-1] != "*", e))
    for e in ranked:
        a, b = sure[e]
        stem = e.rstrip("*")
        above = next((out[s] for n in range(len(stem), STEMS[0] - 1, -1) if (s := stem[:n] + "*") in out), None)
        if above is None or b * above[0] < a * above[1]:
            out[e] = (a, b)
    return out


RESULT = ("toxic_weight", "toxic_score")


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """``docs`` with toxic_weight (sum over matched words) and toxic_score (0 to 1).

    Null and empty texts have weight 0 and the score of a text without matches. Rows are scored one by one, so
    repeated rows get the same; input columns named like a result column are replaced.
    """
    docs = docs.drop(*RESULT)
    shipped = docs.sparkSession.sparkContext.broadcast(lexicon)      # what the bounded sample has

    @F.pandas_udf("toxic_weight double, toxic_score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lexicon = shipped.value
        find = automaton(lexicon.entries)
        weights = {e: lexicon.weight(e) for e in lexicon.entries}
        for texts in batches:
            texts = [t or "" for t in texts]
            weight = np.array([sum(weights[e] for e, *_ in matches(find, t, lexicon.exceptions)) for t in texts], float)
            words = np.array([t.count(" ") + 1 for t in texts], float)
            line = _features(weight, words) @ np.array(lexicon.curve)
            yield pd.DataFrame({"toxic_weight": weight, "toxic_score": 1 / (1 + np.exp(-np.clip(line, -30, 30)))})

    keep = docs.columns
    found, = free_names([*keep, *RESULT], "scored")
    return (docs.withColumn(found, scored(F.col(f"`{text_col}`").cast("string")))
            .select(*(F.col(f"`{c}`") for c in keep), *(F.col(f"{found}.{n}").alias(n) for n in RESULT)))

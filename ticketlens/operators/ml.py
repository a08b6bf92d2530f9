"""Text classifiers with Spark ML: TF-IDF features, weighted logistic regression,
fold-averaged isotonic calibration, cross-validation and the benchmark models.

Scikit-learn parity notes (stated, not bit-equal): smooth idf is ``ln((1+n)/(1+df)) + 1``
while Spark's ``IDF`` gives ``ln((n+1)/(df+1))``, so the fitted idf vector is shifted by
one through ``ElementwiseProduct``; an L2 penalty with ``C = 1`` equals ``regParam =
1 / Σweights`` with ``standardization = False``; "balanced" weights are
``n / (k · n_class)``.

Texts are tokenised once: a stored table of terms serves the vocabulary, every fold and every target.  Term totals
(occurrences, documents) are summed per fold in one pass, and what a fold trains on is the total minus the fold's own share;
no fold tokenises or counts again.  A vocabulary brings at most ``vocab_size`` terms to the driver, and calibration
fits at most ``CALIBRATION_CELLS`` weighted points per class, whatever the number of held-out rows.
"""

from __future__ import annotations

import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import (
    CountVectorizerModel, ElementwiseProduct, IndexToString, Normalizer, SQLTransformer, StringIndexer, StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.regression import IsotonicRegression
from pyspark import keyword_only
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..functions.names import free_names
from ..session import shared_path
from . import evaluation as EV
from . import regression as LR
from . import sampling as SM

TOKEN_PATTERN = r"\b\w\w+\b"   # words of two or more word characters
WORD_START, WORD = r"(?<!\S)", r"\S+"   # in words joined by spaces
# Bound on the labelled rows that fit a model, where a job asks for one (drawn by ``sampling.hash_sample``): none, all rows are fitted.
MAX_FIT_ROWS: int | None = None
ROWS_PER_FIT_TASK = 200_000
LR_TOL = 1e-4                   # the lbfgs stopping tolerance of the scikit-learn models
SKETCHED_TERMS = 1_000_000      # terms that the frequency sketch of a vocabulary tracks
SKETCH_FROM = 10_000_000_000   # occurrences from which candidates come from a sketch: below, counting batches costs less; the same vocabulary either way
FREQUENT_TERMS = 50_000         # of a vocabulary without a bound, terms broadcast to the rows; a rarer one is in less than this part of all entries
NUMBERS_AT_ONCE = 2_000_000     # coefficients of the models that are fitted in the same passes; the driver holds some thirty times as many
CALIBRATION_CELLS = 4096        # weighted points that a calibration curve is fitted on, at most


# ----------------------------------------------------------------------------- features

@F.pandas_udf(VectorUDT())
def sublinear_tf(v: pd.DataFrame) -> pd.DataFrame:
    """``1 + ln(tf)`` on the non-zeros of each count vector, in Arrow batches.  The vector
    arrives in its storage form (``type, size, indices, values``); only ``values`` change."""
    sizes = np.array([len(a) for a in v["values"]], dtype=np.int64)
    x = np.concatenate([np.asarray(a, dtype=float) for a in v["values"]]) if len(v) else np.zeros(0)
    x = np.where(x > 0, 1.0 + np.log(np.where(x > 0, x, 1.0)), 0.0)      # one log over the whole batch
    values = np.split(x, np.cumsum(sizes)[:-1]) if len(v) else []
    return pd.DataFrame({"type": v["type"], "size": v["size"], "indices": v["indices"],
                         "values": pd.Series(list(values), index=v.index, dtype=object)})


class SublinearTF(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage applying ``sublinear_tf``; persistable with the pipeline."""

    @keyword_only
    def __init__(self, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), sublinear_tf(F.col(self.getInputCol())))


class CharWbTerms(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage producing in-word character 3–5-grams (``char_wb_ngrams``), natively.

    The column comes out of ``evaluated_once`` (a one-element explode): with the higher-order
    functions in a plain projection, Catalyst would collapse it into the projection of the
    Python sublinear-tf stage downstream, which Spark then cannot extract ("Cannot evaluate
    expression").  Behind the generator the Python stage reads a plain column."""

    @keyword_only
    def __init__(self, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(),
                                  TX.evaluated_once(char_wb_ngrams(F.col(self.getInputCol()))))


def char_wb_ngrams(text: str | Column, n_min: int = 3, n_max: int = 5) -> Column:
    """Character n-grams inside words: lower-case, split on whitespace, pad each word with
    one space on both sides, all n-grams for n in ``n_min..min(n_max, len(padded))``."""
    t = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.flatten(F.transform(
        F.sequence(F.lit(n_min), F.least(F.lit(n_max), F.length(w))),
        lambda n: F.transform(F.sequence(F.lit(0), F.length(w) - n),
                              lambda o: F.substring(w, o + 1, n))))))


@dataclass(frozen=True)
class TfidfSpec:
    input_col: str = "text"
    output_col: str = "features"
    analyzer: str = "word"          # "word" or "char_wb"
    ngram_max: int = 2              # word n-grams 1..ngram_max
    char_range: tuple[int, int] = (3, 5)
    vocab_size: int | None = 40_000  # None: as many as the terms that reach min_df, counted first
    min_df: float = 1.0
    sublinear: bool = False


def _terms_stages(spec: TfidfSpec, prefix: str) -> list[Transformer]:
    terms = f"{prefix}_terms"
    if spec.analyzer == "char_wb":
        return [CharWbTerms(inputCol=spec.input_col, outputCol=terms)]
    # SQL expressions: ``RegexTokenizer`` and ``NGram`` would turn every list of words into JVM objects and back
    toks = f"{prefix}_tok"
    text = f"lower(coalesce(`{spec.input_col}`, raise_error('a text is null')))"
    words = f"SELECT *, regexp_extract_all({text}, r'{TOKEN_PATTERN}', 0) AS {toks} FROM __THIS__"
    # runs of n words: a capture at the start of every word of the joined words, which hold no space
    grams = [toks, *(f"regexp_extract_all(array_join({toks}, ' '), r'{WORD_START}(?=({' '.join([WORD] * n)}))', 1)" for n in range(2, spec.ngram_max + 1))]
    return [SQLTransformer(statement=f"SELECT *, concat({', '.join(grams)}) AS {terms} FROM ({words})")]


def tokenised(df: DataFrame, spec: TfidfSpec = TfidfSpec(), prefix: str = "_tf") -> DataFrame:
    """``df`` with the column ``<prefix>_terms``; nothing else of the feature pipeline."""
    kept = df.columns
    terms = f"{prefix}_terms"
    return Pipeline(stages=_terms_stages(spec, prefix)).fit(df).transform(df).select(*[c for c in kept if c != terms], terms)


def term_totals(terms: DataFrame, terms_col: str, parts: dict[str, Column] | None = None, only: DataFrame | None = None) -> DataFrame:
    """``(term, tf, df)`` over all rows: occurrences, and rows that have the term; with ``parts`` (name → condition on a
    row) also ``tf_<name>, df_<name>`` over the rows that meet it.  One pass whatever the number of parts: Arrow batches of rows are
    counted in the tasks, and their distinct terms are summed.  ``only``: a table of the terms to count (at most ``SKETCHED_TERMS``).
    """
    parts = parts or {}
    d = terms.select(F.col(terms_col).alias("_ts"), *[F.coalesce(c, F.lit(False)).alias(f"_in{i}") for i, c in enumerate(parts.values())])
    names = ["tf", "df", *(f"{x}{i}" for i in range(len(parts)) for x in ("tf", "df"))]
    e = d.mapInArrow(_batch_totals(), "term string, " + ", ".join(f"{x} long" for x in names))
    if only is not None:      # bounded by the sketch
        e = e.join(F.broadcast(only), "term")
    out = ["tf", "df", *(f"{x}_{name}" for name in parts for x in ("tf", "df"))]
    return e.groupBy("term").agg(*[F.sum(x).alias(y) for x, y in zip(names, out, strict=True)])


def _batch_totals():
    """Occurrences and rows of every distinct term of a batch ``(terms, in a part, ...)``, over the batch and over each part: a
    function that travels to the tasks by value."""

    def counted(batches):
        for batch in batches:
            lists = batch.column(0)
            coded = pc.list_flatten(lists).dictionary_encode(null_encoding="encode")
            n = len(coded.dictionary)
            if not n:
                continue
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            once = np.unique(row * n + code)      # a row and a term it has
            sums = [np.bincount(code, minlength=n), np.bincount(once % n, minlength=n)]
            for part in batch.columns[1:]:
                inside = part.to_numpy(zero_copy_only=False)
                sums += [np.bincount(code[inside[row]], minlength=n), np.bincount((once % n)[inside[once // n]], minlength=n)]
            names = [x if i < 0 else f"{x}{i}" for i in range(-1, len(batch.columns) - 1) for x in ("tf", "df")]
            yield pa.RecordBatch.from_arrays([coded.dictionary, *(pa.array(x.astype(np.int64)) for x in sums)], ["term", *names])

    return counted


def _sketched(terms: DataFrame, terms_col: str) -> tuple[DataFrame, int]:
    """Terms that a frequency sketch of all occurrences returns, with its counts, and the occurrences above which no term is missing.

    Sketches of groups of tasks are combined.  A sketch of M counters is off by at most 3.5 / M of all occurrences and returns every
    term that occurs more than twice that; where it has met no more terms than it tracks, its counts are exact and add up to all.
    """
    spread = terms.select(F.explode(terms_col).alias("term"), (F.spark_partition_id() % 16).alias("_g"))
    states = spread.groupBy("_g").agg(F.expr(f"approx_top_k_accumulate(term, {SKETCHED_TERMS})").alias("s"), F.count(F.lit(1)).alias("n"))
    one = states.agg(F.expr(f"approx_top_k_combine(s, {SKETCHED_TERMS})").alias("s"), F.sum("n").alias("n"))
    found = _kept(one.select("n", F.inline(F.expr(f"approx_top_k_estimate(s, {SKETCHED_TERMS})"))))
    row = found.agg(F.max("n").alias("n"), F.sum("count").alias("seen")).first()
    counters = 1 << math.ceil(math.log2(SKETCHED_TERMS / 0.75))
    exact = row["n"] is not None and row["n"] == row["seen"]
    return found.select(F.col("item").alias("term")), 0 if exact else 2 * math.ceil(3.5 * (row["n"] or 0) / counters)


def vocabulary_totals(terms: DataFrame, terms_col: str, spec: TfidfSpec, parts: dict[str, Column] | None = None) -> DataFrame:
    """``term_totals`` of every term that a vocabulary of ``spec`` can hold, over all rows, over each part and over the rest of each
    part; written once.

    Of a large table a frequency sketch names the candidates, and only those are counted exactly, so the shuffle is not one row per
    distinct term and task.  Where the last term of some vocabulary is not above the sketch's error, all terms are counted.
    """
    n = terms.agg(F.sum(F.size(terms_col))).first()[0] or 0 if spec.vocab_size is not None else 0
    if n > SKETCH_FROM:
        only, floor = _sketched(terms, terms_col)
        totals = _kept(term_totals(terms, terms_col, parts, only))
        views = [totals, *(f(totals, name) for name in parts or {} for f in (of_part, without_part))]
        if not floor or all(_separated(v, spec, floor) for v in views):
            return totals
    return _kept(term_totals(terms, terms_col, parts))


def _separated(totals: DataFrame, spec: TfidfSpec, floor: int) -> bool:
    """Is the last term of the vocabulary above ``floor`` occurrences?"""
    top = totals.where(F.col("df") >= max(spec.min_df, 1)).orderBy(F.col("tf").desc()).limit(spec.vocab_size)
    last = top.agg(F.min("tf").alias("tf"), F.count(F.lit(1)).alias("n")).first()
    return last["n"] == spec.vocab_size and last["tf"] > floor


def without_part(totals: DataFrame, name: str) -> DataFrame:
    """``(term, tf, df)`` of the rows outside a part: total minus the part's share."""
    return totals.select("term", (F.col("tf") - F.col(f"tf_{name}")).alias("tf"), (F.col("df") - F.col(f"df_{name}")).alias("df"))


def of_part(totals: DataFrame, name: str) -> DataFrame:
    return totals.select("term", F.col(f"tf_{name}").alias("tf"), F.col(f"df_{name}").alias("df"))


def weighting(totals: DataFrame, n: int, spec: TfidfSpec = TfidfSpec(), prefix: str = "_tf") -> PipelineModel:
    """Terms → counts (→ 1+ln) → smooth idf + 1 → L2, from ``(term, tf, df)`` over ``n`` rows: the ``vocab_size`` most
    frequent terms that ``min_df`` rows have (ties by term)."""
    least = spec.min_df if spec.min_df >= 1 else spec.min_df * n
    kept = totals.where((F.col("df") >= max(least, 1)) & (F.col("tf") > 0)).orderBy(F.col("tf").desc(), "term")
    rows = (kept if spec.vocab_size is None else kept.limit(spec.vocab_size)).select("term", "df").toPandas()
    if not len(rows):
        raise ValueError("no term is in as many rows as the vocabulary asks for")
    cv = _count_model(rows["term"].tolist(), f"{prefix}_terms", f"{prefix}_cnt")
    idf = np.log((n + 1.0) / (rows["df"].to_numpy(float) + 1.0)) + 1.0
    stages: list[Transformer] = [cv]
    tf_col = f"{prefix}_cnt"
    if spec.sublinear:
        stages.append(SublinearTF(inputCol=tf_col, outputCol=f"{prefix}_tf"))
        tf_col = f"{prefix}_tf"
    stages += [ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol=tf_col, outputCol=f"{prefix}_w"),
               Normalizer(p=2.0, inputCol=f"{prefix}_w", outputCol=spec.output_col)]
    return PipelineModel(stages=stages)


def _count_model(vocabulary: list[str], terms_col: str, out_col: str) -> CountVectorizerModel:
    """``CountVectorizerModel.from_vocabulary`` in one call: that one makes a call to the JVM for every term."""
    sep = "\x01"      # no term has it: tokens are word characters, n-grams are joined by spaces
    if any(sep in t or not t for t in vocabulary):
        return CountVectorizerModel.from_vocabulary(vocabulary, inputCol=terms_col, outputCol=out_col)
    jvm = SparkSession.active().sparkContext._jvm
    terms = jvm.org.apache.commons.lang3.StringUtils.split(sep.join(vocabulary), sep)
    model = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", terms)
    return model.setInputCol(terms_col).setOutputCol(out_col)


def _with_terms(spec: TfidfSpec, weights: PipelineModel, df: DataFrame, prefix: str = "_tf") -> PipelineModel:
    """The pipeline from texts on: tokenising, then ``weights``."""
    return PipelineModel(stages=[*Pipeline(stages=_terms_stages(spec, prefix)).fit(df).stages, *weights.stages])


@dataclass(frozen=True)
class TermTable:
    """Fitted weights of a vocabulary without a bound: stored tables ``(term, idf)``, never at the driver.  ``frequent`` holds
    fewer than ``FREQUENT_TERMS`` terms, those in the most rows; ``rare`` the others."""

    spec: TfidfSpec
    frequent: DataFrame
    rare: DataFrame


def _term_table(totals: DataFrame, n: int, spec: TfidfSpec) -> TermTable:
    least = spec.min_df if spec.min_df >= 1 else spec.min_df * n
    kept = totals.where((F.col("df") >= max(least, 1)) & (F.col("tf") > 0))
    top = kept.select("df").orderBy(F.col("df").desc()).limit(FREQUENT_TERMS)
    last = top.agg(F.min("df").alias("df"), F.count(F.lit(1)).alias("n")).first()
    if not last["n"]:
        raise ValueError("no term is in as many rows as the vocabulary asks for")
    cut = last["df"] if last["n"] == FREQUENT_TERMS else 0
    terms = kept.select("term", "df", (F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
    return TermTable(spec, terms.where(F.col("df") > cut).drop("df"), terms.where(F.col("df") <= cut).drop("df"))


def fit_tfidf(df: DataFrame, spec: TfidfSpec = TfidfSpec(), prefix: str = "_tf") -> PipelineModel | TermTable:
    """Fit terms → counts (→ 1+ln) → idf+1 → L2 as one PipelineModel: one pass over the texts.  A vocabulary without a bound
    grows with the rows and stays a table (``TermTable``)."""
    terms = tokenised(df.select(spec.input_col), spec, prefix).select(f"{prefix}_terms")
    if spec.vocab_size is not None:      # several passes
        terms = _kept(terms)
    n, totals = terms.count(), vocabulary_totals(terms, f"{prefix}_terms", spec)
    if spec.vocab_size is None:
        return _term_table(totals, n, spec)
    return _with_terms(spec, weighting(totals, n, spec, prefix), df, prefix)


def drop_internal(df: DataFrame, prefixes: tuple[str, ...] = ("_tf", "_tfw", "_tfc")) -> DataFrame:
    """Without the feature pipeline's own columns (a user's column is kept, whatever its name)."""
    return df.drop(*(f"{p}_{s}" for p in prefixes for s in ("terms", "tok", "cnt", "tf", "w", *(f"g{n}" for n in range(2, 10)))))


def _with_text(df: DataFrame, text_col: str) -> DataFrame:
    return df if text_col == "text" else df.withColumn("text", F.col(text_col))


# ----------------------------------------------------------------------------- classifier

def balanced_weights(df: DataFrame, label_col: str, labels: list[str], out_col: str = "_w") -> DataFrame:
    """``n / (k · n_class)`` per row.  ``labels`` is the fitted label index (already at the
    driver, and as large as the model's coefficient matrix), so the per-class counts are
    one partial aggregate of at most k rows, turned into a literal map: no join, no shuffle
    of the training rows."""
    rows = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_nc")).collect()
    if any(r[label_col] is None for r in rows):
        raise ValueError(f"{label_col!r} has null labels: drop or fill them before training")
    if len(rows) > len(labels):
        raise ValueError(f"{len(rows)} classes in {label_col!r}, the label index has {len(labels)}")
    n, k = sum(r["_nc"] for r in rows), len(rows)
    weights = {r[label_col]: n / (k * r["_nc"]) for r in rows}
    m = F.create_map(*[x for lab, w in weights.items() for x in (F.lit(lab), F.lit(float(w)))])
    return df.withColumn(out_col, m[F.col(label_col)])


@dataclass
class TextClassifier:
    """Fitted features + label index + (calibrated) logistic regression."""

    features: PipelineModel
    indexer: PipelineModel
    lr_models: list[LogisticRegressionModel]
    isotonic: list[list] | None
    labels: list[str]
    feature_col: str = "features"

    def transform(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """Adds ``prediction`` (label) and ``confidence`` (max probability); all input columns stay."""
        own = df.columns
        if text_col != "text" and "text" in own:
            df = df.withColumnRenamed("text", "_own_text")
        feats = drop_internal(self.features.transform(_with_text(df, text_col)))
        kept = [F.col("_own_text").alias("text") if c == "text" and text_col != "text" else F.col(c) for c in own]
        return self.scored(feats, kept)

    def scored(self, feats: DataFrame, kept: list) -> DataFrame:
        """The same for rows that have their features (column ``features``) already."""
        k = len(self.labels)
        if self.isotonic is None:
            scored = self.lr_models[0].setProbabilityCol("_prob").setRawPredictionCol("_raw") \
                .setPredictionCol("_pred").transform(feats)
            probs = vector_to_array("_prob")
        else:
            scored = feats
            fold_probs = []
            for f, (lr, isos) in enumerate(zip(self.lr_models, self.isotonic)):
                scored = lr.setRawPredictionCol(f"_raw{f}").setProbabilityCol(f"_p{f}") \
                    .setPredictionCol(f"_pr{f}").transform(scored).drop(f"_p{f}", f"_pr{f}")
                cal = []
                for c, iso in enumerate(isos):
                    scored = iso.setFeaturesCol(f"_raw{f}").setFeatureIndex(c).setPredictionCol(f"_c{f}_{c}") \
                        .transform(scored)
                    cal.append(F.col(f"_c{f}_{c}"))
                total = sum(cal[1:], cal[0])
                fold_probs.append([F.when(total > 0, x / total).otherwise(F.lit(1.0 / k)) for x in cal])
            avg = [sum((fp[c] for fp in fold_probs[1:]), fold_probs[0][c]) / len(fold_probs) for c in range(k)]
            probs = F.array(*avg)
        with_p = scored.withColumn("_parr", probs)
        best = F.array_max("_parr")
        idx = F.array_position("_parr", best) - 1
        lab = F.element_at(F.array(*[F.lit(x) for x in self.labels]), (idx + 1).cast("int"))
        return with_p.select(*kept, lab.alias("prediction"), best.alias("confidence"),
                             F.col("_parr").alias("probabilities"))


def same_terms(a: TextClassifier, b: TextClassifier) -> bool:
    """Do both models make the same terms of a text, in their first stage?"""
    first, other = a.features.stages[0], b.features.stages[0]
    return (isinstance(first, SQLTransformer) and isinstance(other, SQLTransformer) and first.getStatement() == other.getStatement()
            and all(isinstance(m.features.stages[1], CountVectorizerModel) for m in (a, b)))


def transform_both(df: DataFrame, a: TextClassifier, b: TextClassifier) -> DataFrame:
    """``df`` with ``prediction`` and ``confidence`` of ``a`` and ``prediction_b`` of ``b``, models with the ``same_terms`` of the column
    ``text``: the terms of a row are made once."""
    own = df.columns
    terms = a.features.stages[1].getInputCol()

    def scored(rows: DataFrame, model: TextClassifier, kept: list[str]) -> DataFrame:
        feats = PipelineModel(stages=model.features.stages[1:]).transform(rows.select(*kept, terms))
        return model.scored(feats, [F.col(c) for c in [*kept, terms]])

    first = scored(a.features.stages[0].transform(df), a, own).withColumnsRenamed({"prediction": "_pa", "confidence": "_ca"})
    both = scored(first, b, [*own, "_pa", "_ca"])
    return both.select(*own, F.col("_pa").alias("prediction"), F.col("_ca").alias("confidence"), F.col("prediction").alias("prediction_b"))


def _kept(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Written once under the shared folder and read back: every pass of an optimiser reads the
    table, nothing stays pinned in executor memory, a lost executor costs no refit."""
    path = shared_path(df.sparkSession, "training", uuid.uuid4().hex)
    df.write.options(**options or {}).parquet(path)
    return df.sparkSession.read.parquet(path)


def label_indexer(rows: DataFrame, label_col: str) -> tuple[PipelineModel, list[str]]:
    """Labels in order → 0..k-1, as a pipeline, and the labels."""
    labels = sorted((r[0] for r in rows.select(label_col).distinct().collect()), key=lambda x: (x is None, x))
    if labels and labels[-1] is None:
        raise ValueError(f"{label_col!r} has null labels: drop or fill them before training")
    model = StringIndexerModel.from_labels([str(x) for x in labels], inputCol=label_col, outputCol="_y")
    return PipelineModel(stages=[model]), [str(x) for x in labels]


def calibration_points(scores: DataFrame, keys: list[str], score: str = "score", hit: str = "hit",
                       cells: int = CALIBRATION_CELLS) -> DataFrame:
    """``(keys, cell, score, hits, n)``: rows summed by cells of the score's logistic curve, mean score, hits and rows of each.

    A mergeable summary: partial sums leave the tasks, at most ``cells`` rows per key are left.  The isotonic fit of the
    summary has, at the edge of every cell, running totals of fitted values within the rows of the largest
    cell (of those with more than one score) of the exact fit's: the summary's cumulative diagram is the exact one at the cells'
    edges, and between them hits rise by at most one a row.
    """
    z = F.col(score).cast("double")
    cell = F.least(F.floor(cells / (1 + F.exp(-z))), F.lit(cells - 1)).cast("int")
    return (scores.groupBy(*keys, cell.alias("cell"))
            .agg((F.sum(z) / F.count(z)).alias("score"), F.sum(F.col(hit).cast("double")).alias("hits"), F.count(F.lit(1)).alias("n")))


def isotonic_fit(points: DataFrame):
    """Monotone curve through summarised points ``(score, hits, n)``."""
    d = points.select(F.col("score").alias("_raw"), (F.col("hits") / F.col("n")).alias("_t"), F.col("n").cast("double").alias("_w"))
    return IsotonicRegression(featuresCol="_raw", labelCol="_t", weightCol="_w", isotonic=True).fit(d)


def fit_features(data: DataFrame, label_col: str, labels: list[str], features: PipelineModel, indexer: PipelineModel, balanced: bool = True,
                 max_iter: int = 300, calibrate: bool = True, folds: int = 5, seed: int = 42, id_col: str = "id",
                 parallelism: int = 5) -> TextClassifier:
    """Fit logistic regression on rows ``(id, label, features)``; see ``fit_classifier``."""
    data = indexer.transform(data)
    n = data.select(label_col).count()
    wide = _width(features)
    if not calibrate:
        data = data.select("features", "_y").withColumn("fold", F.lit(-1))
    else:
        data = SM.kfold_assign(data.select(id_col, label_col, "features", "_y"), label_col, id_col, folds, seed)
    blocks = _kept(LR.to_blocks(data).repartition(data.sparkSession.sparkContext.defaultParallelism), {"parquet.block.size": str(LR.BLOCK_BYTES)})
    counts, entries = LR.label_counts(blocks)

    def fitted(some: list[int]):
        return LR.fit(blocks, len(labels), wide, some, counts, entries, balanced, max_iter, LR_TOL)

    if not calibrate:
        return TextClassifier(features, indexer, fitted([0]), None, labels)      # leaves no row out
    together = 1 if LR.is_alone(entries, len(labels)) else max(1, NUMBERS_AT_ONCE // (len(labels) * (wide + 1)))
    models = _parallel(fitted, [list(range(f, min(f + together, folds))) for f in range(0, folds, together)], _at_once(data.sparkSession, n, parallelism))
    models = [m for some in models for m in some]
    return TextClassifier(features, indexer, models, _calibration(blocks, models, len(labels), parallelism), labels)


def _width(features: PipelineModel) -> int:
    """Numbers of a row's ``features``."""
    return sum(len(s.vocabulary) for s in features.stages if isinstance(s, CountVectorizerModel))


def _calibration(blocks: DataFrame, models: list[LogisticRegressionModel], k: int, parallelism: int) -> list[list]:
    """One curve per fold and class, on the fold's held-out scores: all of them summed in one table of cells."""
    points = _kept(calibration_points(LR.held_scores(blocks, models), ["fold", "class"]))

    def curve(at):
        return isotonic_fit(points.where((F.col("fold") == at[0]) & (F.col("class") == at[1])))

    flat = _parallel(curve, [(f, c) for f in range(len(models)) for c in range(k)], parallelism)
    return [flat[f * k:(f + 1) * k] for f in range(len(models))]


def fit_classifier(train: DataFrame, label_col: str, spec: TfidfSpec = TfidfSpec(), balanced: bool = True,
                   max_iter: int = 300, calibrate: bool = True, folds: int = 5, seed: int = 42,
                   id_col: str = "id", parallelism: int = 5) -> TextClassifier:
    """Fit TF-IDF + logistic regression; with ``calibrate`` the vectoriser is fitted once and
    ``folds`` LR models are fitted on out-of-fold splits, each followed by one isotonic
    curve per class on its held-out decision scores (``calibration_points``); probabilities are normalised
    per fold and averaged.  Null labels are an error."""
    terms = _kept(tokenised(train.select(id_col, label_col, F.col(spec.input_col)), spec).drop(spec.input_col))
    indexer, labels = label_indexer(terms, label_col)
    weights = weighting(vocabulary_totals(terms, "_tf_terms", spec), terms.count(), spec)
    data = drop_internal(weights.transform(terms))
    return fit_features(data, label_col, labels, _with_terms(spec, weights, train.select(spec.input_col)), indexer, balanced, max_iter,
                        calibrate, folds, seed, id_col, parallelism)


def _fit_tasks(n: int) -> int:
    return max(1, -(-n // ROWS_PER_FIT_TASK))


def _at_once(spark: SparkSession, n: int, parallelism: int) -> int:
    """How many fits on ``n`` rows run side by side: a fit holds its rows in executor memory for all its passes, so fits that fill
    the cores alone follow one another."""
    return max(1, min(parallelism, spark.sparkContext.defaultParallelism // _fit_tasks(n)))


def _parallel(fn, items, parallelism: int):
    """Independent small fits submitted as concurrent Spark jobs from driver threads
    (as ``CrossValidator(parallelism=…)`` does); results keep the input order."""
    items = list(items)
    if parallelism <= 1:
        return [fn(i) for i in items]
    with ThreadPoolExecutor(max_workers=min(parallelism, len(items))) as pool:
        return list(pool.map(fn, items))


def cv_accuracy(df: DataFrame, label_col: str, spec: TfidfSpec = TfidfSpec(), balanced: bool = True,
                max_iter: int = 300, folds: int = 5, seed: int = 42, id_col: str = "id",
                parallelism: int = 5) -> DataFrame:
    """Stratified k-fold accuracy of the uncalibrated model, with each fold's own vocabulary and idf.
    Returns one row per fold plus mean and population std as columns."""
    texts = SM.kfold_assign(df.select(id_col, label_col, F.col(spec.input_col)), label_col, id_col, folds, seed)
    terms = _kept(tokenised(texts, spec).drop(spec.input_col))      # texts are moved, not their terms
    totals = vocabulary_totals(terms, "_tf_terms", spec, {str(f): F.col("fold") == f for f in range(folds)})
    return _fold_accuracies(terms, totals, "", label_col, spec, balanced, max_iter, folds, id_col, parallelism)


def _fold_accuracies(terms: DataFrame, totals: DataFrame, prefix: str, label_col: str, spec: TfidfSpec, balanced: bool, max_iter: int,
                     folds: int, id_col: str, parallelism: int) -> DataFrame:
    """Accuracy on each fold of the model fitted on the others: ``terms`` has the folds, ``totals`` the term totals per fold."""
    sizes = {r["fold"]: r["n"] for r in terms.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(sizes.values())

    def one_fold(f: int):
        weights = weighting(without_part(totals, f"{prefix}{f}"), n - sizes.get(f, 0), spec)
        tr, te = terms.filter(F.col("fold") != f), terms.filter(F.col("fold") == f)
        indexer, labels = label_indexer(tr, label_col)
        clf = fit_features(drop_internal(weights.transform(tr)), label_col, labels, weights, indexer, balanced, max_iter, calibrate=False,
                           id_col=id_col)
        hits = clf.scored(drop_internal(weights.transform(te)), [F.col(label_col)])
        acc = hits.agg(F.avg((F.col("prediction") == F.col(label_col)).cast("double"))).first()[0]
        return (f, float(acc) if acc is not None else 0.0)

    rows = _parallel(one_fold, range(folds), _at_once(terms.sparkSession, n, parallelism))
    out = terms.sparkSession.createDataFrame(rows, "fold int, accuracy double")
    g = Window.partitionBy()
    return out.withColumn("cv_mean", F.avg("accuracy").over(g)).withColumn("cv_std", F.stddev_pop("accuracy").over(g))


@dataclass
class TrainingResult:
    model: TextClassifier
    accuracy: float
    report: DataFrame
    cv: DataFrame


def train_text_models(df: DataFrame, targets: list[str], seed: int = 42, calibrate: bool = True, id_col: str = "id", with_cv: bool = True,
                      max_iter: int = 300, folds: int = 5, max_rows: int | None = MAX_FIT_ROWS,
                      spec: TfidfSpec = TfidfSpec()) -> dict[str, TrainingResult]:
    """For each target: stratified 80/20 split → fit → held-out accuracy and per-class report → k-fold CV, on all
    labelled rows (where ``max_rows`` is given, on a seeded sample of so many, the same ones for all targets).

    The texts are read and tokenised once.  Splits and folds of all targets are columns beside the terms, and one pass sums the
    terms' totals for every target's training rows and every target's folds.
    """
    rows = df.select(id_col, F.col(spec.input_col), *targets)
    # a sample, or several splits, read the rows more than once; texts are moved, not their terms
    rows = _kept(rows if max_rows is None else SM.hash_sample(rows, max_rows, id_col, seed))
    for t in targets:
        rows = SM.stratified_split(rows, t, id_col, seed).withColumnRenamed("split", f"_split_{t}")
        if with_cv:
            rows = SM.kfold_assign(rows, t, id_col, folds, seed).withColumnRenamed("fold", f"_fold_{t}")
    terms = _kept(tokenised(rows, spec).drop(spec.input_col))
    parts = {f"{t}_train": F.col(f"_split_{t}") == "train" for t in targets}
    if with_cv:
        parts |= {f"{t}_{f}": F.col(f"_fold_{t}") == f for t in targets for f in range(folds)}
    totals = vocabulary_totals(terms, "_tf_terms", spec, parts)
    return {t: _train_target(terms, totals, t, df, spec, seed, calibrate, id_col, with_cv, max_iter, folds) for t in targets}


def _train_target(terms, totals, target, df, spec, seed, calibrate, id_col, with_cv, max_iter, folds) -> TrainingResult:
    own = terms.select(id_col, target, "_tf_terms", F.col(f"_split_{target}").alias("split"),
                       *([F.col(f"_fold_{target}").alias("fold")] if with_cv else []))
    train, test = own.where("split = 'train'").drop("split", "fold"), own.where("split = 'test'")
    indexer, labels = label_indexer(train, target)
    weights = weighting(of_part(totals, f"{target}_train"), train.count(), spec)
    clf = fit_features(drop_internal(weights.transform(train)), target, labels, _with_terms(spec, weights, df.select(spec.input_col)), indexer,
                       True, max_iter, calibrate, folds, seed, id_col)
    pred = clf.scored(drop_internal(weights.transform(test)), [F.col(id_col), F.col(target)])
    pred = _kept(pred.select(id_col, F.lit(target).alias("model"), F.col(target).alias("y"), F.col("prediction").alias("p")))
    acc = pred.agg(F.avg((F.col("y") == F.col("p")).cast("double"))).first()[0] or 0.0
    cv = _fold_accuracies(own.drop("split"), totals, f"{target}_", target, spec, True, max_iter, folds, id_col, 5) if with_cv else None
    return TrainingResult(clf, float(acc), EV.per_class(pred), cv)


def train_text_model(df: DataFrame, label_col: str, seed: int = 42, calibrate: bool = True,
                     id_col: str = "id", with_cv: bool = True, max_iter: int = 300,
                     folds: int = 5, max_rows: int | None = MAX_FIT_ROWS) -> TrainingResult:
    """``train_text_models`` for one target."""
    return train_text_models(df, [label_col], seed, calibrate, id_col, with_cv, max_iter, folds, max_rows)[label_col]


# ----------------------------------------------------------------------------- benchmark models

BASELINE_SPEC = TfidfSpec(ngram_max=1, min_df=2.0, sublinear=True, vocab_size=None)
IMPROVED_WORD = TfidfSpec(output_col="f_word", ngram_max=2, min_df=2.0, sublinear=True, vocab_size=50_000)
IMPROVED_CHAR = TfidfSpec(output_col="f_char", analyzer="char_wb", min_df=2.0, sublinear=True, vocab_size=30_000)


def fit_improved(train: DataFrame, label_col: str, max_iter: int = 1000, id_col: str = "id") -> TextClassifier:
    """Word 1–2-grams + in-word char 3–5-grams (each TF-IDF, L2) → balanced LR."""
    both = ((IMPROVED_WORD, "_tfw"), (IMPROVED_CHAR, "_tfc"))
    terms = train.select(id_col, label_col, "text")
    for spec, prefix in both:
        terms = tokenised(terms, spec, prefix)
    terms = _kept(terms.drop("text"))      # both kinds of terms once: totals and features read them
    n = terms.count()
    word, char = (weighting(vocabulary_totals(terms, f"{prefix}_terms", spec), n, spec, prefix) for spec, prefix in both)
    asm = VectorAssembler(inputCols=["f_word", "f_char"], outputCol="features")
    indexer, labels = label_indexer(terms, label_col)
    data = PipelineModel(stages=[*word.stages, *char.stages, asm]).transform(terms).select(id_col, label_col, "features")
    text = train.select("text")
    feats = PipelineModel(stages=[*_with_terms(IMPROVED_WORD, word, text, "_tfw").stages, *_with_terms(IMPROVED_CHAR, char, text, "_tfc").stages, asm])
    return fit_features(data, label_col, labels, feats, indexer, balanced=True, max_iter=max_iter, calibrate=False, id_col=id_col)


def fit_baseline(train: DataFrame, label_col: str, max_iter: int = 500, id_col: str = "id") -> TextClassifier:
    return fit_classifier(train, label_col, BASELINE_SPEC, balanced=False, max_iter=max_iter,
                          calibrate=False, id_col=id_col)


def term_counts(df: DataFrame, terms_col: str, out_col: str) -> DataFrame:
    """``terms_col`` replaced by ``out_col``, the row's distinct terms as structs ``(term, tf)``: equal ones are runs of the sorted terms."""
    kept = [c for c in df.columns if c != terms_col]
    ts, at = free_names([*kept, out_col], "_ts", "_at")
    runs = F.filter(F.transform(F.col(ts), lambda t, i: F.when((i == 0) | (F.get(F.col(ts), i - 1) != t), i)), lambda i: i.isNotNull())
    each = F.transform(F.col(at), lambda i, k: F.struct(
        F.get(F.col(ts), i).alias("term"), (F.coalesce(F.get(F.col(at), k + 1), F.size(ts)) - i).alias("tf")))
    return (df.select(*kept, TX.evaluated_once(F.sort_array(terms_col)).alias(ts))
            .select(*kept, ts, TX.evaluated_once(runs).alias(at)).select(*kept, each.alias(out_col)))


def _table_rows(df: DataFrame, table: TermTable, id_col: str, prefix: str) -> DataFrame:
    """``tfidf_rows`` by joins: frequent terms meet their idf in the task that reads the row, only rare ones are shuffled by term, so no
    term fills a task; the norm is a window over the row's entries."""
    spec = table.spec
    terms = tokenised(df, spec, prefix).select(F.col(id_col).alias("id"), f"{prefix}_terms")
    rows = _kept(term_counts(terms, f"{prefix}_terms", "_e").withColumn("_row", F.monotonically_increasing_id()))
    each = rows.select("_row", "id", F.inline("_e"))
    near = each.join(F.broadcast(table.frequent), "term")
    far = each.join(F.broadcast(table.frequent.select("term")), "term", "left_anti").join(table.rare, "term")
    tf = F.col("tf").cast("double")
    found = near.unionByName(far).select("_row", "id", "term", ((1 + F.log(tf) if spec.sublinear else tf) * F.col("idf")).alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("_row")))
    return found.select("id", "term", (F.col("_w") / norm).alias("weight"))


def tfidf_rows(df: DataFrame, model: PipelineModel | TermTable, id_col: str = "id", prefix: str = "_tf") -> DataFrame:
    """``(id, term, weight)`` of the non-zero features of a fitted TF-IDF model."""
    if isinstance(model, TermTable):
        return _table_rows(df, model, id_col, prefix)
    terms = next(s for s in model.stages if hasattr(s, "vocabulary")).vocabulary
    spark = df.sparkSession
    named = spark.createDataFrame(list(enumerate(terms)), "_i int, term string")
    out = model.transform(df).select(F.col(id_col).alias("id"), sparse_entries("features").alias("_e"))
    return (out.select("id", F.explode("_e").alias("_x")).select("id", F.col("_x.i").alias("_i"), F.col("_x.v").alias("weight"))
            .join(named, "_i").select("id", "term", "weight"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", T.DoubleType())])))
def sparse_entries(v: pd.DataFrame) -> pd.Series:
    """Index and value of a vector's stored entries."""
    return pd.Series([[{"i": int(i), "v": float(x)} for i, x in zip(a, b) if x != 0] if a is not None
                      else [{"i": i, "v": float(x)} for i, x in enumerate(b) if x != 0]
                      for a, b in zip(v["indices"], v["values"])], dtype=object)


def label_index(df: DataFrame, label_col: str) -> DataFrame:
    """Dense label index: sorted labels → 0..k-1 (and back with ``IndexToString``)."""
    model = StringIndexer(inputCol=label_col, outputCol="label_index", stringOrderType="alphabetAsc").fit(df)
    out = model.transform(df)
    back = IndexToString(inputCol="label_index", outputCol="label_back", labels=model.labels)
    return back.transform(out).withColumn("label_index", F.col("label_index").cast("int"))


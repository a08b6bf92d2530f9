"""Lookups: literal maps, ordered first-match over a registry.

Rules given as values compile to ``CASE WHEN`` chains (short-circuit, codegen).  A registry
*table*, whatever its size, goes through one exact join on short substrings.
"""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..session import shared_path
from .names import free_names
from .text import _col, evaluated_once


def map_lookup(c: str | Column, mapping: dict[str, str]) -> Column:
    """``mapping[c]`` or null, as a literal map (tiny, lives in the expression)."""
    m = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    return m[_col(c)]


def queue_for(label: str | Column, queue_map: dict[str, str] | None = None) -> Column:
    qm = C.QUEUE_BY_ISSUE if queue_map is None else queue_map
    return F.coalesce(map_lookup(label, qm), F.lit(C.DEFAULT_QUEUE))


def urgency_suffix(route: str | Column, urgency: str | Column) -> Column:
    """Append ``_priority`` to a queue for high / critical urgency."""
    r, u = _col(route), _col(urgency)
    return F.when(u.isin(*C.PRIORITY_URGENCIES), F.concat(r, F.lit(C.PRIORITY_SUFFIX))).otherwise(r)


def rule_match(text: str | Column, rules=C.RULE_PATTERNS) -> Column:
    """First matching rule as ``struct(queue, issue_type)``; null when no rule hits."""
    t = _col(text)
    out = None
    for pattern, queue, issue in rules:
        val = F.struct(F.lit(queue).alias("queue"), F.lit(issue).alias("issue_type"))
        cond = t.contains(pattern)
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out


def rule_registry(spark: SparkSession, rules=C.RULE_PATTERNS) -> DataFrame:
    """The rule registry as a table with an explicit priority column ``ord``."""
    schema = T.StructType([
        T.StructField("ord", T.IntegerType(), False),
        T.StructField("pattern", T.StringType(), False),
        T.StructField("queue", T.StringType(), False),
        T.StructField("issue_type", T.StringType(), False),
    ])
    return spark.createDataFrame([(i, p, q, it) for i, (p, q, it) in enumerate(rules)], schema)


def rule_match_table(df: DataFrame, text_col: str, registry: DataFrame) -> DataFrame:
    """Ordered first match of ``text`` against a registry table ``(ord, pattern, queue,
    issue_type)``; lowest ``ord`` wins.

    Adds ``rule_queue`` and ``rule_issue_type`` (null when nothing matches, and for a null
    text).  One plan for a registry of any size; the answer depends on the text alone.  A pattern is indexed by one of its
    grams (of the greatest length in ``GRAMS`` that it has, the one that the fewest patterns have).  The index is written first,
    so that Spark plans the join with it by its true size, and leaves a bitmap of
    gram hashes: a text tests its grams there in the task that reads it, and only grams that the bitmap lets through are
    shuffled, with as much of their text as a pattern around them can cover, and meet the index; only the patterns that come back are
    tested with ``contains``.  Rows meet their answer by a hash of the text (SHA-256).  Columns named like a result are replaced.
    """
    spark = df.sparkSession
    df = df.drop(*RULE_COLUMNS)
    h, found_h, grams, bits = free_names([*df.columns, *RULE_COLUMNS], "_h", "_found_h", "_grams", "_bits")
    t = F.col(text_col)
    index = _rule_index(spark, registry)
    n_bits, lengths, longest = index.select(_filter_bits(F.count(F.lit(1))), F.collect_set(F.length("gram")),      # at most a number per length in GRAMS
                                            F.coalesce(F.max(F.length("pattern")), F.lit(0))).first()
    keyed = df.withColumn(h, F.unhex(F.sha2(t.cast("binary"), 256)))
    few = min(n_bits, ROW_BITS)
    near = F.filter(_grams(F.col("text"), lengths), lambda g: _in_filter(F.col(bits), g["gram"], few))
    texts = (keyed.where(t.isNotNull()).select(h, t.alias("text"), _filter_words(index, few).scalar().alias(bits))
             .select(h, "text", evaluated_once(near).alias(grams)).where(F.size(grams) > 0)
             .select(h, "text", F.explode(F.array_distinct(grams)).alias(grams)).select(h, "text", F.col(grams)["gram"].alias("gram"), F.col(grams)["at"].alias("at")))
    # the whole filter is in a plain condition: a column, which a higher-order function needs, is copied with every row
    passing = texts.where(_in_filter(_filter_words(index, n_bits).scalar(), F.col("gram"), n_bits))
    # a pattern with this gram at this place lies within what the longest one can cover
    around = F.substring(F.col("text"), F.greatest(F.col("at") - longest, F.lit(0)) + 1, F.least(F.col("at"), F.lit(longest)) + longest)
    around = passing.select(h, "gram", around.alias("text")).distinct()      # one of equal texts
    hits = (around.join(index, "gram")
            .where(F.col("text").contains(F.col("pattern"))).groupBy(h).agg(F.min("rule").alias("rule"))
            .select(F.col(h).alias(found_h), F.col("rule.queue").alias("rule_queue"), F.col("rule.issue_type").alias("rule_issue_type")))
    return keyed.join(hits, F.col(h) == F.col(found_h), "left").drop(h, found_h)


RULE_COLUMNS = ("rule_queue", "rule_issue_type")
GRAMS = (32, 24, 16, 12, 8, 6, 4, 3, 2, 1, 0)
BITS_PER_PATTERN = 64
LEAST_BITS, MOST_BITS = 1 << 12, 1 << 26      # a fuller filter lets more grams through, none is lost
ROW_BITS = 1 << 16      # of a filter that rows carry


def _rule_index(spark: SparkSession, registry: DataFrame) -> DataFrame:
    """(pattern, rule, gram), a row per pattern, written to the shared folder."""
    rules = registry.groupBy("pattern").agg(F.min(F.struct("ord", "queue", "issue_type")).alias("rule"))
    own = rules.select("pattern", "rule", F.explode(_own_grams(F.col("pattern"))).alias("gram"))
    shared = own.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    index = (own.join(shared, "gram").groupBy("pattern")
             .agg(F.min("rule").alias("rule"), F.min(F.struct("n", "gram"))["gram"].alias("gram")))
    path = shared_path(spark, "rule_index", uuid.uuid4().hex)
    index.write.parquet(path)
    return spark.read.parquet(path)


def _substrings(c: Column, n: int) -> Column:
    """All of ``n`` characters, in order: one pass of the expression engine over the text, a capture at every character."""
    return F.array(F.lit("")) if n == 0 else F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def _own_grams(c: Column) -> Column:
    """Distinct substrings of a pattern, of the greatest length in ``GRAMS`` that it has."""
    return F.array_distinct(F.coalesce(*(F.when(F.length(c) >= n, _substrings(c, n)) for n in GRAMS)))


def _grams(c: Column, lengths: list[int]) -> Column:
    """Substrings of the given numbers of characters (0: the empty one) with the number of characters before them."""
    placed = [F.transform(_substrings(c, n), lambda g, i: F.struct(g.alias("gram"), i.alias("at"))) for n in sorted(lengths)]
    return F.concat(F.array().cast("array<struct<gram:string,at:int>>"), *placed)


def _filter_bits(n: Column) -> Column:
    """Bits of the filter of ``n`` patterns: a power of two."""
    wanted = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n, F.lit(1)) * BITS_PER_PATTERN)))
    return F.least(F.greatest(wanted, F.lit(float(LEAST_BITS))), F.lit(float(MOST_BITS))).cast("long")


def _bits(gram: Column, n_bits: int) -> list[Column]:
    """Two places from the two halves of a hash."""
    return [F.xxhash64(gram).bitwiseAND(n_bits - 1), F.shiftrightunsigned(F.xxhash64(gram), 32).bitwiseAND(n_bits - 1)]


def _filter_words(index: DataFrame, n_bits: int) -> DataFrame:
    """One row: the filter as an array of n_bits / 64 numbers."""
    bit = index.select(F.explode(F.array(*_bits(F.col("gram"), n_bits))).alias("bit"))
    words = bit.select(F.shiftright("bit", 6).alias("w"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("b")) \
        .groupBy("w").agg(F.bit_or("b").alias("b"))
    every = index.sparkSession.range(n_bits // 64).withColumnRenamed("id", "w").join(words, "w", "left")
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0)).alias("b")))), lambda x: x["b"]))


def _in_filter(words: Column, gram: Column, n_bits: int) -> Column:
    one, two = (F.getbit(F.get(words, F.shiftright(b, 6).cast("int")), b.bitwiseAND(63).cast("int")) == 1 for b in _bits(gram, n_bits))
    return one & two

"""Mixing sources to target weights by pivotal dependent rounding; DataFrame functions only.

A source's target over its size is the number of copies each of its documents is due: a whole part for all, and a
fraction that rounding turns into one more copy or none. Pivotal rounding lets two fractions meet: mass, measured in words, goes from
one to the other at random, both expectations kept, until one of them is 0 or 1; the other carries the rest on to its next meeting.
A meeting keeps the sum of words, so only the last unit of a source, which meets none, moves the source off its target.

The meetings form a reduction tree: units of a source, the largest first, stand in blocks of about ``FAN``; each block is folded by
one ``aggregate`` expression and hands at most one unit on to the next level, whose blocks are made in the same way. Large
units meet before small ones, so the last one is mostly small. A source with most of the rows is as many blocks as it needs, so no
task gets more than some ``FAN`` units of a block. Blocks and random numbers are hashes of a unit's own values: reruns agree,
on any number of machines.

Rows that agree in source, id and size are one unit with a count; which of them get the unit's extra copies is all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import stored

FAN = 64
TINY = 1e-9
CHUNK_BITS = 20      # rows in a chunk when equal rows are numbered
RESULTS = ("source_size", "target", "copies")
_WORD = r"[^\x20\x09-\x0D]+"
_UNIT = "struct<size:bigint,h:bigint,at:bigint,part:double>"


def word_count(text: str | Column) -> Column:
    """Words of a text, runs without white space (null: 0): each becomes one letter, white space goes."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.octet_length(F.translate(F.regexp_replace(t, _WORD, "x"), " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) of (source, source_size): the sum of all sizes is shared by weight (``weights`` in turn, sources by code
    point, null last); no target exceeds ``most`` times its source's size, what is above goes to the others by weight until none is.

    Sources ordered by limit over weight: those at their limit come first, and the level that the others share is the greatest
    of (what is left) / (weights left) over that order. One row per source is ordered, whatever the number of documents.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))).cast("int") + 1
    w = sizes.withColumn("w", F.element_at(F.array(*(F.lit(int(x)) for x in weights)), turn)).withColumn("cap", F.col("source_size") * int(most))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = F.max("level").over(everything)
    return (w.withColumn("level", left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))))
            .select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * level).alias("target")))


def _unit_random(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0 ** -53)


def _meet(state: Column, unit: Column, seed: int) -> Column:
    """The carried unit meets the next one: words of mass go one way or the other until one of them is 0 or 1."""
    held = state["held"]
    a, b, size_a, size_b = held["part"], unit["part"], held["size"], unit["size"]
    most_up, most_down = F.least((1 - a) * size_a, b * size_b), F.least(a * size_a, (1 - b) * size_b)
    up = _unit_random(F.lit(seed), held["h"], unit["h"]) * (most_up + most_down) < most_down
    moved = F.when(up, most_up).otherwise(-most_down)

    def after(words: Column) -> Column:
        return F.struct((a + words / size_a).alias("a"), (b - words / size_b).alias("b"))

    def settle(m: Column) -> Column:
        def ended(p: Column) -> Column:
            return (p < TINY) | (p > 1 - TINY)

        def done(one: Column, p: Column) -> Column:
            return F.when(ended(p), F.array(F.struct(one["at"].alias("at"), (p > 0.5).cast("int").alias("won")))).otherwise(
                F.array().cast("array<struct<at:bigint,won:int>>"))

        def carried(one: Column, p: Column) -> Column:
            return F.struct(one["size"].alias("size"), one["h"].alias("h"), one["at"].alias("at"), p.alias("part"))

        rest = F.when(~ended(m["a"]), carried(held, m["a"])).when(~ended(m["b"]), carried(unit, m["b"])).otherwise(F.lit(None).cast(_UNIT))
        return F.struct(rest.alias("held"), F.concat(state["done"], done(held, m["a"]), done(unit, m["b"])).alias("done"))

    met = F.transform(F.transform(F.array(moved), after), settle)[0]      # each step is computed once
    return F.when(held.isNull(), F.struct(unit.alias("held"), state["done"].alias("done"))).otherwise(met)


def _level(units: DataFrame, level: int, seed: int) -> DataFrame:
    """(source, held, done) of each block of units (source, size, h, at, part)."""
    kind = F.floor(F.log2(F.col("size") + 1.0) * 32).cast("int")      # at most some 1,300 classes of size in a source
    units = units.withColumn("kind", kind)
    counts = units.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("source").orderBy(F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("of"), F.col("kind").alias("of_kind"), "n", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("earlier"))
    placed = units.join(counts, F.col("source").eqNullSafe(F.col("of")) & (F.col("kind") == F.col("of_kind")))
    # a place by size class and hash: on average one unit for each place, so a block holds about FAN of them
    place = F.col("earlier") + F.floor(_unit_random(F.lit(seed), F.lit(level), F.col("h")) * F.col("n"))
    blocks = (placed.groupBy("source", F.floor(place / FAN).alias("block"))
              .agg(F.sort_array(F.collect_list(F.struct("size", "h", "at", "part")), asc=False).alias("units")))
    start = F.struct(F.lit(None).cast(_UNIT).alias("held"), F.array().cast("array<struct<at:bigint,won:int>>").alias("done"))
    return blocks.select("source", F.aggregate("units", start, lambda s, u: _meet(s, u, seed)).alias("s")).select("source", "s.held", "s.done")


def rounded(units: DataFrame, seed: int = 42) -> DataFrame:
    """(at, won): 0 or 1 for each unit (source, size, h, at, part), part in (0, 1) and size above 0; won is 1 with probability part, and
    over a source size * won adds up to size * part but for the rounding of one unit."""
    most = units.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    won, level = [], 0
    while most > 1:
        folded = stored(_level(units, level, seed), "mixing-level")
        won.append(folded.select(F.explode("done").alias("d")).select("d.at", "d.won"))
        units = folded.where(F.col("held").isNotNull()).select("source", "held.*")
        most, level = -(-most // FAN), level + 1
    out = units.select("at", _alone(seed).alias("won"))
    for w in won:
        out = out.unionByName(w)
    return out


def _alone(seed: int) -> Column:
    """A unit that meets none: 1 with probability ``part``."""
    return (_unit_random(F.lit(seed), F.lit("last"), F.col("h")) < F.col("part")).cast("int")


def mix(table: DataFrame, size_col: str = "size", id_col: str = "doc_id", source_col: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 42) -> DataFrame:
    """``table`` with source_size, target (its source's) and copies (0 to ``most``): how often the mix takes the row.

    A null size counts as 0, a null source is a source (the last one), null ids are one id; repeated rows share what their unit is
    due. Input columns named like a result are replaced, others may have any name. An empty table gives an empty one. Of ``table`` only
    ids, sources and sizes are moved to find the copies; they meet the rows by these values in the end.
    """
    kept = [F.col(f"`{c}`") for c in table.columns if c not in RESULTS]
    rows = table.select(F.struct(*kept).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"),
                        F.coalesce(F.col(f"`{size_col}`"), F.lit(0)).cast("long").alias("size"),
                        F.monotonically_increasing_id().alias("line"))
    own = rows.groupBy("source", "id", "size").agg(F.count(F.lit(1)).alias("n"))
    units = stored(own.select("*", F.xxhash64(F.lit(seed), "source", "id", "size").alias("h"), F.monotonically_increasing_id().alias("at")),
                   "mixing-units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    shares = stored(targets(sizes, weights, most), "mixing-targets").withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    due = units.join(shares, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate).withColumn("whole", F.floor("rate"))
    extra = F.col("n") * (F.col("rate") - F.col("whole"))
    due = due.withColumn("sure", F.floor(extra + TINY)).withColumn("part", extra - F.col("sure"))
    due = stored(due.select("source", "id", "size", "n", "h", "at", "source_size", "target", "whole", "sure", "part"), "mixing-due")
    loose = due.where(F.col("part") > TINY)
    won = rounded(loose.where("size > 0").select("source", "size", "h", "at", "part"), seed)
    won = won.unionByName(loose.where("size = 0").select("at", _alone(seed).alias("won")))      # no words to move
    plan = (due.join(won.withColumnRenamed("at", "won_at"), F.col("at") == F.col("won_at"), "left")
            .select(F.col("source").alias("p_source"), F.col("id").alias("p_id"), F.col("size").alias("p_size"), "n", "source_size", "target",
                    F.col("whole").cast("long").alias("whole"), (F.col("sure") + F.coalesce("won", F.lit(0))).cast("long").alias("more")))
    same = (F.col("source").eqNullSafe(F.col("p_source")) & F.col("id").eqNullSafe(F.col("p_id")) & (F.col("size") == F.col("p_size")))
    found = rows.join(plan, same)
    single = found.where("n = 1").withColumn("copies", F.col("whole") + F.col("more"))
    # equal rows: numbered chunk by chunk, so that a row read by a third of the table is no single group
    equal = stored(found.where("n > 1"), "mixing-equal")
    unit, chunk = ["p_source", "p_id", "p_size"], F.shiftright("line", CHUNK_BITS)
    equal = equal.withColumn("chunk", chunk)
    chunks = equal.groupBy(*unit, "chunk").agg(F.count(F.lit(1)).alias("c"))
    chunks = chunks.select(*(F.col(c).alias(f"c_{c}") for c in unit), F.col("chunk").alias("c_chunk"),
                           F.coalesce(F.sum("c").over(Window.partitionBy(*unit).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)),
                                      F.lit(0)).alias("earlier"))
    numbered = equal.withColumn("k", F.row_number().over(Window.partitionBy(*unit, "chunk").orderBy("line")))
    numbered = numbered.join(chunks, F.col("chunk").eqNullSafe(F.col("c_chunk"))
                             & F.col("p_source").eqNullSafe(F.col("c_p_source")) & F.col("p_id").eqNullSafe(F.col("c_p_id"))
                             & (F.col("p_size") == F.col("c_p_size")))
    shared = numbered.withColumn("copies", F.col("whole") + (F.col("earlier") + F.col("k") <= F.col("more")).cast("long"))
    out = [F.col("row"), F.col("source_size"), F.col("target"), F.col("copies").cast("long").alias("copies")]
    return single.select(*out).unionByName(shared.select(*out)).select("row.*", *RESULTS)

"""Connected components of a link table by alternating star contraction.

Every round shuffles the links twice by an end and writes the contracted links to the
shared folder; a hub's links are never gathered in one group (its least neighbour is a
partial aggregate, and the join back is one that Spark can split). Links and
components stay distributed: the driver sees a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import stored


def _starred(pairs: DataFrame, keep_larger_only: bool) -> DataFrame:
    """For every u: its neighbours (and itself, in the small star) linked to the least of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = pairs.join(least, "u")
    if keep_larger_only:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)


def component_roots(links: DataFrame) -> DataFrame:
    """(node, root): every node of ``links`` (u, v: long) but the roots themselves, with the
    least node of its component. Self-links and repeated links do no harm."""
    edges = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                   .where("u <> v").distinct(), "links")
    seen = None
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _starred(both, True).where("u <> v").distinct()
        edges = stored(_starred(large, False).where("u <> v").distinct(), "links")

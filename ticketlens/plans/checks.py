"""What a fitted model must meet, computed on the rows: used by registered queries and tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ml as ML


def optimality(data: DataFrame, label_col: str, labels: list[str], coefficients: np.ndarray, intercepts: np.ndarray,
               balanced: bool = True) -> DataFrame:
    """``(label, n_terms, residual)`` per class of a multinomial logistic regression on rows with ``features``: the
    greatest absolute component of the loss's gradient with the penalty's, over the greatest component that the gradient
    has where all coefficients are 0.  Near 0 at the optimum, and only there, because the objective is strictly convex.

    The penalty is that of ``fit_features``: half the squared coefficients, against the sum of the rows' weighted losses.
    """
    k = len(labels)
    if balanced:
        data = ML.balanced_weights(data, label_col, labels, "_w")
    else:
        data = data.withColumn("_w", F.lit(1.0))
    entries = data.select(F.col(label_col).alias("y"), "_w", ML.sparse_entries("features").alias("e")) \
        .select("y", "_w", "e", F.monotonically_increasing_id().alias("line"))
    spark = data.sparkSession
    table = spark.createDataFrame([(i, [float(x) for x in coefficients[:, i]]) for i in range(coefficients.shape[1])], "i int, c array<double>")
    each = entries.select("line", "y", "_w", F.inline("e"))
    margin = (each.join(table, "i").select("line", "v", F.posexplode("c").alias("class", "c"))
              .groupBy("line", "class").agg(F.sum(F.col("v") * F.col("c")).alias("m")))
    bias = F.element_at(F.array(*[F.lit(float(b)) for b in intercepts]), F.col("class") + 1)
    margins = margin.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("class", (F.col("m") + bias).alias("m")))).alias("ms"))
    ms = F.transform("ms", lambda x: x["m"])
    shifted = F.transform(ms, lambda x: F.exp(x - F.array_max(ms)))
    p = margins.select("line", F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b)).alias("p"))
    code = F.create_map(*[x for j, lab in enumerate(labels) for x in (F.lit(lab), F.lit(j))])
    rows = each.join(p, "line").withColumn("yc", code[F.col("y")])
    grads = rows.select("i", "v", "_w", "yc", F.posexplode("p").alias("class", "p"))
    hit = (F.col("class") == F.col("yc")).cast("double")
    grads = grads.groupBy("i", "class").agg(F.sum(F.col("_w") * F.col("v") * (F.col("p") - hit)).alias("g"),
                                            F.sum(F.col("_w") * F.col("v") * (F.lit(1.0 / k) - hit)).alias("g0"))
    whole = grads.join(table, "i").withColumn("g", F.col("g") + F.get("c", F.col("class")))
    name = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("class") + 1)
    return whole.groupBy(name.alias("label")).agg(F.count(F.lit(1)).alias("n_terms"),
                                                  (F.max(F.abs("g")) / F.max(F.abs("g0"))).alias("residual"))



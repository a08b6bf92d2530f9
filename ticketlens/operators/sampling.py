"""Seeded sampling, dedup, stratified splits and folds without one-task groups.

Order keys are ``md5('<seed>:<id>')`` hex strings (see ``functions.text.md5_order``):
deterministic across runs, engines and retries.

* keep-first dedup uses ``row_number`` with a ``rn = 1`` filter, which Catalyst plans
  as a partial ``WindowGroupLimit`` before the shuffle: a hot key sends one row per map
  task.
* seeded samples (``hash_sample``, ``per_class_sample``) take exact top-n in order-key order without
  moving the table: rows are counted per order-key bucket, the bucket that holds the n-th row is
  a scalar subquery (for classes: a map), and rows beyond it are filtered out before the first exchange.
  Only the rows left, n and a bucket's worth, are ranked.
* Splits (stratified, positional) compare a row's own key with such a cut: no row moves but those of the cut bucket.
* Exact ranks inside large groups (folds) never sort a whole
  group in one task: rows are bucketed by the first 4 hex digits of the order key
  (65,536 ordered buckets), bucket sizes are counted and prefix-summed on the small
  count table, and the rank is ``rows in earlier buckets + row_number in bucket``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions.names import free_names

ORDER_COL = "_ord"
BUCKET_HEX_DIGITS = 4


def keep_first(df: DataFrame, key_cols, order_cols) -> DataFrame:
    """One row per key: the first by ``order_cols``."""
    return top_n_per_group(df, key_cols, order_cols, 1)


def top_n_per_group(df: DataFrame, group_cols, order_cols, n: int) -> DataFrame:
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    rn, = free_names(df.columns, "_rn")
    return df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= n).drop(rn)


def with_order_key(df: DataFrame, id_col: str = "id", seed: int = 42) -> DataFrame:
    return df.withColumn(ORDER_COL, TX.md5_order(seed, F.col(id_col)))


def _bucket(order_col: str):
    return F.conv(F.substring(F.col(order_col), 1, BUCKET_HEX_DIGITS), 16, 10).cast("int")


def _bucket_counts(keyed: DataFrame, group_cols: list[str], b: str, c: str, upto: str, total: str) -> DataFrame:
    """Rows per (group, bucket), with the running count up to the bucket and the group's total."""
    counts = keyed.groupBy(*group_cols, b).agg(F.count(F.lit(1)).alias(c))
    g = Window.partitionBy(*group_cols)
    return counts.select(*group_cols, b, c, F.sum(c).over(g.orderBy(b).rowsBetween(Window.unboundedPreceding, 0)).alias(upto),
                         F.sum(c).over(g).alias(total))


def _plain_keys(df: DataFrame, group_cols: list[str], names: list[str]) -> dict:
    """Columns that are equal where the group's columns are, nulls included, and never null themselves: one exchange by them
    serves a join and a window."""
    out = {}
    for k, g in enumerate(group_cols):
        out |= {names[2 * k]: F.coalesce(F.col(g).cast("string"), F.lit("")), names[2 * k + 1]: F.col(g).isNull()}
    return out


def _ranked(rows: DataFrame, counts: DataFrame, group_cols: list[str], order: str, tie: str, b: str, c: str, upto: str,
            total: str, rank: str) -> DataFrame:
    """``rows`` plus ``rank`` and ``total``: rows of earlier buckets and the place within the bucket."""
    taken = [*rows.columns, *counts.columns, rank]
    names = free_names(taken, *(f"_{x}{i}" for i in range(len(group_cols)) for x in ("key", "null")))
    off, rn, bucket = free_names([*taken, *names], "_off", "_rn", "_bucket")
    offsets = counts.select((F.col(upto) - F.col(c)).alias(off), total, F.coalesce(F.col(b), F.lit(-1)).alias(bucket),
                            *(x.alias(n) for n, x in _plain_keys(counts, group_cols, names).items()))
    keys = [*names, bucket]
    keyed = rows.withColumns({bucket: F.coalesce(F.col(b), F.lit(-1)), **_plain_keys(rows, group_cols, names)})
    inner = Window.partitionBy(*keys).orderBy(F.col(order), F.col(tie))
    return (keyed.withColumn(rn, F.row_number().over(inner)).join(offsets, keys)
            .withColumn(rank, F.col(off) + F.col(rn)).drop(*keys, off, rn))


def exact_rank(df: DataFrame, group_cols: list[str], order_col: str = ORDER_COL, tie_col: str = "id",
               rank_col: str = "_rank", total_col: str = "_group_n") -> DataFrame:
    """Adds ``rank_col`` (1-based, by ``order_col`` then ``tie_col``) and ``total_col``, the size of the group.

    ``order_col`` must be a lower-case hex string (an md5 order key).  A null group key is a
    group, a null order key comes first: no row is dropped.  Columns of these two names are replaced.
    """
    df = df.drop(rank_col, total_col)
    b, c, upto = free_names([*df.columns, rank_col, total_col], "_b", "_c", "_upto")
    keyed = df.withColumn(b, _bucket(order_col))
    counts = _bucket_counts(keyed, group_cols, b, c, upto, total_col)
    return _ranked(keyed, counts, group_cols, order_col, tie_col, b, c, upto, total_col, rank_col).drop(b)


def _with_rank(df: DataFrame, group_cols: list[str], id_col: str, seed: int) -> tuple[DataFrame, str, str, list[str]]:
    """``df`` ranked by its order key: (rows, rank column, group size column, helper columns)."""
    order, rank, total = free_names(df.columns, ORDER_COL, "_rank", "_group_n")
    keyed = df.withColumn(order, TX.md5_order(seed, F.col(id_col)))
    return exact_rank(keyed, group_cols, order, id_col, rank, total), rank, total, [order, rank, total]


def stratified_split(df: DataFrame, label_col: str, id_col: str = "id", seed: int = 42,
                     test_num: int = 1, test_den: int = 5) -> DataFrame:
    """Adds ``split``: the first ``ceil(n_label * test_num / test_den)`` rows of each label
    in seeded hash order are ``test``, the rest ``train``.  A label keeps at least one row in
    train (a label with a single row is trained on, never only tested); null labels are a label."""
    return _split(df, [label_col], lambda n: f"least((`{n}` * {int(test_num)} + {int(test_den) - 1}) div {int(test_den)}, `{n}` - 1)",
                  id_col, seed, "test", "train")


def _split(df: DataFrame, group_cols: list[str], wanted, id_col: str, seed: int, first: str, rest: str) -> DataFrame:
    """Adds ``split``: ``first`` for as many rows of a group, in ``(md5 order key, id)`` order, as the SQL expression
    ``wanted`` makes of its size, ``rest`` for the others.

    Rows are not moved: the bucket that the cut falls into is a scalar subquery, a row of another bucket is on one side
    of it by its own key, and only the rows of that bucket are ranked.
    """
    df = df.drop("split")
    order, b, c, upto, total, rn, cut = free_names([*df.columns, "split"], ORDER_COL, "_b", "_c", "_upto", "_total", "_rn", "_cut")
    keyed = df.withColumn(order, TX.md5_order(seed, F.col(id_col)))
    keyed = keyed.withColumn(b, F.coalesce(_bucket(order), F.lit(-1)))      # a null key comes first
    counts = _bucket_counts(keyed, group_cols, b, c, upto, total)
    limit = _limit(counts, group_cols, F.expr(wanted(total)), b, c, upto)
    marked = keyed.withColumn(cut, TX.evaluated_once(F.struct(limit.alias("at"), F.col(b).alias("b"))))
    at, own = F.col(f"{cut}.at"), F.col(f"{cut}.b")
    far = marked.where(own != at["b"]).withColumn("split", F.when(own < at["b"], F.lit(first)).otherwise(F.lit(rest)))
    inner = Window.partitionBy(*group_cols, b).orderBy(F.col(order), F.col(id_col))
    near = marked.where(own == at["b"]).withColumn(rn, F.row_number().over(inner))
    near = near.withColumn("split", F.when(F.col(rn) <= at["need"], F.lit(first)).otherwise(F.lit(rest))).drop(rn)
    return far.unionByName(near).drop(order, b, cut)


def kfold_assign(df: DataFrame, label_col: str, id_col: str = "id", k: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` in ``0..k-1``: stratified round-robin over the seeded hash order."""
    r, rank, _, own = _with_rank(df, [label_col], id_col, seed)
    return r.withColumn("fold", ((F.col(rank) - 1) % k).cast("int")).drop(*own)


def _limit(counts: DataFrame, group_cols: list[str], wanted, b: str, c: str, upto: str):
    """For a row's group the bucket ``b`` in which the running count reaches ``wanted``, and how many of its rows are
    ``need``-ed: a scalar subquery (for classes a map of two numbers per class); null where a group has fewer rows."""
    place = F.min(F.when(F.col(upto) >= wanted, F.struct(F.col(b).alias("b"), (wanted - F.col(upto) + F.col(c)).alias("need"))))
    if not group_cols:
        return counts.agg(place).scalar()
    label = F.col(group_cols[0])
    cuts = counts.groupBy(label).agg(place.alias(c)).where(F.col(c).isNotNull())
    entry = F.when(label.isNotNull(), F.struct(label.alias("k"), F.col(c).alias("v")))
    one = cuts.agg(F.map_from_entries(F.collect_list(entry)).alias("m"), F.max(F.when(label.isNull(), F.col(c))).alias("z"))
    found = one.select(F.struct("m", "z")).scalar()
    return F.when(label.isNull(), found["z"]).otherwise(F.try_element_at(found["m"], label))


def _cut_sample(df: DataFrame, group_cols: list[str], n: int, id_col: str, seed: int) -> tuple[DataFrame, str, list[str]]:
    """The first ``n`` rows (of each group) in ``(md5 order key, id)`` order: (rows, order column, helper columns).

    Rows of buckets after the cut bucket never reach an exchange, those of earlier ones are in, those of the cut bucket are ranked.
    """
    order, b, c, upto, total, rn, cut = free_names(df.columns, ORDER_COL, "_b", "_c", "_upto", "_total", "_rn", "_cut")
    keyed = df.withColumn(order, TX.md5_order(seed, F.col(id_col)))
    keyed = keyed.withColumn(b, F.coalesce(_bucket(order), F.lit(-1)))      # a null key comes first
    counts = _bucket_counts(keyed, group_cols, b, c, upto, total)
    limit = _limit(counts, group_cols, F.lit(n), b, c, upto)
    # evaluated once: a filter on a plain column would copy the label's and the key's expressions
    near = keyed.withColumn(cut, TX.evaluated_once(F.struct(limit.alias("at"), F.col(b).alias("b"))))
    near = near.where(F.col(f"{cut}.at").isNull() | (F.col(f"{cut}.b") <= F.col(f"{cut}.at.b")))
    inner = Window.partitionBy(*group_cols, b).orderBy(F.col(order), F.col(id_col))
    at = F.col(f"{cut}.at")
    rows = near.withColumn(rn, F.row_number().over(inner)).where(at.isNull() | (F.col(b) < at["b"]) | (F.col(rn) <= at["need"]))
    return rows, order, [b, rn, cut]


def hash_sample(df: DataFrame, n: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Seeded sample of ``n`` rows (the cap is the feature): the first ``n`` rows in
    ``(md5 order key, id)`` order, exactly.

    One plan serves every input: the table is read twice, once to count rows per order-key bucket and once
    to take those up to the bucket that holds the ``n``-th row; what is beyond it is never shuffled.
    """
    rows, order, own = _cut_sample(df, [], n, id_col, seed)
    return rows.orderBy(order, id_col).drop(order, *own)


def positional_split(df: DataFrame, id_col: str = "id", seed: int = 42,
                     train_num: int = 4, train_den: int = 5) -> DataFrame:
    """Adds ``split``: the first ``floor(n * train_num / train_den)`` rows in seeded hash
    order are ``train`` (not stratified); exact ranks via hash buckets, no global sort task."""
    return _split(df, [], lambda n: f"(`{n}` * {int(train_num)}) div {int(train_den)}", id_col, seed, "train", "test")


def per_class_sample(df: DataFrame, label_col: str, n: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Up to ``n`` rows per class: the first ``n`` in ``(md5 order key, id)`` order, exactly; a null class is a class.

    A windowed top-n would send up to ``n`` rows per class from every map task into one
    task per class, and a join on the class alone would send a class's rows to one task.  Here only rows up to
    their class's cut bucket are shuffled, by (class, bucket).
    """
    rows, order, own = _cut_sample(df, [label_col], n, id_col, seed)
    return rows.drop(order, *own)


def dedup_keep_first(df: DataFrame, key_col: str, id_col: str = "id") -> DataFrame:
    """Keep-first dedup (lowest id = first in source order) on a computed key."""
    return keep_first(df, [key_col], [F.col(id_col)])


def dedup_dropped(df: DataFrame, key_col: str) -> DataFrame:
    """Rows a keep-first dedup on ``key_col`` removes (``count − count distinct``), as one
    aggregate; the distinct count shuffles map-side de-duplicated keys.  Null keys are
    kept by the dedup (one per null group) and counted as one key here too."""
    k = F.col(key_col)
    nulls = F.max(k.isNull().cast("int"))
    return df.agg((F.count(F.lit(1)) - F.count_distinct(k) - F.coalesce(nulls, F.lit(0))).alias("dropped"))

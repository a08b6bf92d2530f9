"""Document fingerprints from closed syncmers, in native expressions only.

A text is a sequence of tokens: a run of non-space characters of at most ``LONGEST_WORD`` code points is one, but longer runs and
runs with letters of scripts that are written without spaces are split into code points, so an insertion moves tokens and
never recuts them. Its k-mers are k neighbouring tokens; a k-mer is chosen when the least hash among its inner s-mers is that of the first or
the last one. The choice looks at nothing outside the k-mer: the same passage gives the same anchors wherever it stands.

The fingerprint is all anchors of the text with their places. Two fingerprints are compared by position: two neighbouring anchors
match where both texts have them at the same distance, and likeness is the share of matching neighbours among all of both
(exact, not an estimate). What comes before a passage moves its places and leaves its distances as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import free_names, stored

K = 6
S = 2
LONGEST_WORD = 32
#: Blocks of scripts written without spaces (Thai to Myanmar, Khmer, CJK with kana and Yi, compatibility forms).
_UNSPACED = r"\u0E00-\u109F\u1780-\u17FF\u2E80-\uA4CF\uF900-\uFAFF\uFF66-\uFF9F\x{20000}-\x{3FFFF}"
_TOKEN = rf"(?<!\S)[^\s{_UNSPACED}]{{1,{LONGEST_WORD}}}(?!\S)|\S"
_LEAST_LONG = -(1 << 63)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once (a lambda variable, not a copied expression)."""
    return F.transform(F.array(value), body)[0]


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<place: token number, hash>> of the closed syncmers of a text, in order.

    A text of fewer than k tokens has one anchor, its whole; a blank one has none; null is an empty text.
    """
    if not 1 <= s < k:
        raise ValueError("s must be from 1 to k - 1")
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0))
    hashes = F.transform(tokens, lambda t: F.xxhash64(t))

    def pair(place: Column, h: Column) -> Column:
        return F.struct(place.alias("place"), h.alias("hash"))

    def inner(h: Column) -> Column:
        """s-mer hashes: neighbours joined s - 1 times."""
        out = h
        for _ in range(s - 1):
            out = _let(out, lambda x: F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1),
                                                 lambda a, b: F.xxhash64(a, b)))
        return out

    def kmers(m: Column) -> Column:
        last = k - s

        def judged(x: Column, i: Column) -> Column:
            ends = F.least(x, F.get(m, i + last))
            middle = [F.get(m, i + j) for j in range(1, last)]
            closed = reduce(lambda a, c: a & (ends <= c), middle, F.lit(True))
            parts = [x, *(F.get(m, i + j) for j in range(s, last, s)), F.get(m, i + last)]
            return F.when(closed, pair(i, F.xxhash64(*parts)))

        return F.filter(F.transform(F.slice(m, F.lit(1), F.size(m) - last), judged), lambda x: x.isNotNull())

    def whole(h: Column) -> Column:
        return (F.when(F.size(h) == 0, F.slice(F.array(pair(F.lit(0), F.lit(0).cast("long"))), 1, 0))
                .when(F.size(h) < k, F.array(pair(F.lit(0), F.xxhash64(h))))
                .otherwise(_let(inner(h), kmers)))

    return _let(hashes, whole)


def neighbours(found: Column) -> Column:
    """What is compared: a hash of every two neighbouring anchors and their distance, each once; of a single anchor its own hash."""
    def paired(a: Column) -> Column:
        n = F.size(a)
        both = F.zip_with(F.slice(a, F.lit(1), n - 1), F.slice(a, F.lit(2), n - 1),
                          lambda x, y: F.xxhash64(x["hash"], y["hash"], y["place"] - x["place"]))
        return F.when(n < 2, F.transform(a, lambda x: x["hash"])).otherwise(F.array_distinct(both))

    return _let(found, paired)


def as_text(found: Column) -> Column:
    """``place:hash`` (hexadecimal) of every anchor, joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.hex(x["place"]), F.lpad(F.hex(x["hash"]), 16, "0"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Share of common neighbours among all of two texts' ``neighbours``.
    Two texts without an anchor are alike (1), one without and another are not (0)."""
    both = _let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both.cast("double"))


def _marks(keyed: DataFrame, key: str, h: str, buckets: int) -> list[tuple[int, int]]:
    """The first (key, hash) of each of at most ``buckets`` buckets of as many rows, in descending key, ascending hash.

    Found exactly, on narrow rows: a range exchange numbers them, and those at the multiples of a bucket's rows come back.
    """
    order = [F.col(key).desc(), F.col(h).asc()]
    lined = stored(keyed.select(key, h).repartitionByRange(*order, F.rand(7)).sortWithinPartitions(*order)
                   .select(key, h, F.monotonically_increasing_id().alias("at")), "syncmer-order")
    part, index = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r[0], r[1]) for r in lined.groupBy(part.alias("p")).count().collect())      # a row per partition
    total = sum(n for _, n in sizes)
    if not total:
        return []
    per = -(-total // buckets)
    wanted, before = None, 0
    for p, n in sizes:      # numbers within the partition at which a bucket begins
        first = -before % per
        if first < n:
            mine = (part == p) & (index >= first) & ((index - first) % per == 0)
            wanted = mine if wanted is None else wanted | mine
        before += n
    rows = lined.where(wanted).select(key, h).distinct().collect()
    return sorted(((r[0], r[1]) for r in rows), key=lambda x: (-x[0], x[1]))


def with_next(docs: DataFrame, id_col: str, columns: dict[str, Column], buckets: int) -> DataFrame:
    """``docs`` plus, per entry of ``columns`` (name to expression), the expression and the value that the next row in
    descending id has, as next_<name>; after the last row comes the first.

    Rows go to buckets of neighbours, one exchange; the first row of every bucket also stands, as a guest, at the end of the
    bucket before, so no row needs a global order. A null id is the least; rows with one id, and rows without, follow each other by the
    hash of the first expression, and are spread over buckets by it; only equal rows always share one.
    """
    taken = [*docs.columns, *columns, *(f"next_{n}" for n in columns)]
    key, h, place, bucket, guest = free_names(taken, "key", "hash", "place", "bucket", "guest")
    keyed = docs.select("*", F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LEAST_LONG)).alias(key),
                        F.xxhash64(next(iter(columns.values()))).alias(h))
    marks = _marks(keyed, key, h, buckets)
    n = len(marks)
    if not n:
        return keyed.select(*docs.columns, *(c.alias(m) for m, c in columns.items()), *(c.alias(f"next_{m}") for m, c in columns.items()))
    keys, hashes = F.lit([k for k, _ in marks]), F.lit([x for _, x in marks])

    def reached(i: Column) -> Column:
        """Is the row at or after mark i?"""
        return (F.get(keys, i) > F.col(key)) | ((F.get(keys, i) == F.col(key)) & (F.get(hashes, i) <= F.col(h)))

    steps = [1 << b for b in reversed(range(max(n - 1, 1).bit_length()))]      # binary search
    at = F.aggregate(F.lit(steps), F.lit(0), lambda i, s: F.when(F.coalesce(reached(i + s), F.lit(False)), i + s).otherwise(i))
    placed = keyed.withColumn(place, at)
    head = (F.get(keys, F.col(place)) == F.col(key)) & (F.get(hashes, F.col(place)) == F.col(h))
    own = F.struct(F.col(place).alias("b"), F.lit(0).alias("g"))
    also = F.struct(((F.col(place) + n - 1) % n).alias("b"), F.lit(1).alias("g"))
    both = placed.withColumn(bucket, F.explode(F.when(head, F.array(own, also)).otherwise(F.array(own))))
    both = both.select(*docs.columns, key, h, F.col(f"{bucket}.b").alias(place), F.col(f"{bucket}.g").alias(guest),
                       *(c.alias(m) for m, c in columns.items()))
    ahead = Window.partitionBy(place).orderBy(guest, F.col(key).desc(), h)
    return (both.select("*", *(F.lead(m).over(ahead).alias(f"next_{m}") for m in columns))
            .where(F.col(guest) == 0).drop(key, h, place, guest))


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """Per row: id, n_chars, fingerprint, near_next, and of the edited text (the last third of its code points replaced by
    the first as many of the next document, descending id): sha256, fingerprint, near_edited.

    Null texts are empty. An only row is its own next. Repeated rows follow each other. Whole texts are read, however long. An
    empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    buckets = max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("body"))
    pairs = with_next(own.select("id", "body"), "id", {"text": F.col("body")}, buckets)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    made = pairs.select("id", n.cast("long").alias("n_chars"), _let(
        F.struct(F.col("text").alias("own"), F.col("next_text").alias("next"), edited.alias("edited")),
        lambda t: F.struct(F.sha2(t["edited"].cast("binary"), 256).alias("sha"), anchors(t["own"], k, s).alias("own"),
                           anchors(t["edited"], k, s).alias("edited"), neighbours(anchors(t["next"], k, s)).alias("next"))).alias("a"))
    sets = F.struct(neighbours(F.col("a.own")).alias("own"), neighbours(F.col("a.edited")).alias("edited"), F.col("a.next").alias("next"))
    near = made.select("id", "n_chars", "a", _let(sets, lambda x: F.struct(
        likeness(x["own"], x["edited"]).alias("edited"), likeness(x["own"], x["next"]).alias("next"))).alias("near"))
    return near.select(
        F.col("id").alias(id_col), "n_chars", F.col("a.sha").alias("edited_sha256"), as_text(F.col("a.own")).alias("fingerprint"),
        as_text(F.col("a.edited")).alias("edited_fingerprint"), F.col("near.edited").alias("near_edited"), F.col("near.next").alias("near_next"))

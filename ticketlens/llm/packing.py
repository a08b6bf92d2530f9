"""Best-fit packing by bin completion over the counts of piece lengths.

Documents become token ids once, in the tasks; ids longer than a sequence are cut into full pieces, the first
piece holding the remainder. What the packing needs of the corpus is the number of pieces per length: at most
``capacity`` numbers. On them, bin completion runs: best fit is the incumbent, and for a number of sequences
between the lower bound and the incumbent's, a depth-first search completes the largest length left by one of its
undominated fillings, least waste first, as often as the counts allow, and returns to the others (and to fewer
uses) once the waste exceeds what that number allows. The search of one number ends after STATES steps; up to there it is
exact. The result is a list of patterns. Every piece then finds its sequence and
place from its rank among the pieces of its length, so no task and no driver ever holds the pieces of a
length together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import STEP_BYTES, stored

CAPACITY = 2048
END_ID = 0
NODES = 4000          # nodes of the depth-first search for one filling; sums by dynamic programming beyond
STATES = 10000        # fillings tried for one number of sequences; the next number is tried beyond


@lru_cache(maxsize=4)
def _encoder(path: str):
    """ids of a batch of texts by the tokenizer file, without special tokens added.

    Where the same vocabulary lies beside it as ranks, plain texts go through the rank
    encoder, which gives the same ids several times faster (tested); texts that it refuses and
    texts that hold a special token's string go through the tokenizer itself.
    """
    import base64
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    own = Tokenizer.from_file(path)
    special = [t.content for t in own.get_added_tokens_decoder().values()]

    def slow(text: str) -> list[int]:
        return own.encode(text, add_special_tokens=False).ids

    ranks_path = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks_path):
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return slow(text)
        try:
            return fast.encode_ordinary(text)
        except Exception:  # noqa: BLE001  the rank encoder's regular expression refuses some very long runs
            return slow(text)

    return encode


PIECES = "piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row per piece: id, piece (from 0), start, length, ids_crc32 and, on demand, the ids themselves."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for batch in batches:
            rows: dict[str, list] = {"i": [], "piece": [], "start": [], "length": [], "crc": [], "ids": []}
            held = 0

            def out(batch=batch):
                columns = [batch.column(0).take(pa.array(rows["i"], pa.int64())), pa.array(rows["piece"], pa.int32()),
                           *(pa.array(rows[c], pa.int64()) for c in ("start", "length", "crc"))]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(rows["ids"], pa.list_(pa.int32())))
                    names.append("ids")
                return pa.RecordBatch.from_arrays(columns, names=names)

            for i, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    rows["i"].append(i)
                    rows["piece"].append(piece)
                    rows["start"].append(a)
                    rows["length"].append(b - a)
                    rows["crc"].append(zlib.crc32(ids[a:b].tobytes()))
                    if with_ids:
                        rows["ids"].append(ids[a:b].astype(np.int32))
                held += len(ids) * 4 if with_ids else 0
                if held > STEP_BYTES:
                    yield out()
                    rows, held = {k: [] for k in rows}, 0
            yield out()

    schema = f"`{id_col}` long, {PIECES}" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias(id_col),
                       F.col(text_col).cast("string").alias("_text")).mapInArrow(cut, schema)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts per length: [(lengths of a sequence, how many such)]."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        room = size
        while left and room < capacity:
            open_ = groups.get(room)
            while left and open_:
                items, n = open_.pop()
                k = min(left, n)
                if n > k:
                    open_.append((items, n - k))
                groups.setdefault(room - size, []).append((items + (size,), k))
                left -= k
            room += 1
        if left:
            per = capacity // size
            if left >= per:
                groups.setdefault(capacity - per * size, []).append(((size,) * per, left // per))
            if left % per:
                groups.setdefault(capacity - left % per * size, []).append(((size,) * (left % per), 1))
    return [g for room in groups.values() for g in room]


def _sums(counts: np.ndarray, room: int, sizes: list[int]) -> list[int]:
    """Bit sets: entry k has bit x where pieces of sizes[:k] can sum to x, x at most ``room``."""
    whole = (1 << (room + 1)) - 1
    out = [1]
    for size in sizes:
        bits, many, step = out[-1], min(int(counts[size]), room // size), 1
        while many:
            step = min(step, many)
            bits |= bits << step * size & whole
            many -= step
            step *= 2
        out.append(bits)
    return out


def _of_sum(counts: np.ndarray, sums: list[int], sizes: list[int], total: int) -> Iterator[list[int]]:
    """All multisets of pieces that sum to ``total``, those with more of the larger pieces first."""
    def options(k: int, left: int) -> Iterator[int]:
        size = sizes[k]
        return iter(range(min(int(counts[size]), left // size), -1, -1))

    if not total:
        yield []
        return
    path: list[tuple[int, int]] = []
    frames = [(len(sizes) - 1, total, options(len(sizes) - 1, total))] if sizes else []
    while frames:
        k, left, many = frames[-1]
        n = next((n for n in many if sums[k] >> (left - n * sizes[k]) & 1), None)
        if n is None:
            frames.pop()
            if frames:
                path.pop()
            continue
        left -= n * sizes[k]
        if left:
            path.append((sizes[k], n))
            frames.append((k - 1, left, options(k - 1, left)))
        else:
            yield [s for s, m in [*path, (sizes[k], n)] for _ in range(m)]


def _dominated(filling: list[int], waste: int, counts: np.ndarray, room: int) -> bool:
    """Whether an unused piece can take the place of nothing, of one smaller piece or of several that sum to no more."""
    free = counts[: room + 1].copy()
    for size in filling:
        free[size] -= 1
    unused = sum(1 << int(x) for x in np.flatnonzero(free > 0))
    one, several = 1, 0       # bit x: no piece or one piece of x; two or more that sum to x
    for size in filling:
        several |= several << size | (one & ~1) << size
        one |= 1 << size

    def up_to(bits: int, least: int) -> int:
        """Each bit moved up by every step from ``least`` to ``waste``."""
        out, width = bits, 1
        steps = waste - least + 1
        while width < steps:
            more = min(width, steps - width)
            out |= out << more
            width += more
        return out << least if steps > 0 else 0

    return bool(unused & (up_to(one, 1) | up_to(several, 0)))


def _filling(counts: np.ndarray, room: int, sizes: np.ndarray) -> list[int]:
    """A filling of ``room`` with the least waste.

    Depth-first from the largest length that fits, so best fit is the first incumbent. A branch is cut when all
    pieces it may still use leave as much waste as the incumbent has. Where that takes more than NODES nodes, the
    reachable sums decide.
    """
    supply = np.cumsum(counts[sizes] * sizes)
    best: list[int] = []
    least, nodes = room, NODES
    used: dict[int, int] = {}
    path: list[int] = []
    frames = [(room, int(np.searchsorted(sizes, room, "right")) - 1)]
    while frames and least and nodes:
        left, k = frames[-1]
        if k >= 0 and left - supply[k] < least:
            size = int(sizes[k])
            frames[-1] = (left, k - 1)
            if size > left or counts[size] <= used.get(size, 0):
                continue
            nodes -= 1
            path.append(size)
            used[size] = used.get(size, 0) + 1
            now = left - size
            if now < least:
                least, best = now, list(path)
            frames.append((now, int(np.searchsorted(sizes[: k + 1], now, "right")) - 1))
            continue
        frames.pop()
        if path and frames:
            used[path.pop()] -= 1
    if least and not nodes:
        own = [int(s) for s in sizes if s <= room and counts[s]]
        sums = _sums(counts, room, own)
        if room - sums[-1].bit_length() + 1 < least:
            best = next(_of_sum(counts, sums, own, sums[-1].bit_length() - 1))
    return best


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer sequences: total over capacity, and the same with every piece over half in its own
    sequence and pieces below k left out, for the best k."""
    size = np.arange(capacity + 1)
    n, total = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * size)]
    half, k = capacity // 2, np.arange(capacity // 2 + 1)
    large = n[-1] - n[half + 1]                               # pieces over half
    room = (n[capacity - k + 1] - n[half + 1]) * capacity - (total[capacity - k + 1] - total[half + 1])
    small = total[half + 1] - total[k]                        # pieces from k to half
    return max(int((large + np.maximum(0, -(-(small - room) // capacity))).max()), -(-int(total[-1]) // capacity))


def _choices(left: np.ndarray, capacity: int, spare: int, tries: list[int]) -> Iterator[tuple[list[int], int, int]]:
    """(pieces, times, waste) for the largest length left: the least waste first, then every other undominated
    filling within ``spare``, all as often as possible; then the same less often. ``left`` is as it was at every step."""
    sizes = np.flatnonzero(left)
    large = int(sizes[-1])
    room = capacity - large

    def times(filling: list[int], waste: int) -> int:
        need: dict[int, int] = {}
        for s in filling:
            need[s] = need.get(s, 0) + 1
        most = min(int(left[s]) // n for s, n in need.items())
        return min(most, spare // waste) if waste else most

    less = left.copy()
    less[large] -= 1
    first = _filling(less, room, sizes)
    waste = room - sum(first)
    if waste > spare:
        return
    kept = [([large, *first], waste)]
    yield kept[0][0], times(*kept[0]), waste
    own = [int(s) for s in sizes if s <= room and less[s]]
    sums = _sums(less, room, own)
    for waste in range(waste, min(spare, room) + 1):
        if not sums[-1] >> (room - waste) & 1:
            continue
        for filling in _of_sum(less, sums, own, room - waste):
            tries[0] -= 1
            if tries[0] <= 0:
                return
            if sorted(filling) == sorted(first) or _dominated(filling, waste, less, room):
                continue
            kept.append(([large, *filling], waste))
            yield kept[-1][0], times(*kept[-1]), waste
    for filling, waste in kept:
        for n in range(times(filling, waste) - 1, 0, -1):
            yield filling, n, waste


def _within(counts: np.ndarray, capacity: int, most: int, states: int) -> list[tuple[tuple[int, ...], int]] | None:
    """A packing into ``most`` sequences or fewer; None where there is none or ``states`` tries found none."""
    spare = most * capacity - int((counts * np.arange(capacity + 1)).sum())
    if spare < 0:
        return None
    left, tries = counts.copy(), [states]
    made: list[tuple[list[int], int, int]] = []
    failed: dict[bytes, int] = {}          # counts from which no packing with that much spare waste exists

    def state() -> bytes:
        return blake2b(left.tobytes(), digest_size=16).digest()

    def put(filling: list[int], n: int) -> None:
        for s in filling:
            left[s] -= n

    if not left.any():
        return []
    frames = [_choices(left, capacity, spare, tries)]
    while frames:
        pick = next(frames[-1], None)
        tries[0] -= 1
        if tries[0] <= 0:
            return None
        if pick is None:
            frames.pop()
            failed[state()] = spare
            if made:
                filling, n, waste = made.pop()
                put(filling, -n)
                spare += waste * n
            continue
        filling, n, waste = pick
        put(filling, n)
        if not left.any():
            return [(tuple(f), k) for f, k, _ in [*made, pick]]
        if failed.get(state(), -1) >= spare - waste * n:
            put(filling, -n)
            continue
        made.append(pick)
        spare -= waste * n
        frames.append(_choices(left, capacity, spare, tries))
    return None


def complete_bins(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bin completion on counts per length; best fit's packing where no search finds fewer sequences.

    Numbers of sequences are tried from the lower bound on, in steps that double as long as none is found.
    """
    incumbent = best_fit(counts, capacity)
    most = sum(n for _, n in incumbent)
    least, step = lower_bound(counts, capacity), 1
    while least < most:
        goal = min(least + step - 1, most - 1)
        made = _within(counts, capacity, goal, STATES)
        if made is None:
            least, step = goal + 1, step * 2
        else:
            incumbent, most, step = made, sum(n for _, n in made), 1
    return incumbent


def _places(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """Runs of ranks per length: pieces lo.. of a length go to sequences seq.. at one offset."""
    used = np.zeros(capacity + 1, np.int64)
    runs: list[tuple[int, int, int, int]] = []
    at = 0
    for items, times in patterns:
        offset = 0
        for size in items:
            runs.append((size, int(used[size]), at, offset))
            used[size] += times
            offset += size
        at += times
    cols = np.array(sorted(runs), np.int64).reshape(-1, 4)
    return {"size": cols[:, 0], "lo": cols[:, 1], "seq": cols[:, 2], "offset": cols[:, 3]}


JOIN_ROWS = 500_000      # rows of three numbers in one hash table


def ranked(pieces: DataFrame, parts: int, keys: list[str]) -> DataFrame:
    """``pieces`` with _rank: gapless from 0 among the pieces of a length.

    Counted per (length, hash bucket) first, so that the pieces of a common length are never
    ranked in one task.
    """
    cell = pieces.withColumn("_cell", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
    before = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    base = (cell.groupBy("length", "_cell").agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    own = F.row_number().over(Window.partitionBy("length", "_cell").orderBy(*keys))
    return (cell.withColumn("_own", own).join(base, ["length", "_cell"])
            .withColumn("_rank", F.col("_base") + F.col("_own") - 1).drop("_cell", "_own", "_base"))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids on demand).

    A null or empty text is the end id alone. Null ids and repeated rows are packed like any row (equal pieces take
    either place); an empty table gives an empty result. Other columns are not read.
    """
    made = token_pieces(docs, tokenizer, id_col, text_col, capacity, end_id, with_ids)
    pieces = stored(made.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in pieces.groupBy("length").count().collect():     # at most `capacity` rows
        counts[size] = n
    runs = _places(complete_bins(counts, capacity), capacity)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = ranked(pieces.drop("ids"), max(64, parts), [id_col, "piece", "start", "ids_crc32", "_row"])      # a stored number tells equal pieces apart

    key = runs["size"] << 44 | runs["lo"]

    @F.pandas_udf("sequence_id long, offset long")
    def placed(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        """Only two numbers of a piece go to Python."""
        size, rank = size.to_numpy(), rank.to_numpy()
        run = np.searchsorted(key, size << 44 | rank, "right") - 1
        return pd.DataFrame({"sequence_id": runs["seq"][run] + rank - runs["lo"][run], "offset": runs["offset"][run]})

    columns = [id_col, "piece", "start", "length", "ids_crc32"]
    place = [F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset")]
    at = base.withColumn("_place", placed("length", "_rank"))
    if not with_ids:
        return at.select(*columns, *place)
    # The ids pass one exchange and no sort: they meet the narrow rows' hash table, by the key they were stored with. Partitions
    # are as many as keep a table at JOIN_ROWS rows.
    tables = max(parts, -(-int(counts.sum()) // JOIN_ROWS))
    narrow = at.select("_row", *place).repartition(tables, "_row").hint("shuffle_hash")
    return pieces.repartition(tables, "_row").join(narrow, "_row").select(*columns, "ids", "sequence_id", "offset")

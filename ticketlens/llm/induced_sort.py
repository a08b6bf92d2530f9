"""External induced sorting of suffixes, with common-prefix values.

The suffixes of a byte text are sorted as far as ``depth`` bytes: the leftmost S-type suffixes are sorted
first, then every L-type suffix is induced from the next smaller ones in one ascending sweep, and every S-type
suffix in one descending sweep. A sweep reads one queue per first character, in order, and appends the
preceding suffixes to the queues of their own first character (a priority queue whose priorities are the
characters). Queue entries are tuples (suffix, common prefix with the entry before); the common prefix of an induced
pair is one more than the least value between its two sources. Queues live in memory up to a
budget and in an unlinked spill file of the task beyond it, and are read back in bounded batches.

Recursion on names is needed to order equal leftmost-S substrings; as no more than ``depth`` bytes count here, the
rounds that refine ties some characters at a time take its place and end after ``depth`` bytes.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

_BATCH = 1 << 18


class Queues:
    """A first-in-first-out queue of (suffix, common prefix) per first character."""

    def __init__(self, characters: int, budget: int):
        self.runs: list[list] = [[] for _ in range(characters)]
        self.budget, self.held, self.file = budget, 0, None

    def append(self, character: int, suffix: np.ndarray, common: np.ndarray) -> None:
        self.runs[character].append((suffix, common))
        self.held += suffix.nbytes + common.nbytes
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for runs in self.runs:
            for k, run in enumerate(runs):
                if isinstance(run[0], np.ndarray):
                    at = self.file.tell()
                    self.file.write(run[0].tobytes())
                    self.file.write(run[1].tobytes())
                    runs[k] = (at, len(run[0]))
        self.held = 0

    def read(self, character: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Runs first..last - 1 of a queue, joined."""
        suffix, common = [], []
        for one in self.runs[character][first:last]:
            if isinstance(one[0], np.ndarray):
                suffix.append(one[0])
                common.append(one[1])
            else:
                at, n = one
                self.file.seek(at)
                raw = self.file.read(5 * n)
                suffix.append(np.frombuffer(raw, np.int32, n))
                common.append(np.frombuffer(raw, np.uint8, n, 4 * n))
        return np.concatenate(suffix), np.concatenate(common)

    def batches(self, character: int, reverse: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The queue in batches of some runs; forward reading includes what is appended meanwhile."""
        runs = self.runs[character]
        size = lambda k: len(runs[k][0]) if isinstance(runs[k][0], np.ndarray) else runs[k][1]
        at = len(runs) if reverse else 0
        while at > 0 if reverse else at < len(runs):
            to, held = at, 0
            while held < _BATCH and (to > 0 if reverse else to < len(runs)):
                to += -1 if reverse else 1
                held += size(to if reverse else to - 1)
            yield self.read(character, min(at, to), max(at, to))
            at = to

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _types(x: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S); the end mark is S."""
    change = np.flatnonzero(x[1:] != x[:-1])
    s = np.ones(len(x), bool)
    s[: len(x) - 1] = np.repeat(x[change] < x[change + 1], np.diff(np.r_[-1, change]))
    return s


def _packed(code: np.ndarray, at: np.ndarray, chars: int, bits: int) -> np.ndarray:
    key = np.zeros(len(at), np.uint64)
    for j in range(chars):
        key <<= np.uint64(bits)
        key |= code[np.minimum(at + j, len(code) - 1)]
    return key


def _sorted_seeds(x: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted to ``depth`` characters, and each one's common prefix with the one before.

    Each round sorts the suffixes that are still tied by one number: their group and as many of
    their next characters (as ranks among those that occur) as fit beside it.
    """
    used = np.bincount(x, minlength=1) > 0
    bits = max(1, int(used.sum() - 1).bit_length())
    code = (np.cumsum(used) - 1).astype(np.uint8 if bits <= 8 else np.uint16)[x]
    at = at.astype(np.int64)
    common = np.zeros(len(at), np.int64)
    tied, group, done = np.arange(len(at)), np.zeros(len(at), np.uint64), 0
    while len(tied) and done < depth:
        chars = min((63 - int(group[-1]).bit_length()) // bits, depth - done)
        width = np.uint64(chars * bits)
        key = group << width | _packed(code, at[tied] + done, chars, bits)
        order = np.argsort(key)
        at[tied], key = at[tied][order], key[order]
        differ = key[1:] ^ key[:-1]
        same = np.zeros(len(differ), np.int64)
        for j in range(chars):
            same += (differ >> np.uint64(bits * j)) == 0
        beside = differ >> width == 0
        common[tied[1:][beside]] = done + same[beside]
        equal = np.r_[False, differ == 0]
        keep = equal | np.r_[equal[1:], False]
        done += chars
        tied = tied[keep]
        group = (np.cumsum(~equal)[keep]).astype(np.uint64)
        if len(group):      # dense numbers leave room for characters
            group = (np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1).astype(np.uint64)
    return at.astype(np.int32), np.minimum(common, depth).astype(np.uint8)


class _Sweep:
    """One sweep: sends the preceding suffixes of what is scanned to their queues."""

    def __init__(self, x: np.ndarray, wanted: np.ndarray, queues: Queues, depth: int, characters: int):
        self.x, self.wanted, self.queues, self.depth = x, wanted, queues, depth
        self.pending = np.zeros(characters, np.uint8)

    def begin(self) -> None:
        self.pending[:] = 0

    def scan(self, suffix: np.ndarray, common: np.ndarray) -> None:
        """Scan suffixes in order; common[0] is with the suffix scanned before (0: none)."""
        for a in range(0, len(suffix), _BATCH):
            self._scan(suffix[a: a + _BATCH], common[a: a + _BATCH])

    def _scan(self, suffix: np.ndarray, common: np.ndarray) -> None:
        pred = suffix - 1
        at = np.flatnonzero((suffix > 0) & self.wanted[pred])
        least = np.minimum.accumulate(common)
        if len(at):
            target = self.x[pred[at]]
            order = np.argsort(target, kind="stable")
            at, target = at[order], target[order]
            fresh = np.r_[True, target[1:] != target[:-1]]
            value = np.empty(len(at), np.uint8)
            value[fresh] = np.minimum(self.pending[target[fresh]], least[at[fresh]])
            if not fresh.all():
                old = ~fresh
                value[old] = _range_min(common, at[np.flatnonzero(old) - 1] + 1, at[old])
            value = np.minimum(value, self.depth - 1) + np.uint8(1)
            cuts = np.flatnonzero(fresh)
            ends = np.r_[cuts[1:], len(at)]
            moved = pred[at]
            for a, b in zip(cuts.tolist(), ends.tolist(), strict=True):
                self.queues.append(int(target[a]), moved[a:b], value[a:b])
            self.pending = np.minimum(self.pending, least[-1])
            after = np.minimum.accumulate(common[::-1])[::-1]
            last = at[ends - 1] + 1
            self.pending[target[cuts]] = np.where(last < len(common), after[np.minimum(last, len(common) - 1)], 255)
        else:
            self.pending = np.minimum(self.pending, least[-1])


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo..hi], both included."""
    span = hi - lo + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    top = int(level.max())
    table = np.empty((top + 1, len(values)), np.uint8)
    table[0] = values
    for k in range(1, top + 1):
        half = 1 << (k - 1)
        table[k] = table[k - 1]
        np.minimum(table[k - 1][:-half], table[k - 1][half:], out=table[k][:-half])
    return np.minimum(table[level, lo], table[level, hi - (1 << level) + 1])


def _direct(x: np.ndarray, a: int, b: int, depth: int) -> int:
    n = min(depth, len(x) - max(a, b))
    differ = np.flatnonzero(x[a: a + n] != x[b: b + n])
    return int(differ[0]) if len(differ) else n


def sorted_suffixes(parts: np.ndarray, ends: np.ndarray, depth: int,
                    budget: int = 256 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of (suffix, common prefix with the suffix before), in suffix order.

    ``parts`` is the concatenation of byte strings that end at ``ends``; suffixes are places in the text where each
    string is followed by one mark, so string k's place p stands at p + k. Common prefixes are
    exact up to ``depth``; order beyond it is not defined. ``budget`` bounds the bytes of queues kept in memory.
    """
    n = len(parts) + len(ends) + 1
    x = np.ones(n, np.uint16)
    inside = np.ones(n, bool)
    inside[ends + np.arange(len(ends))] = False
    inside[-1] = False
    x[inside] = parts.astype(np.uint16) + np.uint16(2)
    x[-1] = 0
    del inside
    small = _types(x)
    seeds = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + np.int32(1)
    seeds, seed_common = _sorted_seeds(x, seeds, depth)
    characters = 258
    seed_at = np.searchsorted(x[seeds], np.arange(characters + 1))
    large, less = Queues(characters, budget // 2), Queues(characters, budget // 2)
    try:
        sweep = _Sweep(x, ~small, large, depth, characters)
        last_large = np.full(characters, -1, np.int64)
        for c in range(characters):
            sweep.begin()
            first = True
            for suffix, common in large.batches(c):
                if first:
                    common = common.copy()
                    common[0] = 0
                    first = False
                sweep.scan(suffix, common)
                last_large[c] = suffix[-1]
            a, b = seed_at[c], seed_at[c + 1]
            if a < b:
                common = seed_common[a:b].copy()
                common[0] = _direct(x, int(last_large[c]), int(seeds[a]), depth) if last_large[c] >= 0 else 0
                sweep.scan(seeds[a:b], common)
        sweep = _Sweep(x, small, less, depth, characters)
        for c in range(characters - 1, -1, -1):
            sweep.begin()
            last, first = -1, True
            for suffix, common in less.batches(c):
                if first:
                    common = common.copy()
                    common[0] = 0
                    first = False
                sweep.scan(suffix, common)
                last = int(suffix[-1])
            carried = None
            for suffix, common in large.batches(c, reverse=True):
                turned = np.empty_like(common)
                turned[1:] = common[:0:-1]
                turned[0] = carried if carried is not None else (
                    _direct(x, last, int(suffix[-1]), depth) if last >= 0 else 0)
                carried = common[0]
                sweep.scan(suffix[::-1], turned)
        for c in range(characters):
            first = True
            for suffix, common in large.batches(c):
                if first:
                    common = common.copy()
                    common[0] = 0
                    first = False
                yield suffix, common
            carried = None
            for suffix, common in less.batches(c, reverse=True):
                turned = np.empty_like(common)
                turned[1:] = common[:0:-1]
                turned[0] = carried if carried is not None else (
                    _direct(x, int(last_large[c]), int(suffix[-1]), depth) if last_large[c] >= 0 else 0)
                carried = common[0]
                yield suffix[::-1], turned
    finally:
        large.close()
        less.close()

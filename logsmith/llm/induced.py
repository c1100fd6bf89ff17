"""External induced sorting of suffixes, with common-prefix values, to a bounded depth.

The text is a sequence of symbols with 0 as separator. Suffixes that are smaller than their
right neighbour's after a larger one (S*) are sorted first: one induction sorts the substrings
between them, which are named, and the sequence of names is ranked by doubling until the names
cover the depth (order beyond it does not matter); the levels of ranks also give the common
prefixes of neighbours. Two inductions then place all other suffixes. Their priority queue has
the first symbol as key and insertion order within it, because tuples (position, common prefix)
are inserted in rank order; it keeps what exceeds a memory budget in files. A tuple's common
prefix is one more than the least one between its source and the source before it in the same
bucket.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes of queued tuples in memory before they go to files.
QUEUE_BYTES = 16 << 20
_BLOCK = 1 << 19


def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int16)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


class DiskQueue:
    """First-in-first-out tuples (position, common prefix) for each symbol."""

    def __init__(self, folder: str, symbols: int, budget: int = QUEUE_BYTES):
        self.folder, self.budget, self.held = tempfile.mkdtemp(dir=folder), budget, 0
        self.parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(symbols)]
        self.size = [0] * symbols
        self.spilled = [0] * symbols

    def push(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        if len(at):
            self.parts[symbol].append((at, lcp))
            self.size[symbol] += len(at)
            self.held += at.nbytes + lcp.nbytes
            if self.held > self.budget:
                self._spill()

    def _spill(self) -> None:
        for symbol, parts in enumerate(self.parts):
            if parts:
                for i, name in enumerate(("at", "lcp")):
                    with open(f"{self.folder}/{symbol}.{name}", "ab") as f:
                        for part in parts:
                            part[i].tofile(f)
                self.spilled[symbol] += sum(len(p[0]) for p in parts)
                self.parts[symbol] = []
        self.held = 0

    def batches(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All tuples of a symbol, in order, in blocks."""
        n, parts = self.spilled[symbol], self.parts[symbol]  # as they are now: pushes may go on
        for start in range(0, n, _BLOCK):
            count = min(_BLOCK, n - start)
            yield (
                np.fromfile(f"{self.folder}/{symbol}.at", np.int64, count, offset=8 * start),
                np.fromfile(f"{self.folder}/{symbol}.lcp", np.int16, count, offset=2 * start),
            )
        at, lcp = joined(parts)
        for start in range(0, len(at), _BLOCK):
            yield at[start : start + _BLOCK], lcp[start : start + _BLOCK]

    def backwards(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at, lcp = joined(self.parts[symbol])
        for end in range(len(at), 0, -_BLOCK):
            yield at[max(0, end - _BLOCK) : end], lcp[max(0, end - _BLOCK) : end]
        for end in range(self.spilled[symbol], 0, -_BLOCK):
            start = max(0, end - _BLOCK)
            yield (
                np.fromfile(f"{self.folder}/{symbol}.at", np.int64, end - start, offset=8 * start),
                np.fromfile(f"{self.folder}/{symbol}.lcp", np.int16, end - start, offset=2 * start),
            )

    def close(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class SuffixSorter:
    """Adjacent suffixes of ``text`` (uint16 symbols, the last one 0) and their common prefixes
    up to ``depth``."""

    def __init__(self, text: np.ndarray, depth: int, folder: str, budget: int = QUEUE_BYTES):
        self.x, self.depth, self.folder, self.budget = text, depth, folder, budget
        self.symbols = int(text.max()) + 1
        self.small = self._types()  # True: S

    def _types(self) -> np.ndarray:
        x, n = self.x, len(self.x)
        small = np.zeros(n, bool)
        small[n - 1], known = True, True
        for end in range(n - 1, 0, -_BLOCK):  # right to left, a block of neighbours at a time
            start = max(0, end - _BLOCK)
            a, b = x[start:end], x[start + 1 : end + 1]
            different = np.flatnonzero(a != b)
            less = np.append(a[different] < b[different], known)
            small[start:end] = less[np.searchsorted(different, np.arange(end - start))]
            known = bool(small[start])
        return small

    def _common(self, a: int, b: int) -> int:
        """Symbols that two suffixes share, up to the depth."""
        p, q = self.x[a : a + self.depth], self.x[b : b + self.depth]
        m = min(len(p), len(q))
        different = np.flatnonzero(p[:m] != q[:m])
        return int(different[0]) if len(different) else m

    def _scatter(self, queue: DiskQueue, at: np.ndarray, lcp: np.ndarray | None, least: np.ndarray | None, to_small: bool, own: int):
        """Insert the left neighbours of a batch of sources; those of bucket ``own`` are
        returned instead."""
        x, depth = self.x, self.depth
        source = np.flatnonzero(at > 0)
        target = at[source] - 1
        source = source[self.small[target] == to_small]
        target = at[source] - 1
        symbol = x[target]
        order = np.argsort(symbol, kind="stable")
        edges = np.flatnonzero(np.diff(symbol[order])) + 1
        back = joined([])
        whole = int(lcp.min()) if lcp is not None and len(lcp) else depth
        met = {}
        for part in np.split(order, edges) if len(order) else []:
            s = int(symbol[part[0]])
            positions = target[part]
            if lcp is None:
                values = np.zeros(len(part), np.int16)
            else:
                i = source[part]
                starts = np.concatenate(([0], i[:-1] + 1))
                values = np.minimum.reduceat(lcp[: i[-1] + 1], starts)
                values[0] = min(int(values[0]), int(least[s]))
                values = np.minimum(values + 1, depth).astype(np.int16)
                met[s] = int(lcp[i[-1] + 1 :].min()) if i[-1] + 1 < len(lcp) else depth
            if s == own:
                back = (positions, values)
            else:
                queue.push(s, positions, values)
        if lcp is not None:
            np.minimum(least, whole, out=least)
            for s, value in met.items():
                least[s] = value
        return back

    def _induce(self, stars: np.ndarray, star_lcp: np.ndarray | None, found=None) -> np.ndarray | None:
        """Place all suffixes from the S* suffixes in order. With common prefixes, ``found`` gets
        (positions, lcp with the neighbour before) for the L and (with the one after) for the S
        suffixes; without, the S* suffixes are returned in the order of their substrings."""
        x, symbols, depth = self.x, self.symbols, self.depth
        with_lcp = star_lcp is not None
        large, small = (DiskQueue(self.folder, symbols, self.budget) for _ in range(2))
        least = np.full(symbols, -1, np.int16) if with_lcp else None  # -1: nothing inserted yet
        first = x[stars]
        bounds = np.searchsorted(first, np.arange(symbols + 1))
        done = DiskQueue(self.folder, symbols, self.budget)
        cross: dict[int, int] = {}
        for s in range(symbols):
            last = -1
            rounds = large.batches(s)
            while True:
                again: list[tuple[np.ndarray, np.ndarray]] = []
                for at, lcp in rounds:
                    done.push(s, at, lcp)
                    last = int(at[-1])
                    got = self._scatter(large, at, lcp if with_lcp else None, least, False, s)
                    if len(got[0]):
                        again.append(got)
                if not again:
                    break
                rounds = iter([joined(again)])
            a, b = bounds[s], bounds[s + 1]
            if b > a:
                for start in range(a, b, _BLOCK):
                    part = slice(start, min(b, start + _BLOCK))
                    lcp = None
                    if with_lcp:
                        lcp = star_lcp[part].copy()
                        if start == a:
                            lcp[0] = self._common(last, int(stars[a])) if last >= 0 else 0
                    self._scatter(large, stars[part], lcp, least, False, -1)
            if with_lcp and s + 1 < symbols:
                least[least >= 0] = 0  # the next bucket shares nothing with this one
        large.close()
        # the S suffixes, from the largest to the smallest
        order: list[np.ndarray] = []
        if with_lcp:
            least[:] = -1
        for s in range(symbols - 1, -1, -1):
            last = -1
            rounds = small.batches(s)
            while True:
                again = []
                for at, lcp in rounds:
                    if found:
                        found(at, lcp, last)
                    elif not with_lcp:
                        order.append(at[(at > 0) & ~self.small[at - 1]])
                    last = int(at[-1])
                    got = self._scatter(small, at, lcp if with_lcp else None, least, True, s)
                    if len(got[0]):
                        again.append(got)
                if not again:
                    break
                rounds = iter([joined(again)])
            following = None  # common prefix of the L suffix at hand with the one after it
            for at, lcp in done.backwards(s):
                down = None
                if with_lcp:
                    if following is None:
                        following = self._common(last, int(at[-1])) if last >= 0 else 0
                    down = np.concatenate(([following], lcp[:0:-1])).astype(np.int16)
                    following = int(lcp[0])
                    if found:
                        found(at[::-1], down, last)
                last = int(at[0])
                self._scatter(small, at[::-1], down, least, True, -1)
            if with_lcp:
                least[least >= 0] = 0
        small.close()
        done.close()
        if with_lcp:
            return None
        ends = np.array([len(x) - 1], np.int64)  # the last suffix has no source
        return np.concatenate([*order, ends])[::-1]

    def _named(self, stars: np.ndarray, by_substring: np.ndarray) -> np.ndarray:
        """Names of the S* substrings in text order, equal for equal ones."""
        x, n = self.x, len(self.x)
        place = np.searchsorted(stars, by_substring)
        length = np.append(np.diff(stars), 1)[place]  # up to the next S* symbol, that included
        a, b = by_substring[:-1], by_substring[1:]
        same = length[1:] == length[:-1]
        live = np.flatnonzero(same)
        k = 0
        while len(live):
            p, q = np.minimum(a[live] + k, n - 1), np.minimum(b[live] + k, n - 1)
            equal = x[p] == x[q]
            same[live[~equal]] = False
            live = live[equal & (k < length[live])]
            k += 1
        names = np.empty(len(stars), np.int64)
        names[place] = np.concatenate(([0], np.cumsum(~same)))
        return names

    def _sorted_stars(self) -> tuple[np.ndarray, np.ndarray]:
        """S* suffixes in order, and the common prefix of each with the one before."""
        x, depth = self.x, self.depth
        stars = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1
        rough = stars[np.argsort(x[stars], kind="stable")]
        ranks = self._named(stars, self._induce(rough, None))
        m, levels, step = len(stars), [ranks.astype(np.int32)], 1
        # two symbols a name at least; a name tells its substring up to the next S* symbol
        while 2 * step < depth + 2 and int(ranks.max()) + 1 < m:
            after = np.zeros(m, np.int64)
            after[: m - step] = ranks[step:] + 1
            key = ranks * (m + 1) + after
            order = np.argsort(key, kind="stable")
            ranks = np.empty(m, np.int64)
            ranks[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            levels.append(ranks.astype(np.int32))
            step *= 2
        order = np.argsort(ranks, kind="stable")
        del ranks
        i, j = order[:-1].copy(), order[1:].copy()
        for k in range(len(levels) - 1, -1, -1):  # as many equal names as the levels tell
            width = 1 << k
            inside = (i < m) & (j < m)
            equal = np.zeros(len(i), bool)
            equal[inside] = levels[k][i[inside]] == levels[k][j[inside]]
            i, j = i + width * equal, j + width * equal
        end = np.append(stars, len(x))
        lcp = end[np.minimum(i, m)] - stars[order[:-1]]
        p, q = stars[order[:-1]] + lcp, stars[order[1:]] + lcp
        live = np.flatnonzero((lcp < depth) & (np.maximum(p, q) < len(x)))
        while len(live):
            equal = x[p[live]] == x[q[live]]
            live = live[equal]
            lcp[live] += 1
            p[live] += 1
            q[live] += 1
            live = live[(lcp[live] < depth) & (np.maximum(p[live], q[live]) < len(x))]
        return stars[order], np.concatenate(([0], np.minimum(lcp, depth))).astype(np.int16)

    def repeated(self) -> np.ndarray:
        """A flag for each position: another suffix shares ``depth`` symbols with it."""
        flags = np.zeros(len(self.x), bool)

        def found(at: np.ndarray, lcp: np.ndarray, before: int) -> None:
            # lcp[i] is shared by at[i] and the suffix met before it
            deep = np.flatnonzero(lcp >= self.depth)
            if len(deep):
                flags[at[deep]] = True
                flags[at[deep[deep > 0] - 1]] = True
                if deep[0] == 0 and before >= 0:
                    flags[before] = True

        stars, lcp = self._sorted_stars()
        self._induce(stars, lcp, found)
        return flags


class Shard:
    """Regions gathered in a file, then sorted together."""

    def __init__(self, depth: int, budget: int = QUEUE_BYTES):
        self.depth, self.budget, self.lengths = depth, budget, []
        self.folder = tempfile.mkdtemp(prefix="induced-")
        self.file = open(os.path.join(self.folder, "text"), "wb")  # noqa: SIM115
        self.size = 0

    def add(self, region: bytes) -> None:
        symbols = np.zeros(len(region) + 1, np.uint16)
        np.add(np.frombuffer(region, np.uint8), 1, out=symbols[:-1], dtype=np.uint16)
        symbols.tofile(self.file)
        self.lengths.append(len(region))
        self.size += len(region) + 1

    def repeated_starts(self) -> list[np.ndarray]:
        """For each region: the starts of ``depth`` bytes that also start elsewhere in any
        region of the shard."""
        try:
            self.file.close()
            if not self.size:
                return []
            text = np.memmap(self.file.name, np.uint16, "r").view(np.ndarray)
            flags = SuffixSorter(text, self.depth, self.folder, self.budget).repeated()
            starts = np.cumsum([0, *(n + 1 for n in self.lengths)])
            return [np.flatnonzero(flags[s : s + max(0, n - self.depth + 1)]) for s, n in zip(starts, self.lengths)]
        finally:
            shutil.rmtree(self.folder, ignore_errors=True)


def repeated_starts(regions: list[bytes], depth: int, budget: int = QUEUE_BYTES) -> list[np.ndarray]:
    shard = Shard(depth, budget)
    for region in regions:
        shard.add(region)
    return shard.repeated_starts()

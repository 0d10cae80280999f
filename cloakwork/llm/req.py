"""Relative-error quantile sketch: compactors that protect the upper tail (Cormode, Karnin, Liberty,
Thaler, Vesely, "Relative Error Streaming Quantiles").

Level h holds items of weight 2**h. A full level is sorted and its lower part halved: every second
item, from a random start, moves up one level. The upper part stays, so ranks near 1 keep a
multiplicative error in (1 - rank). Sketches of partitions, days or files merge level by level.
"""

from __future__ import annotations

import math

import numpy as np

#: Sections that a new level starts with.
SECTIONS = 3


class _Level:
    __slots__ = ("buf", "sections", "size", "state")

    def __init__(self, k: int):
        self.buf: list[np.ndarray] = []
        self.sections, self.size, self.state = SECTIONS, float(k), 0

    def width(self) -> int:
        """Items of a section, an even number."""
        return max(4, 2 * round(self.size / 2))

    def capacity(self) -> int:
        return 2 * self.sections * self.width()

    def count(self) -> int:
        return sum(map(len, self.buf))


class ReqSketch:
    """k: section size; the error of a rank r is at most about 0.4 / k * (1 - r) of n, 99 times in 100."""

    def __init__(self, k: int = 64, seed: int = 0):
        if k < 4:
            raise ValueError("k must be at least 4")
        self.k, self.n, self.levels = k, 0, [_Level(k)]
        self.random = np.random.default_rng(seed)

    def update(self, values: np.ndarray) -> None:
        values = np.asarray(values, dtype=np.float64)
        values = values[~np.isnan(values)]
        if len(values):
            self.n += len(values)
            self.levels[0].buf.append(values)
            self._compress()

    def merge(self, other: ReqSketch) -> None:
        if other.k != self.k:
            raise ValueError("sketches of different k don't merge")
        self.n += other.n
        while len(self.levels) < len(other.levels):
            self.levels.append(_Level(self.k))
        for mine, its in zip(self.levels, other.levels):
            mine.buf += its.buf
            mine.state |= its.state
            if its.sections > mine.sections:
                mine.sections, mine.size = its.sections, its.size
        self._compress()

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            level = self.levels[h]
            if level.count() >= level.capacity():
                self._compact(h)
            h += 1

    def _compact(self, h: int) -> None:
        level = self.levels[h]
        items = np.sort(np.concatenate(level.buf))
        ones = ((level.state + 1) & ~level.state).bit_length()  # trailing ones of state, plus one
        kept = (2 * level.sections - min(ones, level.sections)) * level.width()
        low = (len(items) - kept) // 2 * 2
        if low <= 0:
            level.buf = [items]
            return
        up = items[:low][int(self.random.integers(2)) :: 2]
        level.buf = [items[low:]]
        level.state += 1
        if level.state >= 1 << (level.sections - 1) and level.size / math.sqrt(2) >= 4:
            level.sections *= 2
            level.size /= math.sqrt(2)
        if h + 1 == len(self.levels):
            self.levels.append(_Level(self.k))
        self.levels[h + 1].buf.append(up)

    def _weighted(self) -> tuple[np.ndarray, np.ndarray]:
        parts = [(np.concatenate(x.buf), 1 << h) for h, x in enumerate(self.levels) if x.count()]
        values = np.concatenate([v for v, _ in parts])
        weights = np.concatenate([np.full(len(v), w, dtype=np.int64) for v, w in parts])
        order = np.argsort(values, kind="stable")
        return values[order], np.cumsum(weights[order])

    def at_ranks(self, ranks: list[int]) -> list[float | None]:
        """The values whose estimated rank first reaches each of the given ranks (1..n)."""
        if not self.n:
            return [None] * len(ranks)
        values, cum = self._weighted()
        at = np.searchsorted(cum, np.clip(ranks, 1, self.n), side="left")
        return [float(values[min(i, len(values) - 1)]) for i in at]

    def quantiles(self, fractions: list[float]) -> list[float | None]:
        """The smallest value that at least the fraction of all values doesn't exceed, estimated."""
        return self.at_ranks([max(1, math.ceil(round(q * self.n, 9))) for q in fractions])

    def rank(self, value: float) -> int:
        """About how many values don't exceed value."""
        if not self.n:
            return 0
        values, cum = self._weighted()
        i = np.searchsorted(values, value, side="right")
        return int(cum[i - 1]) if i else 0

    def slack(self, fraction: float) -> int:
        """Ranks by which an estimate at the fraction may be off, 99 times in 100."""
        return int(math.ceil(0.4 / self.k * (1 - fraction) * self.n)) + 1

    def to_bytes(self) -> bytes:
        head = [self.k, self.n, len(self.levels)]
        for x in self.levels:
            head += [x.count(), x.sections, x.state, int(round(x.size * 1e6))]
        bufs = [b for x in self.levels for b in x.buf]
        return np.asarray(head, dtype=np.int64).tobytes() + (np.concatenate(bufs) if bufs else np.empty(0)).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, seed: int = 0) -> ReqSketch:
        k, n, count = (int(x) for x in np.frombuffer(data, dtype=np.int64, count=3))
        head = np.frombuffer(data, dtype=np.int64, count=4 * count, offset=24).reshape(count, 4)
        values = np.frombuffer(data, dtype=np.float64, offset=24 + 32 * count)
        new, at = cls(k, seed), 0
        new.n, new.levels = n, []
        for size, sections, state, width in head.tolist():
            level = _Level(k)
            level.sections, level.state, level.size = sections, state, width / 1e6
            level.buf = [values[at : at + size]]
            at += size
            new.levels.append(level)
        return new

"""An FM-index over the words of a shard: suffix array, wavelet matrix, backward search, sampled positions.

All steps work on whole numpy arrays: a search takes many phrases at once, one word a step from their ends,
and locating walks all occurrences together until each stands on a sampled row.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8
_LOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Suffixes of ``x`` in order. The greatest common prefix must end within ``x``: its last value is unique.

    Several values are packed in the first key; after that only suffixes that still agree are sorted, by the
    rank of what follows, twice as far each round.
    """
    n = len(x)
    bits = max(1, int(x.max()).bit_length())
    width = min(n, max(1, 62 // bits))
    key = x.astype(np.int64)
    for j in range(1, width):
        key <<= bits
        key[: n - j] |= x[j:]
    order = np.argsort(key)
    key = key[order]
    head = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    slots = _shared(head)
    reach = width
    while len(slots):
        members = order[slots]
        near, far = rank[members], rank[np.minimum(members + reach, n - 1)]
        key = near * n + far
        turn = np.argsort(key)
        members, key = members[turn], key[turn]
        head = np.r_[True, key[1:] != key[:-1]]
        order[slots] = members
        rank[members] = np.maximum.accumulate(np.where(head, slots, 0))
        slots = slots[_shared(head)]
        reach *= 2
    return order


def _shared(head: np.ndarray) -> np.ndarray:
    """Places of those that stand in a group of two or more; ``head`` marks where groups begin."""
    return np.flatnonzero(~(head & np.r_[head[1:], True]))


class Ranked:
    """A row of bits with counts of ones before any place."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)].astype(np.int32)

    @classmethod
    def of(cls, bits: np.ndarray) -> "Ranked":
        packed = np.packbits(bits, bitorder="little")
        return cls(np.r_[packed, np.zeros(8 + -len(packed) % 8, np.uint8)].view(np.uint64))

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & _LOW[at & 63])

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class Index:
    """FM-index of ``ids`` (from 1; 0 ends every document), to be searched for rows of ids."""

    def __init__(self, n: int, sizes: np.ndarray, levels: list[Ranked], marks: Ranked, places: np.ndarray):
        self.n, self.levels, self.marks, self.places = n, levels, marks, places
        self.zeros = [n - int(level.ones(np.array([n]))[0]) for level in levels]
        self.sizes = sizes
        self.first = np.r_[0, np.cumsum(sizes)]  # rows that begin with a lesser id
        at = np.zeros(len(sizes), np.int64)
        self.base = self._down(np.arange(len(sizes)), at)  # where the wavelet matrix keeps each id

    @classmethod
    def build(cls, ids: np.ndarray) -> "Index":
        """``ids`` is not empty and ends with 0."""
        n = len(ids)
        ends = np.flatnonzero(ids == 0)
        unlike = ids.astype(np.int64) + (len(ends) - 1)
        unlike[ends] = np.arange(len(ends))  # so no common prefix passes a document's end
        order = suffix_array(unlike)
        last = ids[order - 1]
        keep = (order % SAMPLE == 0) | (ids[order - 1] == 0)  # a document's first place ends every walk
        levels = []
        for shift in reversed(range(max(1, int(ids.max()).bit_length()))):
            bits = (last >> shift) & 1 == 1
            levels.append(Ranked.of(bits))
            last = np.concatenate([last[~bits], last[bits]])
        return cls(n, np.bincount(ids), levels, Ranked.of(keep), order[keep].astype(np.int32))

    def _down(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where ids ``c`` before the places ``at`` of the last column come to stand."""
        for k, level in enumerate(self.levels):
            one = (c >> (len(self.levels) - 1 - k)) & 1 == 1
            ones = level.ones(at)
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return at

    def step(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Backward step: rows before which ``c`` goes before the rows ``at``."""
        return self.first[c] + self._down(c, at) - self.base[c]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of rows of each phrase; a phrase is a row of ids from 1 on, -1 before its first word."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        live = np.arange(len(phrases))
        for column in reversed(range(phrases.shape[1])):
            live = live[phrases[live, column] >= 0]
            if not len(live):
                break
            c = phrases[live, column]
            low[live], high[live] = self.step(c, low[live]), self.step(c, high[live])
            live = live[low[live] < high[live]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the shard at which the suffixes of ``rows`` begin."""
        rows, out, walked = rows.copy(), np.empty(len(rows), np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            found = self.marks.bit(rows[live])
            own = live[found]
            out[own] = self.places[self.marks.ones(rows[own])] + walked
            live = live[~found]
            at, c = rows[live], np.zeros(len(live), np.int64)
            for k, level in enumerate(self.levels):  # the id in the last column, and its rank, at once
                one, ones = level.bit(at), level.ones(at)
                c = 2 * c + one
                at = np.where(one, self.zeros[k] + ones, at - ones)
            rows[live] = self.first[c] + at - self.base[c]
            walked += 1
        return out

    def to_bytes(self) -> dict[str, bytes]:
        """Columns of a table row; counts of ones are made anew on reading."""
        return {
            "sizes": self.sizes.astype(np.int32).tobytes(),
            "levels": b"".join(level.words.tobytes() for level in self.levels),
            "marks": self.marks.words.tobytes(),
            "places": self.places.tobytes(),
        }

    @classmethod
    def from_bytes(cls, n: int, sizes: bytes, levels: bytes, marks: bytes, places: bytes) -> "Index":
        marked = np.frombuffer(marks, np.uint64)
        rows = np.frombuffer(levels, np.uint64).reshape(-1, len(marked))
        return cls(n, np.frombuffer(sizes, np.int32).astype(np.int64), [Ranked(r) for r in rows], Ranked(marked), np.frombuffer(places, np.int32))

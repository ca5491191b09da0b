"""Words, lines and shingles of Arrow text columns, found with whole-array numpy steps.

A word is a longest run of bytes other than ASCII space and tab to carriage
return, which is ``[^\\x20\\x09-\\x0D]+`` on the text. Word hashes are 64-bit
and, unless asked otherwise, equal for words that differ in the case of A-Z.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
STEP = 0x9E3779B97F4A7C15 | 1
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_weights(fold: bool) -> np.ndarray:
    """A random weight for each byte; zero for white space, shared by A-Z and a-z if folded."""
    weights = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(STEP))
    if fold:
        weights[65:91] = weights[97:123]
    weights[list(SPACES)] = 0
    return weights


def per_worker(name: str, make: Callable[[], object]) -> object:
    """What a worker process makes once and keeps from task to task.

    Functions that are shipped by value have no module of their own to keep it in.
    """
    held = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def free_worker() -> None:
    """Drop what :func:`per_worker` keeps, for operators that need the memory themselves."""
    sys.modules.pop("_kept_by_worker", None)


class Powers:
    """Powers of STEP and of its inverse, modulo 2**64, as far as they were asked for."""

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(n - 1, 1).bit_length()
            for name, base in (("up", STEP), ("down", pow(STEP, -1, 1 << 64))):
                each = np.full(size, base, np.uint64)
                each[0] = 1
                setattr(self, name, np.multiply.accumulate(each))
        return self.up, self.down


class Block:
    """Consecutive texts of a batch: their bytes, and where each begins and ends."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray, powers: Powers):
        self.first, self.data, self.offsets, self.powers = first, data, offsets, powers
        self.rows = len(offsets) - 1

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of the longest runs of marked bytes that stay in one text."""
        data, offsets = self.data, self.offsets
        before = np.empty(len(data), bool)
        before[1:] = inside[:-1]
        after = np.empty(len(data), bool)
        after[:-1] = inside[1:]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        ends = offsets[1:][offsets[1:] > 0]
        after[ends - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        space = np.zeros(256, bool)
        space[list(SPACES)] = True
        return self.runs(~space[self.data]) if len(self.data) else (np.empty(0, np.int64),) * 2

    def bounds(self, starts: np.ndarray) -> np.ndarray:
        """Where each text's entries begin among sorted byte positions; one more than texts."""
        return np.searchsorted(starts, self.offsets)

    def rows_of(self, starts: np.ndarray) -> np.ndarray:
        """The text, from 0 in this block, that holds each byte position."""
        return np.repeat(np.arange(self.rows), np.diff(self.bounds(starts)))

    def hashes(self, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte range; ranges are sorted and don't overlap."""
        if not len(starts):
            return np.empty(0, np.uint64)
        up, down = self.powers.upto(len(self.data))
        sums = np.empty(len(self.data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(weights[self.data] * up[: len(self.data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts])

    def bytes_of(self, start: int, end: int) -> bytes:
        return self.data[start:end].tobytes()


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks of whole texts; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, where, held = texts.buffers()
    ends = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    ends = ends.astype(np.int64)
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    row, powers = 0, Powers()
    while row < len(texts):
        last = int(np.searchsorted(ends, ends[row] + size, side="right")) - 1
        last = min(max(last, row + 1), len(texts))
        yield Block(row, data[ends[row] : ends[last]], ends[row : last + 1] - ends[row], powers)
        row = last


def windows(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and 64-bit hash of every run of ``k`` words that lies in one text.

    ``hashes`` are those of all words, ``counts`` the words of each text.
    """
    rows = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(hashes))  # words from here to the text's end
    begins = np.flatnonzero(left >= k)
    out = np.full(len(begins), k, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(STEP) + hashes[begins + j])
    return rows[begins], begins, out


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every ``k``-word shingle, in no order; texts of fewer words have them all as one."""
    found = [windows(hashes, counts, k)]
    for n in range(1, k):
        if (counts == n).any():
            short = np.repeat(counts == n, counts)
            rows, _, out = windows(hashes[short], counts[counts == n], n)
            found.append((np.flatnonzero(counts == n)[rows], None, out))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[2] for x in found])


def total(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of consecutive values between bounds, of which there is one more than sums."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def code_points(data: np.ndarray) -> np.ndarray:
    """Marks the first byte of each code point in UTF-8."""
    return (data & 0xC0) != 0x80


def repeats(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks entries that their row holds twice or more, and all but one of each of these."""
    keys = mix(hashes + mix(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys)
    keys = keys[order]
    same = np.zeros(len(order), bool)
    same[1:] = keys[1:] == keys[:-1]
    twice, later = np.empty(len(order), bool), np.empty(len(order), bool)
    later[order] = same
    twice[order] = same | np.append(same[1:], False)
    return twice, later

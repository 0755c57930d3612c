"""Words of many texts at once: spans and 64-bit hashes as arrays, without a Python object for each word."""

from __future__ import annotations

import numpy as np

from .common import CHUNK_BYTES, mix64

_BASE = 0x2545F4914F6CDD1D
_MASK = (1 << 64) - 1
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

#: The separators of the word contract: space and the bytes 0x09 to 0x0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def small_latin(data: np.ndarray) -> np.ndarray:
    """The bytes with the capitals of UTF-8's Latin-1 letters made small (A-Z are left to LOWER)."""
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    if len(at):
        data = data.copy()
        data[at] += 32
    return data


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, CHUNK_BYTES + (1 << 16))
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.full(n, np.uint64(base))
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers


def spans(data: np.ndarray, at: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; a word never crosses the end of a text."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separator[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = LOWER) -> np.ndarray:
    """A hash of each span's bytes (after fold), whatever its place. Long inputs go in parts cut between spans."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, side="right")))
        low, high = int(starts[i]), int(ends[j - 1])
        part = data[low:high]
        power, inverse = _power_tables(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part if fold is None else fold[part]] * power[: len(part)], out=total[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix64((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        i = j
    return out


def words(data: np.ndarray, at: np.ndarray, fold: np.ndarray | None = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, first): the words of text i are first[i] to first[i + 1]."""
    starts, ends = spans(data, at)
    return starts, ends, span_hashes(data, starts, ends, fold), np.searchsorted(starts, at)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of size words; a shorter text is one run, none has none."""
    n = len(hashes)
    mul = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(size)]
    if n >= size:
        run = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            run += hashes[k : n - size + 1 + k] * mul[k]
        run = mix64(run)
    else:
        run = np.zeros(0, np.uint64)
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if j - i >= size:
            out.append(np.unique(run[i : j - size + 1]))
        elif j > i:
            short = sum(int(h) * int(m) for h, m in zip(hashes[i:j].tolist(), mul, strict=False)) + (j - i) * 0xD1B54A32D192ED03
            out.append(mix64(np.array([short & _MASK], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

"""Name similarity: twice the matched characters over all characters, matching longest blocks first. Not symmetric.

A pair's longest common block is matched (of equals the one that begins first in a, then in b), then what lies before
it and what lies behind, until nothing is common. From 200 characters of b on, characters that make up more than a
hundredth of b start no block; they only prolong one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import company_key

#: What counts as the same company.
THRESHOLD = 0.7
#: Length of b from which common characters start no block, and cells of a table that is filled at a time.
LONG, CELLS = 200, 1 << 21


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _popular(b: np.ndarray) -> np.ndarray:
    """Places of b whose character makes up more than a hundredth, and one, of it."""
    _, of, n = np.unique(b, return_inverse=True, return_counts=True)
    return (n > len(b) // 100 + 1)[of]


def _longest_blocks(a: np.ndarray, b: np.ndarray, quiet: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin in a, begin in b, length) for each row (a from, a to, b from, b to) of part, all rows of a table at once."""
    rows, wide_a, wide_b = len(part), int((part[:, 1] - part[:, 0]).max()), int((part[:, 3] - part[:, 2]).max())

    def laid_out(codes: np.ndarray, low: np.ndarray, high: np.ndarray, width: int, none: int) -> np.ndarray:
        at = low[:, None] + np.arange(width)
        return np.where(at < high[:, None], codes[np.minimum(at, len(codes) - 1)], none)

    left, right = laid_out(a, part[:, 0], part[:, 1], wide_a, -1), laid_out(b, part[:, 2], part[:, 3], wide_b, -2)
    starts = laid_out(np.where(quiet, -3, b), part[:, 2], part[:, 3], wide_b, -2) if quiet.any() else right
    size, end_a, end_b = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    run = np.zeros((rows, wide_b + 1), np.int32)
    for i in range(wide_a):  # run[j + 1]: length of the block that ends at i and j
        run[:, 1:] = (run[:, :-1] + 1) * (starts == left[:, i : i + 1])
        best = run.max(axis=1)
        more = np.flatnonzero(best > size)
        if len(more):
            size[more], end_a[more], end_b[more] = best[more], i + 1, run[more].argmax(axis=1)
    at_a, at_b = end_a - size, end_b - size
    if starts is not right:  # prolonged over the characters that start no block
        for step in (-1, 1):
            going = np.arange(rows)
            while len(going):
                x, y = (at_a[going] - 1, at_b[going] - 1) if step < 0 else (at_a[going] + size[going], at_b[going] + size[going])
                inside = (x >= 0) & (y >= 0) & (x < wide_a) & (y < wide_b)
                going, x, y = going[inside], x[inside], y[inside]
                going = going[left[going, x] == right[going, y]]
                size[going] += 1
                if step < 0:
                    at_a[going] -= 1
                    at_b[going] -= 1
    return part[:, 0] + at_a, part[:, 2] + at_b, size


def block_ratios(first: Sequence[str], second: Sequence[str]) -> np.ndarray:
    """The ratios of many pairs: their open parts are matched together, round by round."""
    (a, at_a), (b, at_b) = _codes(first), _codes(second)
    quiet = np.zeros(len(b), bool)
    for i in np.flatnonzero(np.diff(at_b) >= LONG).tolist():
        quiet[at_b[i] : at_b[i + 1]] = _popular(b[at_b[i] : at_b[i + 1]])
    matched, total = np.zeros(len(first), np.int64), np.diff(at_a) + np.diff(at_b)
    pair, part = np.arange(len(first)), np.stack([at_a[:-1], at_a[1:], at_b[:-1], at_b[1:]], axis=1)
    while len(part):
        open_ = (part[:, 0] < part[:, 1]) & (part[:, 2] < part[:, 3])
        pair, part = pair[open_], part[open_]
        order = np.lexsort((part[:, 3] - part[:, 2], part[:, 1] - part[:, 0]))
        pair, part = pair[order], part[order]
        more: list[np.ndarray] = [np.zeros((0, 4), np.int64)]
        of: list[np.ndarray] = [np.zeros(0, np.int64)]
        i = 0
        while i < len(part):
            j = min(len(part), i + max(1, CELLS // (int((part[i:, 3] - part[i:, 2]).max()) + 1)))
            x, y, size = _longest_blocks(a, b, quiet, part[i:j])
            np.add.at(matched, pair[i:j], size)
            hit = size > 0
            low, high = part[i:j].copy(), part[i:j].copy()
            low[:, 1], low[:, 3], high[:, 0], high[:, 2] = x, y, x + size, y + size
            more += [low[hit], high[hit]]
            of += [pair[i:j][hit]] * 2
            i = j
        pair, part = np.concatenate(of), np.concatenate(more)
    return np.where(total > 0, 2.0 * matched / np.maximum(total, 1), 1.0)


@F.pandas_udf(T.DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """No built-in function computes it; Arrow carries the two columns in batches, and a batch is matched as one."""
    known = a.notna() & b.notna()
    out = pd.Series(np.nan, index=a.index, dtype="float64").astype(object).where(known, None)
    if known.any():
        out[known] = block_ratios(a[known].tolist(), b[known].tolist())
    return out.astype("Float64")


def similarity(a: Column, b: Column) -> Column:
    return block_ratio(company_key(a), company_key(b))


def lengths_allow(key_a: Column, key_b: Column, threshold: float = THRESHOLD) -> Column:
    """The ratio is at most 2 * shorter / (both lengths), so other pairs cannot reach the threshold."""
    a, b = F.length(key_a), F.length(key_b)
    return 2 * F.least(a, b) >= threshold * (a + b)


_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def letter_counts(key: Column) -> Column:
    """How often each letter, digit and the space is in a key, then all other characters together."""
    counts = [F.length(key) - F.length(F.replace(key, F.lit(c))) for c in _LETTERS]
    return F.array(*counts, F.length(F.regexp_replace(key, "[a-z0-9 ]", "")))


def placed_grams(key: Column, size: int) -> Column:
    """Each run of size characters of a key and where it begins, from 0."""
    n = F.length(key) - size + 1
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(F.substring(key, i + 1, F.lit(size)).alias("gram"), i.alias("place")))


def most_matched(letters_a: str, letters_b: str, pairs_a: str, pairs_b: str, size_a: Column, size_b: Column) -> Column:
    """Characters that a pair of keys can match at most.

    Matched characters are common ones. And m matched characters in several blocks have at least one unmatched one, of
    all - 2 m, between two blocks, so at least m - (all - 2 m) - 1 pairs of neighbours are common: m is at most
    (all + common pairs + 1) / 3. letters: letter_counts; pairs: arrays of two-character runs.
    """
    letters = F.aggregate(F.zip_with(letters_a, letters_b, lambda a, b: F.least(a, b)), F.lit(0), lambda total, n: total + n)
    common = F.size(F.filter(pairs_a, lambda g: F.array_contains(pairs_b, g)))
    return F.least(letters, F.floor((size_a + size_b + common + 1) / 3).cast("int"))

"""Periodic runs of words, by string synchronising sets.

A run is a stretch of words with smallest period q, as long as max(LEAST, REPEATS * q) words or longer, that no
neighbouring word extends with period q. A text's words become numbers, exactly, by a dictionary of its own; the texts
of a batch stand in one array, none sharing a number with another, so that no run crosses from text to text.

Scale by scale (t = 8, 16, 32, ...), for periods of t + 1 to 2 t words:
1. Every window of t words has a hash. Windows inside runs of periods up to t / 4, which the scales before have found,
   are highly periodic and left out; periods up to SMALL are found at once, by comparing each word with the q-th before.
2. Position i is chosen if the least hash of the windows that begin at i to i + t is that of the first or the last of
   them. Whether it is chosen depends on the 2 t words from i on alone, and any t neighbouring positions hold one,
   unless all windows around are highly periodic: a synchronising set.
3. Equal contexts (the 2 t words from a chosen position on) that follow each other at a distance in the scale's range
   propose it as a period. In a run of period p the contexts at s and s + p are equal and none between is, since a
   context is at least as long as p; the run is long enough for one such pair; and it is not highly periodic at this
   scale, since periods of p and t / 4 together would give it a smaller one. So every run is proposed.
4. Proposals are extended to both sides by comparing hashes of stretches, in a binary search; then each word of a run
   is compared with the one a period before. A run that this comparison breaks (equal hashes of unequal stretches) is
   extended word by word.
Where two periods give the same stretch, the larger is a multiple of the smaller and goes.

Null and empty texts and texts without words have no runs. A text of any length is taken whole, CHUNK_BYTES or one
text at a time. Repeated rows and equal texts get equal results. A null doc_id stays null. Other columns are not read,
whatever their names; an empty table gives no rows. Of runs with equal exponents the one that begins first, then the
one with the smaller period, comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import flat, mix64, pieces

#: Words and periods that a run has at least.
LEAST, REPEATS = 6, 4
#: Periods that are found by direct comparison; the first scale.
SMALL = FIRST = 8
_BASE = 0x2545F4914F6CDD1D


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches of True with at least that many."""
    edge = np.diff(np.concatenate([[0], same.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= least
    return starts[long], ends[long]


class Hashes:
    """Hashes of stretches of a word array, from prefix sums modulo 2^64; what they say is always confirmed on the words."""

    def __init__(self, word: np.ndarray):
        n = len(word)
        base, inverse = np.full(n + 1, np.uint64(_BASE)), np.full(n + 1, np.uint64(pow(_BASE, -1, 1 << 64)))
        base[0] = inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix64(word.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(base)[:n], out=self.total[1:])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.total[start + size] - self.total[start]) * self.inverse[start]

    def windows(self, size: int) -> np.ndarray:
        return (self.total[size:] - self.total[:-size]) * self.inverse[: len(self.total) - size]


def _extended(word: np.ndarray, hashes: Hashes, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches with these periods around these positions: starts and ends."""
    n, later = len(word), at + period

    def common_length(limit: np.ndarray, equal) -> np.ndarray:
        low, high = np.zeros_like(limit), limit.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            fits = equal(middle) & open_
            low, high = np.where(fits, middle, low), np.where(fits | ~open_, high, middle - 1)
        return low

    right = common_length(n - later, lambda k: hashes.of(at, k) == hashes.of(later, k))
    left = common_length(at, lambda k: hashes.of(at - k, k) == hashes.of(later - k, k))
    starts, ends = at - left, later + right
    for i in range(len(at)):
        s, e, p = int(starts[i]), int(ends[i]), int(period[i])
        if not np.array_equal(word[s + p : e], word[s : e - p]):  # equal hashes of unequal stretches
            s = int(at[i])
            e = s + p
            while e < n and word[e] == word[e - p]:
                e += 1
            while s and word[s - 1] == word[s - 1 + p]:
                s -= 1
            starts[i], ends[i] = s, e
    return starts, ends


def synchronising_set(least_hash: np.ndarray, periodic: np.ndarray, t: int) -> np.ndarray:
    """Chosen positions: hashes of the windows of t words, and which of the windows are highly periodic."""
    worst = np.uint64(0xFFFFFFFFFFFFFFFF)
    own = np.where(periodic, worst, np.minimum(least_hash, worst - np.uint64(1)))
    n = len(own) - t
    if n <= 0:
        return np.zeros(0, np.int64)
    low, width = own, 1
    while width * 2 <= t + 1:  # minima of windows of a power of two, then of two that overlap
        low, width = np.minimum(low[:-width], low[width:]), width * 2
    low = np.minimum(low[:n], low[t + 1 - width :][:n])
    return np.flatnonzero((low != worst) & ((low == own[:n]) | (low == own[t:])))


def find_runs(word: np.ndarray, longest: int | None = None, least: int = LEAST, repeats: int = REPEATS) -> np.ndarray:
    """(start, length, period) of all runs, in this order. longest: words of the longest text in the array."""
    n = len(word)
    longest = n if longest is None else longest
    found: list[np.ndarray] = []  # start, end, period

    def add(starts: np.ndarray, ends: np.ndarray, period: np.ndarray | int) -> None:
        rows = np.stack([starts, ends, np.broadcast_to(period, starts.shape)], axis=1)
        found.append(rows[rows[:, 1] - rows[:, 0] >= np.maximum(least, repeats * rows[:, 2])])

    for q in range(1, min(SMALL, longest // repeats) + 1):
        starts, ends = _stretches(word[q:] == word[:-q], max(least, repeats * q) - q)
        add(starts, ends + q, q)
    t = FIRST
    if repeats * (t + 1) <= longest:
        hashes = Hashes(word)
    while repeats * (t + 1) <= longest:
        periodic = np.zeros(n - t + 2, np.int32)
        known = np.concatenate(found)
        known = known[(known[:, 2] * 4 <= t) & (known[:, 1] - known[:, 0] >= t)]
        np.add.at(periodic, known[:, 0], 1)
        np.add.at(periodic, known[:, 1] - t + 1, -1)
        windows = mix64(hashes.windows(t))
        chosen = synchronising_set(windows, np.cumsum(periodic[: len(windows)]) > 0, t)
        context = hashes.of(chosen, 2 * t)
        order = np.argsort(context, kind="stable")
        same = np.flatnonzero(context[order[1:]] == context[order[:-1]])
        at, distance = chosen[order[same]], chosen[order[same + 1]] - chosen[order[same]]
        fits = (distance > t) & (distance <= 2 * t)
        at, distance = at[fits], distance[fits]
        if len(at):
            first = np.lexsort((at, distance))  # a chain of equal distances that touch is one proposal
            at, distance = at[first], distance[first]
            head = np.ones(len(at), bool)
            head[1:] = (distance[1:] != distance[:-1]) | (at[1:] > at[:-1] + distance[1:])
            starts, ends = _extended(word, hashes, at[head], distance[head])
            add(starts, ends, distance[head])
        t *= 2
    rows = np.unique(np.concatenate([np.zeros((0, 3), np.int64), *found]), axis=0)
    smallest = np.ones(len(rows), bool)
    smallest[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[smallest]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return np.stack([rows[:, 0], rows[:, 1] - rows[:, 0], rows[:, 2]], axis=1)


def _numbered(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of the texts, one number array for all, and where each text begins in it."""
    words, numbers, base = [], [], 0
    for text in texts:
        own = text.split()  # at the bytes 0x20 and 0x09 to 0x0D
        known: dict[bytes, int] = {}
        numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in own), np.int64, len(own)) + base)
        words.append(own)
        base += len(known)
    return words, np.concatenate([np.zeros(0, np.int64), *numbers]), np.cumsum([0, *map(len, words)])


def runs(docs: DataFrame, least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: all runs as start, length and period, by start, then period, and
    the text's words, joined by single spaces, without those that a run has after its first period."""
    if repeats < 4:
        raise ValueError("scales reach runs of four periods and more")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat(batch.column("text"))
            raw = data.tobytes()
            for i, j in pieces(at):
                words, number, first = _numbered([raw[a:b] for a, b in zip(at[i:j].tolist(), at[i + 1 : j + 1].tolist(), strict=True)])
                found = find_runs(number, int(np.diff(first).max(initial=0)), least, repeats)
                dropped = np.zeros(len(number) + 1, np.int64)
                np.add.at(dropped, found[:, 0] + found[:, 2], 1)
                np.add.at(dropped, found[:, 0] + found[:, 1], -1)
                dropped = np.cumsum(dropped) > 0
                texts = [b" ".join(w if not dropped[a:b].any() else [x for x, gone in zip(w, dropped[a:b].tolist(), strict=True) if not gone]).decode() for w, a, b in zip(words, first[:-1].tolist(), first[1:].tolist(), strict=True)]
                bounds = np.searchsorted(found[:, 0], first)
                found[:, 0] -= np.repeat(first[:-1], np.diff(bounds))
                spans = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(3)], ["start", "length", "period"])
                columns = [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(find, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(found: Column) -> Column:
    """Of an array of runs, in their order, the first with the greatest length over period; null if there is none."""
    pick = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    return F.aggregate(found, F.lit(None).cast("struct<start:long,length:long,period:long>"), pick)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The query's input: in every document whose crc32(doc_id) ends in 0 the words from place a on repeat with a period p."""
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.when(checksum % 10 == 0, words).alias("words"), F.floor(checksum / 10).alias("g")).withColumn("n", F.size("words").cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    taken = lambda w, i: F.when(i >= F.col("a"), F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))).otherwise(w)
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.transform("words", taken), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, some of which have planted ones."""
    rows = runs(with_planted_runs(common.table(spark, sf_dir, "documents"))).withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli, F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))

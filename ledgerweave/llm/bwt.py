"""Burrows-Wheeler transforms of sets of byte strings, and their merge by iterative interleave refinement.

The strings are taken as cycles (each with a few zero bytes at its end), and the transform steps over ``STEP`` bytes
at a time: the symbol of a rotation is the STEP bytes before it. A shard's transform lists those symbols in the order
of its sorted rotations. To merge shards, the interleave starts as the shards one after another; each refinement
reads the shards' symbols in interleave order and moves every entry, stably, to its symbol's place, which orders the
merged rotations by STEP more bytes. Where neighbours first differ in a refinement their common prefix ends, so the
refinements yield the common prefixes (to within STEP bytes) and the intervals of rotations that share ``depth``
bytes. No shard's rotations are sorted again.
"""

from __future__ import annotations

import numpy as np

STEP = 4


class Shard:
    """Sorted rotations of strings: ``order`` (places in the flat layout) and ``symbols`` (the transform)."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray, depth: int):
        sizes = lengths + STEP
        self.base = np.cumsum(sizes) - sizes
        n = int(sizes.sum())
        flat = np.zeros(n, np.uint8)
        inside = np.ones(n, bool)
        for k in range(STEP):
            inside[self.base + lengths + k] = False
        flat[inside] = data
        size = np.repeat(sizes, sizes)
        base = np.repeat(self.base, sizes)
        offset = np.arange(n) - base

        def ahead(step: int) -> np.ndarray:
            at = offset + step
            return base + np.where(at < size, at, at % size)

        symbol = np.zeros(n, np.uint32)
        for k in range(STEP):
            symbol = (symbol << np.uint32(8)) | flat[ahead(k)]
        rank = symbol.astype(np.uint64)
        have = STEP
        while True:
            order = np.argsort(rank, kind="stable")
            new = np.ones(n, bool)
            new[1:] = rank[order][1:] != rank[order][:-1]
            dense = np.empty(n, np.uint64)
            dense[order] = np.cumsum(new).astype(np.uint64)
            if have >= depth or new.all():
                break
            rank = (dense << np.uint64(32)) | dense[ahead(have)]
            have *= 2
        self.order = order
        self.symbols = symbol[ahead(-STEP)][order]  # numpy's remainder takes the sign of the divisor


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard of each merged rotation, its place in that shard, common prefix with the one before it).

    Common prefixes are whole STEPs and at most depth; rotations with at least depth in common are one interval.
    """
    n = sum(len(s.symbols) for s in shards)
    source = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s.symbols) for s in shards])
    block = np.zeros(n, np.int32)
    common = np.full(n, depth, np.int32)
    common[:1] = 0
    symbols = np.empty(n, np.uint32)
    found = 1
    for reach in range(0, depth, STEP):
        for k, shard in enumerate(shards):
            symbols[source == k] = shard.symbols
        low = np.argsort((symbols & np.uint32(0xFFFF)).astype(np.uint16), kind="stable")
        order = low[np.argsort((symbols[low] >> np.uint32(16)).astype(np.uint16), kind="stable")]
        source, symbols, block = source[order], symbols[order], block[order]
        new = np.zeros(n, bool)
        new[1:] = (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1])
        common[new & (common == depth)] = reach
        block = np.cumsum(new, dtype=np.int32)
        if len(block) == 0 or block[-1] + 1 == found:  # no interval was split, so none will be
            break
        found = int(block[-1]) + 1
    place = np.empty(n, np.int64)
    for k, shard in enumerate(shards):
        place[source == k] = shard.order
    return source, place, common


def repeated_windows(data: np.ndarray, lengths: np.ndarray, width: int, shards: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, class) of every window of width bytes that has an equal one among the strings."""
    if width % STEP:
        raise ValueError(f"width must be a multiple of {STEP}")
    starts = np.cumsum(lengths) - lengths
    cuts = np.linspace(0, len(lengths), min(shards, len(lengths)) + 1).astype(int)
    made = [Shard(data[starts[i] : starts[j - 1] + lengths[j - 1]], lengths[i:j], width) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j > i]
    source, place, common = merge(made, width)
    string, offset = np.empty(len(source), np.int64), np.empty(len(source), np.int64)
    for k, shard in enumerate(made):
        mine = source == k
        local = np.searchsorted(shard.base, place[mine], side="right") - 1
        string[mine] = local + cuts[k]
        offset[mine] = place[mine] - shard.base[local]
    interval = np.cumsum(common < width)
    real = offset + width <= lengths[string]
    string, offset, interval = string[real], offset[real], interval[real]
    again = np.bincount(interval, minlength=1)[interval] > 1
    return string[again], offset[again], interval[again]

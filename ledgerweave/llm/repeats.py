"""Exact substring deduplication: every byte covered by a WIDTH-byte string that also starts earlier is removed.

Windows are WIDTH-byte strings inside one document. Each window has an anchor: the leftmost least hash of its GRAM-byte
strings. Equal windows have equal anchors at equal places, so only windows whose anchors agree need comparing.

1. A task turns the windows of its documents into stretches with one anchor (one for about 40 bytes), each with a
   hash of the anchor and a hash of all bytes that its windows cover. A stretch that repeats inside the task is marked
   as removed there and goes no further, so a passage of a third of all documents sends one row for each task.
2. Stretches meet by anchor. Equal ones: all but the first are marked. An anchor with one kind of stretch is done.
3. Anchors with several kinds need the bytes: stretches that share at least half of the rest of a window beside the
   anchor are gathered by anchor, in shards. Shard Burrows-Wheeler transforms are merged by interleave refinement
   (bwt.py); its intervals of rotations with WIDTH bytes in common are the repeated windows, and all windows but the
   first of an interval are marked.
4. An anchor with more bytes than a block holds sends its windows on as 128-bit hashes, which meet by hash: the
   exact way for what one task should not hold.

Documents are UTF-8 bytes. Null texts are empty (and stay null as text); rows with a null doc_id stay whole and are
compared with nothing; doc_id is taken as unique, rows that repeat an id and its text get equal results. Other columns
are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .bwt import repeated_windows
from .common import chunked, flat, mix64, written
from .words import span_hashes

#: Bytes of a string whose repetition is removed; bytes of an anchor.
WIDTH, GRAM = 100, 24
#: Bytes of stretches in one merge, and of one anchor's stretches beyond which its windows go on as hashes.
BLOCK_BYTES, ANCHOR_BYTES = 1 << 20, 4 << 20
#: Stretches that a task remembers, to hold back repeated ones (beyond, they meet in step 2).
REMEMBERED = 4_000_000
_PLACE = 20
_STRETCH = "kind int, fp long, ch long, doc long, lo int, n int, off int"


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all size-byte strings, by doubling."""
    table = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out, have = table[data], 1
    while have < size:
        step = min(have, size - have)
        out = out[:-step] * np.uint64(0xD6E8FEB86659FD93 + 2 * have) + (out[step:] ^ (out[step:] >> np.uint64(29)))
        have += step
    return mix64(out)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def _stretches(data: np.ndarray, at: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start in it, windows, anchor's place from the start, anchor hash) of the stretches of some texts."""
    found = []
    size = np.diff(at)
    for low in range(0, len(data), 1 << _PLACE):
        part = data[low : low + (1 << _PLACE) + width - 1]
        if len(part) < width:
            break
        grams = _gram_hashes(part, gram)
        place = np.uint64((1 << (_PLACE + 1)) - 1)
        best = _least((grams & ~place) | np.arange(len(grams), dtype=np.uint64), width - gram + 1)
        anchor = (best & place).astype(np.int64)
        ends = at[1:][size > 0] - low
        bad = np.zeros(len(part) + 1, np.int32)  # windows that would cross the end of a text
        np.add.at(bad, np.clip(np.maximum(ends - width + 1, at[:-1][size > 0] - low), 0, len(part)), 1)
        np.add.at(bad, np.clip(ends, 0, len(part)), -1)
        good = np.cumsum(bad)[: len(anchor)] == 0
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (good[1:] != good[:-1])]))
        n = np.diff(np.append(first, len(anchor)))
        first, n = first[good[first]], n[good[first]]
        found.append((first + low, n, anchor[first] - first, grams[anchor[first]]))
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    start, n, off, fp = (np.concatenate(x) for x in zip(*found, strict=True))
    doc = np.searchsorted(at, start, side="right") - 1
    return doc, start - at[doc], n, off, fp


def _joined(doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows, with runs that touch in one document made one."""
    order = np.lexsort((lo, doc))
    doc, lo, end = doc[order], lo[order], (lo + n)[order]
    if not len(doc):
        return doc, lo, n
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] > end[:-1])])
    first = np.flatnonzero(new)
    return doc[first], lo[first], np.maximum.reduceat(end, first) - lo[first]


def _batch(kind: int, fp, ch, doc, lo, n, off) -> pa.RecordBatch:
    ints = [pa.array(np.asarray(x).astype(np.int32)) for x in (lo, n, off)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), pa.array(np.asarray(fp).view(np.int64)), pa.array(np.asarray(ch).view(np.int64)), pa.array(np.asarray(doc, np.int64)), *ints], ["kind", "fp", "ch", "doc", "lo", "n", "off"])


def _marks(doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    doc, lo, n = _joined(doc, lo, n)
    spread = mix64(doc.astype(np.int64).view(np.uint64))
    return _batch(1, spread, spread, doc, lo, n, np.zeros(len(doc)))


def _scan(batches: Iterator[pa.RecordBatch], width: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Step 1."""
    known, known_doc, known_lo = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def settle(parts: list) -> Iterator[pa.RecordBatch]:
        nonlocal known, known_doc, known_lo
        doc, lo, n, off, fp, ch = (np.concatenate(x) for x in zip(*parts, strict=True))
        key = mix64(fp ^ (ch * np.uint64(0x9E3779B97F4A7C15)))
        order = np.lexsort((lo, doc, key))
        same = (np.diff(key[order]) == 0) & (np.diff(doc[order]) == 0) & (np.diff(lo[order]) == 0)  # repeated rows
        order = order[np.concatenate([[True], ~same])]
        doc, lo, n, off, fp, ch, key = (x[order] for x in (doc, lo, n, off, fp, ch, key))
        send = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(send)
        if len(known):
            at = np.minimum(np.searchsorted(known, key[first]), len(known) - 1)
            met = known[at] == key[first]
            later = met & ((doc[first] > known_doc[at]) | ((doc[first] == known_doc[at]) & (lo[first] > known_lo[at])))
            send[first[later]] = False
            sooner = met & ~later
            known_doc[at[sooner]], known_lo[at[sooner]] = doc[first[sooner]], lo[first[sooner]]
            first = first[~met]
        if len(known) + len(first) > REMEMBERED:
            known, known_doc, known_lo = key[:0], doc[:0], lo[:0]
        at = np.searchsorted(known, key[first])
        known, known_doc, known_lo = (np.insert(a, at, b) for a, b in ((known, key[first]), (known_doc, doc[first]), (known_lo, lo[first])))
        yield _batch(0, *(x[send] for x in (fp, ch, doc, lo, n, off)))
        if not send.all():
            yield _marks(doc[~send], lo[~send], n[~send])

    parts, held = [], 0
    for batch, data, at in chunked(batches):
        row, lo, n, off, fp = _stretches(data, at, width, gram)
        if len(row):
            start = at[row] + lo
            ch = span_hashes(data, start, start + n + width - 1, None)
            numbers = batch.column("doc_id").to_numpy(zero_copy_only=False)
            parts.append((numbers[row], lo, n, off, fp, ch))
            held += len(row)
        if held > 200_000:
            yield from settle(parts)
            parts, held = [], 0
    if parts:
        yield from settle(parts)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, over rows sorted by anchor, stretch, document and place: kind 1 marks, kind 2 stretches whose bytes are needed."""
    last: tuple | None = None  # anchor, stretch, and the stretch's first document and place, before this batch
    waiting: pa.RecordBatch | None = None  # the first stretch of that anchor, while it is the only one
    for batch in batches:
        passed = batch.filter(pc.equal(batch.column("kind"), 1))
        if passed.num_rows:
            yield passed
            batch = batch.filter(pc.equal(batch.column("kind"), 0))
        if not batch.num_rows:
            continue
        fp, ch = (batch.column(c).to_numpy() for c in ("fp", "ch"))
        before_fp, before_ch = np.roll(fp, 1), np.roll(ch, 1)
        new_fp = fp != before_fp
        first = new_fp | (ch != before_ch)
        new_fp[0] = last is None or fp[0] != last[0]
        first[0] = new_fp[0] or ch[0] != last[1]
        doc, lo, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("doc", "lo", "n"))
        head = np.maximum.accumulate(np.where(first, np.arange(len(fp)), -1))
        head_doc = np.where(head < 0, last[2] if last else 0, doc[head])
        head_lo = np.where(head < 0, last[3] if last else 0, lo[head])
        again = ~first & ((doc != head_doc) | (lo != head_lo))
        if again.any():
            yield _marks(doc[again], lo[again], n[again])
        at = np.flatnonzero(first)
        if len(at):
            follows = ~new_fp[at]
            several = follows.copy()
            several[:-1] |= follows[1:]
            if follows[0] and waiting is not None:
                yield waiting
            if follows[0] or new_fp[at[0]]:
                waiting = None
            picked = at[several]
            if len(picked):
                out = batch.take(pa.array(picked))
                yield out.set_column(0, "kind", pa.array(np.full(len(picked), 2, np.int32)))
            if not several[-1]:
                one = batch.slice(int(at[-1]), 1)
                waiting = one.set_column(0, "kind", pa.array([2], pa.int32()))
            else:
                waiting = None
        last = (fp[-1], ch[-1], head_doc[-1], head_lo[-1])


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the stretches of each document."""
    for batch in batches:
        for doc, text, items in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("items"), strict=True):
            raw = memoryview(text.as_buffer())
            fp, lo, n, off = (items.values.field(k) for k in range(4))
            low = lo.to_pylist()
            pieces = [bytes(raw[a : a + b + width - 1]) for a, b in zip(low, n.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([fp, pa.array([doc] * len(low), pa.int64()), lo, n, off, pa.array(pieces, pa.binary())], ["fp", "doc", "lo", "n", "off", "bytes"])


class _Block:
    """Stretches of whole anchors, until there are enough for a merge."""

    def __init__(self, width: int, gram: int):
        self.width, self.gram = width, gram
        self.half = -(-(width - gram) // 2)
        self.parts: list[tuple] = []
        self.bytes = 0

    def add(self, fp: np.ndarray, doc: np.ndarray, lo: np.ndarray, n: np.ndarray, off: np.ndarray, data: np.ndarray, at: np.ndarray) -> None:
        """Keeps the stretches, and of each the windows, that share half of a window's rest with another of their anchor."""
        anchor = at[:-1] + off
        # left: the half before the anchor; right: the part after it that windows starting later cover
        right_need = self.width - self.gram - self.half + 1
        has_left = off >= self.half
        has_right = off - self.half + 1 < n
        right_end = np.minimum(anchor + self.gram + right_need, at[1:])
        keep_left = self._shared(fp, span_hashes(data, np.where(has_left, anchor - self.half, anchor), anchor, None), has_left)
        keep_right = self._shared(fp, span_hashes(data, anchor, right_end, None), has_right)
        # windows from .. to of each stretch
        begin = np.where(keep_left, 0, np.maximum(off - self.half + 1, 0))
        end = np.where(keep_right, n, np.minimum(off - self.half + 1, n))
        keep = (keep_left | keep_right) & (end > begin)
        for k in np.flatnonzero(keep).tolist():
            a = int(at[k])
            self.parts.append((int(doc[k]), int(lo[k] + begin[k]), data[a + begin[k] : a + end[k] + self.width - 1]))
            self.bytes += len(self.parts[-1][2])

    @staticmethod
    def _shared(fp: np.ndarray, key: np.ndarray, valid: np.ndarray) -> np.ndarray:
        key = mix64(fp.view(np.uint64) ^ (key * np.uint64(0x9E3779B97F4A7C15)))
        out = np.zeros(len(key), bool)
        at = np.flatnonzero(valid)
        _, back, n = np.unique(key[at], return_inverse=True, return_counts=True)
        out[at] = n[back] > 1
        return out

    def merge(self) -> Iterator[pa.RecordBatch]:
        if len(self.parts) > 1:
            docs, los = (np.array([p[k] for p in self.parts], np.int64) for k in (0, 1))
            lengths = np.array([len(p[2]) for p in self.parts], np.int64)
            string, offset, group = repeated_windows(np.concatenate([p[2] for p in self.parts]), lengths, self.width)
            doc, lo = docs[string], los[string] + offset
            order = np.lexsort((lo, doc, group))
            doc, lo, group = doc[order], lo[order], group[order]
            new = np.concatenate([[True], group[1:] != group[:-1]])[: len(group)]
            head = np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
            late = (doc != doc[head]) | (lo != lo[head])
            if late.any():
                yield _windows(1, *_joined(doc[late], lo[late], np.ones(int(late.sum()), np.int64)))
        self.parts, self.bytes = [], 0


def _windows(kind: int, doc, lo, n, w0=None, w1=None) -> pa.RecordBatch:
    zero = np.zeros(len(doc), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), pa.array(doc), *(pa.array(np.asarray(x).astype(np.int32)) for x in (lo, n)), *(pa.array(zero if w is None else w.view(np.int64)) for w in (w0, w1))], ["kind", "doc", "lo", "n", "w0", "w1"])


def _compare(batches: Iterator[pa.RecordBatch], width: int, gram: int, block_bytes: int, anchor_bytes: int) -> Iterator[pa.RecordBatch]:
    """Steps 3 and 4, over stretches sorted by anchor. kind 1: marks; kind 3: windows as hashes."""
    block = _Block(width, gram)
    held: list[pa.RecordBatch] = []  # rows of the last anchor so far
    spilling: int | None = None

    def hashed(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, at = flat(part.column("bytes"))
        doc, lo, n = (part.column(c).to_numpy().astype(np.int64) for c in ("doc", "lo", "n"))
        row = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start = at[row] + k
        w0 = span_hashes(data, start, start + width, None)
        w1 = mix64(span_hashes(data, start, start + width // 2, None) * np.uint64(0xA0761D6478BD642F) + span_hashes(data, start + width // 2, start + width, None))
        yield _windows(3, doc[row], lo[row] + k, np.ones(len(row)), w0, w1)

    def whole(part: pa.RecordBatch) -> None:
        data, at = flat(part.column("bytes"))
        fp, doc, lo, n, off = (part.column(c).to_numpy().astype(np.int64) for c in ("fp", "doc", "lo", "n", "off"))
        block.add(fp, doc, lo, n, off, data, at)

    for batch in batches:
        if spilling is not None:
            n = int(pc.sum(pc.cast(pc.equal(batch.column("fp"), spilling), pa.int64())).as_py() or 0)
            if n:
                yield from hashed(batch.slice(0, n))
            if n == batch.num_rows:
                continue
            batch, spilling = batch.slice(n), None
        if held:
            batch = pa.concat_batches([*held, batch])
        fp = batch.column("fp").to_numpy()
        cuts = [0, *(np.flatnonzero(fp[1:] != fp[:-1]) + 1).tolist()]  # the last anchor may go on
        for i in range(0, len(cuts) - 1, 512):
            stop = cuts[min(i + 512, len(cuts) - 1)]
            whole(batch.slice(cuts[i], stop - cuts[i]))
            if block.bytes >= block_bytes:
                yield from block.merge()
        rest = batch.slice(cuts[-1])
        if rest.nbytes > anchor_bytes:
            yield from hashed(rest)
            spilling, held = int(fp[-1]), []
        else:
            held = [rest]
    if held:
        whole(pa.concat_batches(held))
    yield from block.merge()


def _remove(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch, data, at in chunked(batches, limit=4 << 20):
        spans, kept = [], []
        for i, marks in enumerate(batch.column("marks")):
            raw = data[at[i] : at[i + 1]]
            if not marks.is_valid or not len(marks.values) or not len(raw):
                spans.append([])
                kept.append(raw.tobytes())
                continue
            lo, n = (marks.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            delta = np.zeros(len(raw) + 1, np.int32)
            np.add.at(delta, np.minimum(lo, len(raw)), 1)
            np.add.at(delta, np.minimum(lo + n + width - 1, len(raw)), -1)
            gone = np.cumsum(delta[:-1]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            spans.append([{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
            kept.append(raw[~gone].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.diff(at)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()), pa.array([k.decode(errors="ignore") if t.is_valid else None for k, t in zip(kept, batch.column("text"), strict=True)], pa.string())], ["row", "n_bytes", "removed", "kept", "kept_text"])


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """(doc, marks): for documents with repeated windows, the runs (lo, n) of window starts that have an equal earlier one."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null")
    scanned = docs.filter(F.octet_length("text") >= width).mapInArrow(lambda b: _scan(b, width, gram), _STRETCH)
    met = scanned.repartition("fp").sortWithinPartitions("fp", "ch", "doc", "lo").mapInArrow(_meet, _STRETCH)
    met = written(met, "stretches")
    needed = met.filter("kind = 2").groupBy("doc").agg(F.collect_list(F.struct("fp", "lo", "n", "off")).alias("items"))
    cut = docs.join(needed.withColumnRenamed("doc", "doc_id"), "doc_id").select("doc_id", "text", "items")
    cut = cut.mapInArrow(lambda b: _cut(b, width), "fp long, doc long, lo int, n int, off int, bytes binary")
    compared = cut.repartition("fp").sortWithinPartitions("fp", "doc", "lo").mapInArrow(lambda b: _compare(b, width, gram, block_bytes, anchor_bytes), "kind int, doc long, lo int, n int, w0 long, w1 long")
    compared = written(compared, "windows")
    loose = compared.filter("kind = 3").select("w0", "w1", "doc", "lo")
    least = loose.groupBy("w0", "w1").agg(F.min(F.struct("doc", "lo")).alias("first"))
    late = loose.join(least, ["w0", "w1"]).filter(F.struct("doc", "lo") > F.col("first")).select("doc", "lo", F.lit(1).alias("n"))
    marks = met.filter("kind = 1").select("doc", "lo", "n").unionAll(compared.filter("kind = 1").select("doc", "lo", "n")).unionAll(late)
    return marks.groupBy("doc").agg(F.collect_list(F.struct("lo", "n")).alias("marks"))


def without_repeats(docs: DataFrame, width: int = WIDTH, **options: int) -> DataFrame:
    """(row, n_bytes, removed spans [start, end), kept bytes, the same as text) for every row of docs; row: a struct of its columns but text."""
    marks = repeated_spans(docs, width, **options).withColumnRenamed("doc", "doc_id")
    rest = F.struct(*(F.col(c) for c in docs.columns if c != "text")).alias("row")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), rest).join(marks, "doc_id", "left")
    kind = T.StructType([rows.schema["row"], *T.StructType.fromDDL("n_bytes long, removed array<struct<start: long, end: long>>, kept binary, kept_text string")])
    return rows.mapInArrow(lambda b: _remove(b, width), kind)


def cleaned(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with the same columns and rows, repeated strings cut out of text. Pieces of a character cut in two go too."""
    rows = without_repeats(docs, width)
    columns = {c: F.col("kept_text") if c == "text" else F.col("row")[c] for c in docs.columns}
    return rows.select(*(v.alias(c) for c, v in columns.items()))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document when repeated 100-byte strings are removed."""
    rows = without_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("row.doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

"""Benchmark decontamination by templates: canonical tokens, hash-joined template windows, slot consistency.

A text becomes template tokens: runs of letters and digits, lower-cased for A-Z and Latin-1, with numbers, names (a capital and
small letters, not at the start of a sentence) and units behind numbers replaced by typed placeholders whose values
are kept as slots. Windows of WINDOW tokens with enough plain tokens in them are hashed; windows of documents are
hash-joined with those of the benchmark items. A pair of document and item is reported if consistent windows cover
enough of the item: each value in the item always stands for one value in the document. So a question asked again with
other numbers or names is found, and texts that share only a frame of function words with placeholders at random are not.

Slots are checked over all alignments of a document and an item together, so a word put in or left out changes nothing:
where an item's value stands for several, the windows that replace it are left out; windows whose slots are equal always
count. A document may hold an item several times with other values: alignments that lie more than half an item apart
are occurrences of their own, each is checked by itself too, and the largest number of windows holds.

A match needs LEAST windows, or all of them where an item has fewer. An item with fewer than LEAST windows is also
found by its whole token sequence, values in place of placeholders, so capitals and stops before it do not matter. An
item without any window (shorter than WINDOW, or dense in values) has one over its whole token sequence if that has
PLAIN plain tokens; else it is found only as it is. So each item with a token can be found; one of a single common word
is found in every text that has the word.

The benchmark's distinct window hashes are sent to the tasks if they are at most MOST_SENT (8 bytes each); a larger
benchmark meets the documents in a shuffled join instead, with the same result.

Null and empty texts, and items without letters and digits, have no windows. Null ids are no documents or items. Repeated
rows give one result; rows that share an id count as one document or item that has the windows of all. Items with equal
texts are each reported. Texts of any length are searched whole, CHUNK_BYTES or one text at a time. Other columns are
not read, whatever their names; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import chunked, mix64
from .words import _power_tables, small_latin, span_hashes, spans

#: Tokens of a window, plain ones that it needs, share of an item's windows, and windows (or all), that a match needs.
WINDOW, PLAIN, SHARE, LEAST = 6, 3, 0.35, 3
#: Window hashes of a benchmark that are sent to the tasks at most.
MOST_SENT = 1 << 20

# Units of measure that count as slots behind a number.
UNITS = """
mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams ton tons pound pounds lb lbs ounce ounces oz
ml l liter liters litre litres gallon gallons second seconds s minute minutes min hour hours h day days week weeks month
months year years dollar dollars usd euro euros eur cent cents percent degree degrees mph kmh joule joules watt watts volt volts
""".split()

_NO_WORD = np.ones(256, bool)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _NO_WORD[_low:_high] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_END = np.zeros(256, bool)
_END[[10, 33, 46, 58, 63]] = True
_NUMBER, _NAME, _UNIT = mix64(np.array([1001, 1002, 1003], np.uint64))


def _of(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return np.sort(span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends))


_UNIT_HASHES = _of(UNITS)


def template(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template token hash, slot value or 0, first token of each text)."""
    data = small_latin(data)
    starts, ends = spans(data, at, _NO_WORD)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    value = span_hashes(data, starts, ends)
    first = np.searchsorted(starts, at)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    number = digits[ends] - digits[starts] == ends - starts
    small = np.concatenate([[0], np.cumsum(_LOWER[data])])
    stops = np.concatenate([[0], np.cumsum(_END[data])])
    after_stop = np.ones(len(starts), bool)
    after_stop[1:] = stops[starts[1:]] > stops[ends[:-1]]
    after_stop[first[:-1][first[:-1] < first[1:]]] = True
    name = _UPPER[data[starts]] & (ends - starts > 1) & (small[ends] - small[starts] == ends - starts - 1) & ~after_stop
    behind = np.zeros(len(starts), bool)
    behind[1:] = number[:-1]
    behind[first[:-1][first[:-1] < first[1:]]] = False
    place = np.minimum(np.searchsorted(_UNIT_HASHES, value), len(_UNIT_HASHES) - 1)
    unit = behind & (_UNIT_HASHES[place] == value)
    token = value.copy()
    for mask, mark in ((name, _NAME), (unit, _UNIT), (number, _NUMBER)):
        token[mask] = mark
    return token, np.where(number | name | unit, value | np.uint64(1), np.uint64(0)), first


def _windows(token: np.ndarray, slot: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the windows of each text that have enough plain tokens."""
    n = len(token) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        key += token[k : k + n] * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64))
    plain = np.concatenate([[0], np.cumsum(slot == 0)])
    text = np.searchsorted(first, np.arange(n), side="right") - 1
    fits = (np.arange(n) + WINDOW <= first[text + 1]) & (plain[WINDOW:] - plain[:-WINDOW] >= PLAIN)
    at = np.flatnonzero(fits)
    return text[at], at - first[text[at]], mix64(key[at])


class _Sums:
    """Hashes of runs of any length: of template tokens (exact 0) or of the tokens as they are (exact 1)."""

    def __init__(self, token: np.ndarray, slot: np.ndarray, exact: int):
        values = np.where(slot == 0, token, slot) | np.uint64(1) if exact else token
        power, self.inverse = _power_tables(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[: len(values)], out=self.sums[1:])
        self.exact = exact

    def of(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        salt = np.asarray(2 * np.asarray(length) + self.exact + 1).astype(np.uint64) * _NUMBER
        return mix64((self.sums[at + length] - self.sums[at]) * self.inverse[at] + salt)


def _among(sorted_hashes: np.ndarray, found: np.ndarray) -> np.ndarray:
    if not len(sorted_hashes):
        return np.zeros(len(found), bool)
    return sorted_hashes[np.minimum(np.searchsorted(sorted_hashes, found), len(sorted_hashes) - 1)] == found


#: (exact, length, sorted hashes of heads, sorted hashes of wholes) of the items that are looked for as a whole; None: not sent.
Wholes = list[tuple[int, int, np.ndarray | None, np.ndarray | None]]


def _whole_places(token: np.ndarray, slot: np.ndarray, first: np.ndarray, wholes: Wholes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(exact, length, text, place, hash) of the runs of each text that are whole items; of exact ones the first in each text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    room = first[text + 1] - np.arange(len(token))
    runs = {exact: _Sums(token, slot, exact) for exact in {w[0] for w in wholes}}
    heads: dict[tuple[int, int], np.ndarray] = {}
    for exact, length, head, whole in wholes:
        short = min(length, WINDOW)
        if (exact, short) not in heads:
            at = np.flatnonzero(room >= short)
            heads[exact, short] = at if head is None else at[_among(head, runs[exact].of(at, short))]
        at = heads[exact, short]
        at = at[room[at] >= length]
        window = runs[exact].of(at, length)
        if whole is not None:
            hit = _among(whole, window)
            at, window = at[hit], window[hit]
        if exact and len(at):
            once = np.unique(np.stack([text[at].astype(np.uint64), window]), axis=1, return_index=True)[1]
            at, window = at[once], window[once]
        if len(at):
            yield exact, length, text[at], at - first[text[at]], window


def _lists(lengths: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))


def _keyed(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).cast("long"), F.col("text").cast("string")).filter(F.col(key).isNotNull())


def template_windows(rows: DataFrame, key: str, only: np.ndarray | None = None, wholes: Wholes | None = None) -> DataFrame:
    """(key, place, window, slots): windows of every text and its runs that are wholes; with ``only`` (sorted hashes), the windows among these."""
    shared = rows.sparkSession.sparkContext.broadcast((only, wholes or []))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, sought = shared.value
        for batch, data, at in chunked(batches):
            token, slot, first = template(data, at)
            text, place, window = _windows(token, slot, first)
            if wanted is not None and len(window):
                hit = _among(wanted, window)
                text, place, window = text[hit], place[hit], window[hit]
            found = [(0, WINDOW, text, place, window)] if len(window) else []
            for exact, length, text, place, window in [*found, *(_whole_places(token, slot, first, sought) if sought and len(token) else ())]:
                width = 0 if exact else length
                slots = slot[(first[text] + place)[:, None] + np.arange(width)].view(np.int64).reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).take(pa.array(text)), pa.array(place), pa.array(window.view(np.int64)), _lists(np.full(len(window), width), slots)],
                    names=[key, "place", "window", "slots"],
                )

    return _keyed(rows, key).mapInArrow(make, f"{key} long, place long, window long, slots array<long>")


def whole_items(benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """(item_id, place, window, slots, exact, length, head): one run over all tokens of items with fewer than ``least`` windows.

    exact 1: the tokens as they are, for each of these; exact 0: the template, for those without a window but with PLAIN plain tokens.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in chunked(batches):
            token, slot, first = template(data, at)
            size, plain = np.diff(first), np.concatenate([[0], np.cumsum(slot == 0)])
            n_windows = np.bincount(_windows(token, slot, first)[0], minlength=len(size))
            for exact in (0, 1):
                fits = (n_windows < least) if exact else (n_windows == 0) & (plain[first[1:]] - plain[first[:-1]] >= PLAIN)
                text = np.flatnonzero(fits & (size > 0))
                if not len(text):
                    continue
                runs, length = _Sums(token, slot, exact), size[text]
                slots = [] if exact else [slot[first[t] : first[t + 1]] for t in text]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("item_id").take(pa.array(text)), pa.array(np.zeros(len(text), np.int64)), pa.array(runs.of(first[text], length).view(np.int64)),
                        _lists(length * (1 - exact), np.concatenate([np.zeros(0, np.uint64), *slots]).view(np.int64)),
                        pa.array(np.full(len(text), exact, np.int32)), pa.array(length.astype(np.int64)), pa.array(runs.of(first[text], np.minimum(length, WINDOW)).view(np.int64)),
                    ],
                    names=["item_id", "place", "window", "slots", "exact", "length", "head"],
                )

    return _keyed(benchmark, "item_id").mapInArrow(make, "item_id long, place long, window long, slots array<long>, exact int, length long, head long")


def _sought(whole: DataFrame, most_sent: int) -> Wholes:
    """The wholes that documents are searched for: their hashes, or only the lengths if they are more than ``most_sent``."""
    hashes = whole.select("exact", "length", "head", "window").distinct()
    if hashes.count() > most_sent:
        return [(r["exact"], r["length"], None, None) for r in hashes.select("exact", "length").distinct().orderBy("exact", "length").collect()]
    sent = hashes.toArrow()
    exact, length = (sent.column(c).to_numpy() for c in ("exact", "length"))
    head, window = (sent.column(c).to_numpy().view(np.uint64) for c in ("head", "window"))
    short = np.minimum(length, WINDOW)
    return [
        (int(e), int(n), np.unique(head[(exact == e) & (short == min(n, WINDOW))]), np.sort(window[(exact == e) & (length == n)]))
        for e, n in sorted(set(zip(exact.tolist(), length.tolist(), strict=True)))
    ]


def _consistent(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, reworded, is_exact): item places of the windows that replace no value that stands for several within the keys."""
    slots = lines.select(*keys, F.explode(F.flatten("windows.slots")).alias("s"))
    values = slots.groupBy(*keys, "s.item_slots").agg(F.min("s.doc_slots").alias("low"), F.max("s.doc_slots").alias("high"))
    torn = values.filter("low <> high").groupBy(*keys).agg(F.collect_list("item_slots").alias("torn"))  # at most an item's values
    other = lambda s: s["item_slots"] != s["doc_slots"]
    clashes = lambda w: F.exists(w["slots"], lambda s: other(s) & F.array_contains("torn", s["item_slots"]))
    rows = lines.join(torn, keys, "left").withColumn("torn", F.coalesce("torn", F.array().cast("array<long>"))).withColumn("windows", F.filter("windows", lambda w: ~clashes(w)))
    places = F.collect_set(F.when(F.col("exact") == 0, F.col("windows.item_place")))
    return rows.groupBy(*keys).agg(F.size(F.array_distinct(F.flatten(places))).cast("long").alias("n"), F.max(F.exists(F.flatten("windows.slots"), other)).alias("reworded"), F.max("exact").alias("is_exact"))


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, least: int = LEAST, most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, reworded): documents that hold benchmark items; reworded: slots were replaced."""
    whole = common.written(whole_items(benchmark, least), "whole-items")
    items = template_windows(benchmark, "item_id").withColumn("exact", F.lit(0))
    items = common.written(items.unionByName(whole.select(items.columns)), "items")
    hashes = items.select("window").distinct()
    only = None
    if hashes.count() <= most_sent:
        only = np.sort(hashes.toArrow().column("window").to_numpy().view(np.uint64))
    totals = items.groupBy("item_id").agg(F.greatest(F.lit(1), F.countDistinct(F.when(F.col("exact") == 0, F.col("place")))).alias("total"))
    met = template_windows(docs, "doc_id", only, _sought(whole, most_sent)).withColumnRenamed("slots", "doc_slots").join(items.withColumnsRenamed({"place": "item_place", "slots": "item_slots"}), "window")
    met = met.select("doc_id", "item_id", "exact", "item_place", (F.col("place") - F.col("item_place")).alias("shift"), F.filter(F.arrays_zip("item_slots", "doc_slots"), lambda s: s["item_slots"] != 0).alias("slots"))
    # one alignment of a document and an item at a time; at most an item's windows in each group
    lines = met.groupBy("doc_id", "item_id", "exact", "shift").agg(F.collect_set(F.struct("item_place", "slots")).alias("windows"))
    in_order = Window.partitionBy("doc_id", "item_id", "exact").orderBy("shift")
    apart = F.col("shift") - F.lag("shift").over(in_order) > F.col("total") / 2
    lines = lines.join(totals, "item_id").withColumn("apart", F.coalesce(apart.cast("int"), F.lit(0))).withColumn("occurrence", F.sum("apart").over(in_order))
    lines = common.written(lines.select("doc_id", "item_id", "exact", "occurrence", "windows"), "alignments")
    together, alone = (_consistent(lines, ["doc_id", "item_id", *more]) for more in ([], ["exact", "occurrence"]))
    alone = alone.groupBy("doc_id", "item_id").agg(F.max(F.struct("n", "reworded")).alias("one"))
    best = together.join(alone, ["doc_id", "item_id"]).withColumn("best", F.when(F.col("one.n") > F.col("n"), F.col("one")).otherwise(F.struct("n", "reworded")))
    best = best.select("doc_id", "item_id", "is_exact", F.col("best.n").alias("n_windows"), "best.reworded").withColumnRenamed("is_exact", "exact")
    found = best.join(totals, "item_id").withColumn("n_windows", F.when(F.col("exact") == 1, F.col("total")).otherwise(F.col("n_windows")))
    found = found.withColumn("coverage", F.col("n_windows") / F.col("total"))
    return found.filter((F.col("coverage") >= share) & (F.col("n_windows") >= F.least(F.lit(least), F.col("total")))).select("doc_id", "item_id", "n_windows", "coverage", "reworded")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item of benchmark, as it is or with other numbers, names or units."""
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))

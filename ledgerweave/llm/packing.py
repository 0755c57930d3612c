"""Best-fit packing of token sequences.

Pieces (documents, or the parts of documents longer than a sequence) are packed by bulk-synchronous best-fit over
sorted runs. Lengths are whole numbers of at most ``size`` tokens, so the sorted pieces form at most ``size`` runs
of equal length, and so do the gaps of open sequences that share one history. A round takes the next run of pieces
(longest first), sweeps for its successor among the runs of gaps (the smallest gap that holds it), gives each piece
the gap of its own rank, moves those gaps to their new place in the order, and repeats until the run is placed; what
finds no gap opens new sequences. Runs are counted, ranked and placed by Spark over all rows; what a round needs to
know of them is one count for each length, so its state has a fixed bound (``size`` counts and a few thousand runs of
gaps, whatever the number of rows). The rounds give every piece the place that best-fit decreasing gives it.

Rank within a run is the running count over hashed slices of the run, one for SLICE_ROWS of its rows, so a length
shared by a third of all rows is as many slices as its rows need. A slice meets only the stretches of its own ranks.

Nulls count as empty texts and hold the end id alone; a null doc_id and repeated doc_ids are packed as rows of their
own; pieces of equal length are placed in the order of their hashed slice, doc_id and piece; texts of any length are
cut as a whole; other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoded

SIZE = 1024
#: Rows of a run for each slice over which its ranks are counted.
SLICE_ROWS = 500_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents of more than size tokens are cut, the first piece being the short one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, at in encoded(batches, vocabulary, end_id):
            total = np.diff(at)
            n = -(-total // size)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            head = total - (n - 1) * size
            start = np.where(piece > 0, head[row] + (piece - 1) * size, 0)
            length = np.where(piece > 0, size, head[row])
            raw, low = memoryview(ids.tobytes()), 4 * (at[:-1][row] + start)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(low.tolist(), (low + 4 * length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _PIECES)


def best_fit_rounds(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Rounds over runs: (length, first rank, n, first sequence, offset) for each stretch of a run placed alike.

    counts: pieces of each length. Pieces first rank .. + n of a length go, in order, to the sequences first
    sequence .. + n, at the offset.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, n) of sequences with that gap
    open_gaps = np.zeros(size + 1, bool)
    placed, fresh = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            fits = np.flatnonzero(open_gaps[length:])
            if len(fits):
                gap = length + int(fits[0])
                first, n = gaps[gap].pop()
                if n > left:
                    gaps[gap].append((first + left, n - left))
                if not gaps[gap]:
                    open_gaps[gap] = False
            else:  # as many new sequences as the rest of the run fills
                gap, first, n = size, fresh, -(-left // (size // length))
                fresh += n
            n = min(n, left)
            placed.append((length, rank, n, first, size - gap))
            rank, left = rank + n, left - n
            if gap > length:
                gaps.setdefault(gap - length, []).append((first, n))
                open_gaps[gap - length] = True
    return placed


def _small(spark: SparkSession, rows: list[tuple[int, ...]], names: list[str]) -> DataFrame:
    """A table of whole numbers from the driver, sent as Arrow: a list would go through Python workers of its own."""
    return spark.createDataFrame(pa.table(dict(zip(names, np.array(rows, np.int64).reshape(-1, len(names)).T, strict=True))))


def pack(rows: DataFrame, size: int = SIZE, key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """rows (with a length column) and, for each, its sequence_id and offset.

    rows is read twice, so it should be a written table.
    """
    spark = rows.sparkSession
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most size rows
    slices = _small(spark, [(k, -(-n // SLICE_ROWS)) for k, n in counts.items()], ["length", "slices"])
    sliced = rows.join(F.broadcast(slices), "length").withColumn("slice", F.pmod(F.xxhash64(*key), F.col("slices")))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = sliced.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("rows")).withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    plan = _small(spark, best_fit_rounds(counts, size), ["length", "low", "n", "first", "offset"])
    # of each slice the stretches that its ranks fall in: at most one for each slice and stretch, so a slice for SLICE_ROWS rows
    met = base.join(F.broadcast(plan), "length").filter((F.col("low") < F.col("base") + F.col("rows")) & (F.col("low") + F.col("n") > F.col("base")))
    met = met.groupBy("length", "slice", "base").agg(F.sort_array(F.collect_list(F.struct("low", "n", "first", "offset"))).alias("plan"))
    within = Window.partitionBy("length", "slice").orderBy(*key)
    placed = sliced.withColumn("place", F.row_number().over(within)).join(met, ["length", "slice"]).withColumn("rank", F.col("base") + F.col("place") - 1)
    stretch = F.filter("plan", lambda p: (p["low"] <= F.col("rank")) & (F.col("rank") < p["low"] + p["n"]))[0]
    return placed.withColumn("stretch", stretch).select(*rows.columns, (F.col("stretch.first") + F.col("rank") - F.col("stretch.low")).alias("sequence_id"), F.col("stretch.offset").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, size: int = SIZE) -> DataFrame:
    """The pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(common.written(token_pieces(docs, vocabulary, end_id, size), "pieces"), size)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 byte_bpe_50k tokens, end id 2."""
    return pack_documents(common.table(spark, sf_dir, "documents"))

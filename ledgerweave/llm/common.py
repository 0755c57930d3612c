"""Shared pieces: table reading, the shared work folder, and flat byte views of text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into word or byte arrays at a time.
CHUNK_BYTES = 1 << 20
#: Bytes after which an Arrow batch of the pipeline goes to a Python worker (or its row, where one is longer).
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session that has none gets one here."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='ledgerweave-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ledgerweave-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Removes a table made by written() that no later step reads."""
    spark = df.sparkSession
    for top in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_BYTES; it stays so, as a stage is computed when its result is written.

    Workers take texts CHUNK_BYTES at a time anyway, and batches of 10000 texts stay as memory of the executor and its workers.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key).lower()
    if not held.rstrip("b").isdigit() or int(held.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def fold(column: str, parts: int):
    """crc32 of an id's decimal text, modulo parts; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, offsets of each value); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = column.type
    large = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    column = pc.fill_null(column, b"" if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole values with at most limit bytes, or one longer value."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def chunked(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the flat bytes and offsets of one text column."""
    for batch in batches:
        if batch.num_rows:
            data, at = flat(batch.column(column))
            for i, j in pieces(at, limit):
                yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix one), in place where it can be."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x

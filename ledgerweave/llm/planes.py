"""Token-id files by bit-plane shuffling: blocks of ids transposed into planes, each plane compressed on its own.

A file holds the ids of a range of documents in ascending doc_id order:

    MAGIC | planes of block 0 | planes of block 1 | ... | index | 8-byte index place | MAGIC

Every block but the last holds ``block_ids`` ids. Its ids are split into byte planes (all low bytes, then all next
bytes, ...) or bit planes (all lowest bits, ...); planes that are zero throughout are left out. The index is one
zstandard frame with the doc ids, the tokens of each document, and for every block its number of ids and the size
of every plane, so that a reader seeks to the blocks of any id range.

Nulls and empty texts hold the end id alone; a null doc_id sorts first; repeated doc_ids stay separate rows, in
order of their text. Texts of any length are encoded whole. Other columns are not read, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoded

MAGIC = b"LWPLANE1"
BLOCK_IDS = 1 << 16
#: Text bytes that one file is made from.
FILE_TEXT_BYTES = 32 << 20


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block, lowest first; zero planes at the top are left out."""
    low = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    width = max(1, int(ids.max(initial=0)).bit_length())
    if kind == "byte":
        return [np.ascontiguousarray(low[:, k]).tobytes() for k in range((width + 7) // 8)]
    bits = np.unpackbits(low, axis=1, bitorder="little", count=width)
    return [np.packbits(np.ascontiguousarray(bits[:, k]), bitorder="little").tobytes() for k in range(width)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        low = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            low[:, k] = np.frombuffer(plane, np.uint8)
        return low.reshape(-1).view("<u4")
    bits = np.zeros((n, 32), np.uint8)
    for k, plane in enumerate(planes):
        bits[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), bitorder="little", count=n)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class PlaneWriter:
    """Writes one file as ids come; holds at most a block and the index."""

    def __init__(self, out, kind: str = "byte", block_ids: int = BLOCK_IDS, level: int = 3):
        self.out, self.kind, self.block_ids = out, kind, block_ids
        self.zip = zstandard.ZstdCompressor(level=level)
        self.left = np.zeros(0, np.uint32)
        self.blocks: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.place = out.write(MAGIC) or len(MAGIC)

    def _block(self, ids: np.ndarray) -> None:
        packed = [self.zip.compress(p) for p in to_planes(ids, self.kind)]
        for p in packed:
            self.out.write(p)
        self.place += sum(map(len, packed))
        row = np.zeros(33, np.int64)
        row[0] = len(ids)
        row[1 : 1 + len(packed)] = [len(p) for p in packed]
        self.blocks.append(row)

    def add(self, docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray, nulls: np.ndarray | None = None) -> None:
        """Documents with their numbers of ids and all their ids; nulls: which of the documents have no doc_id."""
        self.docs.append(docs)
        self.nulls.append(np.zeros(len(docs), bool) if nulls is None else nulls)
        self.sizes.append(sizes)
        ids = np.concatenate([self.left, ids])
        full = len(ids) // self.block_ids * self.block_ids
        for i in range(0, full, self.block_ids):
            self._block(ids[i : i + self.block_ids])
        self.left = ids[full:]

    def close(self) -> None:
        if len(self.left):
            self._block(self.left)
        index = io.BytesIO()
        np.savez(index, kind=np.array(self.kind), block_ids=self.block_ids, docs=np.concatenate([np.zeros(0, np.int64), *self.docs]), nulls=np.concatenate([np.zeros(0, bool), *self.nulls]), sizes=np.concatenate([np.zeros(0, np.int64), *self.sizes]), blocks=np.array(self.blocks, np.int64).reshape(-1, 33))
        packed = self.zip.compress(index.getvalue())
        self.out.write(packed)
        self.out.write(self.place.to_bytes(8, "little"))
        self.out.write(MAGIC)


class PlaneReader:
    """Random access to the ids of a file through its index."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, 2) or file.tell()
        file.seek(end - 16)
        place = int.from_bytes(file.read(8), "little")
        if file.read(8) != MAGIC:
            raise ValueError("not a plane file, or a cut one")
        file.seek(place)
        index = np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(file.read(end - 16 - place))))
        self.kind, self.block_ids = str(index["kind"]), int(index["block_ids"])
        self.docs, self.nulls, self.sizes, self.blocks = (index[k] for k in ("docs", "nulls", "sizes", "blocks"))
        self.places = len(MAGIC) + np.concatenate([[0], np.cumsum(self.blocks[:, 1:].sum(axis=1))])

    def block(self, k: int) -> np.ndarray:
        self.file.seek(int(self.places[k]))
        unzip = zstandard.ZstdDecompressor()
        planes = [unzip.decompress(self.file.read(int(n))) for n in self.blocks[k, 1:] if n]
        return from_planes(planes, int(self.blocks[k, 0]), self.kind)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop (exclusive) of the file."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first = start // self.block_ids
        got = np.concatenate([self.block(k) for k in range(first, (stop - 1) // self.block_ids + 1)])
        return got[start - first * self.block_ids : stop - first * self.block_ids]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id or None, start, ids) of each document, one block in memory at a time besides the document."""
        at, k, left, base = 0, 0, np.zeros(0, np.uint32), 0
        for doc, null, n in zip(self.docs.tolist(), self.nulls.tolist(), self.sizes.tolist(), strict=True):
            parts = [left[at - base : at - base + n]]
            got = len(parts[0])
            while got < n:
                base += len(left)
                left = self.block(k)
                k += 1
                parts.append(left[: n - got])
                got += len(parts[-1])
            yield None if null else doc, at, parts[0] if len(parts) == 1 else np.concatenate(parts)
            at += n


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if urlparse(uri).scheme else f"file://{uri}")


def write_planes(docs: DataFrame, path: str, vocabulary: str, end_id: int, kind: str = "byte", block_ids: int = BLOCK_IDS, file_text_bytes: int = FILE_TEXT_BYTES) -> DataFrame:
    """Writes the ids of all texts to files under path (a folder all executors reach) and a manifest; returns the manifest.

    Files hold ranges of doc_id, so ids are in ascending doc_id order across files. A task writes under a name of
    its own and renames when done, so a task that runs again leaves the same file.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // file_text_bytes))
    ranged = docs.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _open(path)
        task = TaskContext.get()
        number = task.partitionId()
        name, mine = f"{top}/part-{number:08d}.planes", f"{top}/_part-{number:08d}-{task.taskAttemptId()}"
        fs.create_dir(top, recursive=True)
        n = n_docs = 0
        with fs.open_output_stream(mine) as out:
            writer = PlaneWriter(out, kind, block_ids)
            for batch, ids, at in encoded(batches, vocabulary, end_id):
                numbers = batch.column("doc_id")
                nulls = numbers.is_null().to_numpy(zero_copy_only=False)
                writer.add(numbers.fill_null(0).to_numpy(zero_copy_only=False), np.diff(at), ids, nulls)
                n, n_docs = n + len(ids), n_docs + batch.num_rows
            writer.close()
        fs.move(mine, name)
        yield pa.RecordBatch.from_pydict({"file": [number], "n_ids": [n], "n_docs": [n_docs]}, schema=pa.schema([("file", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]))

    manifest = ranged.mapInArrow(write, "file long, n_ids long, n_docs long")
    manifest.write.parquet(f"{path}/manifest")
    return read_manifest(docs.sparkSession, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_ids, n_docs, base): one row for each file; base: the ids of all files before it."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    rows = spark.read.schema("file long, n_ids long, n_docs long").parquet(f"{path}/manifest")
    return rows.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_planes(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files' blocks."""
    manifest = read_manifest(spark, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _open(path)
        for batch in batches:
            for number, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with fs.open_input_file(f"{top}/part-{number:08d}.planes") as file:
                    rows = [(doc, base + at, len(ids), zlib.crc32(ids.tobytes())) for doc, at, ids in PlaneReader(file).documents()]
                for i in range(0, len(rows), 20_000):
                    columns = list(zip(*rows[i : i + 20_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("file", "base")
    return files.repartition(max(1, files.count()), "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents as word_bpe_49k ids with end id 1, written as plane files and read back."""
    path = common.new_path(spark, "planes")
    write_planes(common.table(spark, sf_dir, "documents"), path, "word_bpe_49k.json", 1)
    return read_planes(spark, path)

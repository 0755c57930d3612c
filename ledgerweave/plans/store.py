"""The stored graph: for each table, immutable folders of Parquet files and a chain of numbered snapshots of them.

A snapshot is a small file that names the folders which make up the table. It is put in place by one rename that fails
where the number is taken, so readers see a whole table or the one before, and of two writers one is told to start
again. Tables with many rows are partitioned by cycle and by a bucket of their key: a load reads the keys of the buckets
it touches and writes only partitions whose rows change. Folders stay until clean() is called.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.operators import filters
from ledgerweave.operators.upserts import scores_written
from ledgerweave.plans.scratch import removed, work_dir, written

SCORE = "brand_name string, issue_name string, scorecard_org string, score double, dollars double, candidates long, confidence string, cycles array<int>, computed_at timestamp"
CYCLE_LOAD = "cycle int, loaded_at timestamp"
RESOLUTION = "brand string, id string, source int"
#: Buckets of a partitioned table's key, in each cycle.
BUCKETS = 16
#: Rows of a partition that one task writes, at most about, even if all rows are of one cycle.
PART_ROWS = 1 << 21
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"  # Spark's name of a null partition


class MissingTable(LookupError):
    """A step needs a table that no step has written."""


class SnapshotTaken(RuntimeError):
    """Another writer has made the next snapshot; what was computed from the last one has to be computed again."""


class Store:
    """Tables below root, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, text: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(text)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, pattern: str) -> list[str]:
        path, files = self._path(pattern)
        return sorted(f.getPath().toString() for f in files.globStatus(path) or [])

    def versions(self, name: str) -> list[str]:
        return self._listed(f"{self.root}/{name}/v*")

    def _snapshot(self, name: str) -> tuple[int, dict]:
        """(number, content) of the newest snapshot; (-1, no folders) where there is none."""
        found = self.versions(name)
        if not found:
            return -1, {"folders": [], "buckets": None}
        text = "".join(r["value"] for r in self.spark.read.text(found[-1], wholetext=True).collect())  # one small file
        return int(found[-1].rpartition("/v")[2]), json.loads(text)

    def _claim(self, name: str, number: int, content: dict) -> None:
        """Makes content the snapshot of that number, or fails if there is one."""
        draft, files = self._path(f"{self.root}/{name}/_draft-{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        target, _ = self._path(f"{self.root}/{name}/v{number:08d}")
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, target, options)  # never onto a file that is there
        except Exception as e:
            files.delete(draft, False)
            if files.exists(target):
                raise SnapshotTaken(f"{name} already has snapshot {number}") from e
            raise

    def _folders(self, name: str, folders: Sequence[str], schema: str) -> DataFrame:
        base = f"{self.root}/{name}/data"
        return self.spark.read.schema(schema).option("basePath", base).parquet(*(f"{base}/{f}" for f in folders))

    def read(self, name: str, schema: str) -> DataFrame:
        """The newest snapshot; an empty table where there is none."""
        _, content = self._snapshot(name)
        wanted = self.spark.createDataFrame([], schema)
        return self._folders(name, content["folders"], schema).select(wanted.columns) if content["folders"] else wanted

    def need(self, name: str, schema: str) -> DataFrame:
        """The newest snapshot of a table that an earlier step must have written."""
        if not self.versions(name):
            raise MissingTable(f"{name} was never written; run the step that loads it first")
        return self.read(name, schema)

    def write(self, name: str, rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        """The next snapshot, which may be computed from the last one, as a whole; by: columns that become folders."""
        number, _ = self._snapshot(name)
        folder = f"load={uuid.uuid4().hex}"
        rows.write.partitionBy(*by).parquet(f"{self.root}/{name}/data/{folder}")
        self._claim(name, number + 1, {"folders": [folder], "buckets": None})
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/{name}/data/{folder}")

    def merge(self, name: str, rows: DataFrame, key: Sequence[str], by: str = "cycle", buckets: int = BUCKETS) -> DataFrame:
        """The next snapshot with rows in place of those of the same key, whatever cycle they were in.

        Partitions are by ``by`` and a bucket of the key. Written are the partitions of rows, and of other cycles those
        that lose a key; all others are taken over as they are. rows must have one row for each key.
        """
        number, content = self._snapshot(name)
        if content["folders"] and content["buckets"] != buckets:
            raise ValueError(f"{name} is stored with {content['buckets']} buckets")
        scratch = work_dir(self.spark, "incoming")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
        fresh = written(rows.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")), scratch)
        place = lambda df: {(_NO_VALUE if r[by] is None else str(r[by]), r["bucket"]) for r in df.select(by, "bucket").distinct().collect()}  # noqa: E731  at most cycles x buckets
        touched, merged = place(fresh), fresh
        old = {f: self._place(f, by) for f in content["folders"]}
        beside = [f for f, at in old.items() if at[1] in {b for _, b in touched}]
        if beside:
            current = self._folders(name, beside, f"{schema}, bucket int").select(fresh.columns)
            # keys that are replaced are few in most loads: they are written, so that the rows they replace need not be shuffled
            replaced = written(current.select(*key, by, "bucket").join(fresh.select(*key), list(key), "left_semi"), f"{scratch}-replaced")
            touched |= place(replaced)
            rewritten = [f for f in beside if old[f] in touched]
            if rewritten:
                current = self._folders(name, rewritten, f"{schema}, bucket int").select(fresh.columns)
                merged = current.join(replaced.select(*key), list(key), "left_anti").unionByName(fresh)
        folder = f"load={uuid.uuid4().hex}"
        base = f"{self.root}/{name}/data"
        # a partition is dealt over as many tasks as its rows need
        spread = 1 + merged.select(by).count() // (PART_ROWS * buckets)
        part = F.pmod(F.shiftright(F.xxhash64(*key), 20), F.lit(spread))
        merged.repartition(by, "bucket", part).write.partitionBy(by, "bucket").parquet(f"{base}/{folder}")
        new = [f[f.index(folder) :] for f in self._listed(f"{base}/{folder}/{by}=*/bucket=*")]
        kept = [f for f, at in old.items() if at not in touched]
        self._claim(name, number + 1, {"folders": [*kept, *new], "buckets": buckets})
        removed(self.spark, scratch)
        removed(self.spark, f"{scratch}-replaced")
        return self.read(name, schema)

    @staticmethod
    def _place(folder: str, by: str) -> tuple[str, int]:
        parts = dict(p.split("=", 1) for p in folder.split("/"))
        return parts[by], int(parts["bucket"])

    def clean(self, name: str, keep: int = 2) -> None:
        """Removes snapshots but the newest, and folders that none of these names. Call it when nothing reads older ones."""
        found = self.versions(name)
        for old in found[: max(0, len(found) - keep)]:
            removed(self.spark, old)
        texts = [r["value"] for v in found[-keep:] for r in self.spark.read.text(v, wholetext=True).collect()]
        named = {f for t in texts for f in json.loads(t)["folders"]}
        loads = {f.split("/")[0] for f in named}
        for path in self._listed(f"{self.root}/{name}/data/load=*"):
            load = path.rpartition("/")[2]
            if load not in loads:
                removed(self.spark, path)
            elif load not in named:
                for part in self._listed(f"{path}/*=*/bucket=*"):
                    if part[part.index(load) :] not in named:
                        removed(self.spark, part)

    # --- cycles that are loaded -------------------------------------------------------------------------------------

    def cycle_loaded(self, cycle: int) -> bool:
        return not self.read("cycle_load", CYCLE_LOAD).filter(F.col("cycle") == cycle).isEmpty()

    def mark_cycle(self, cycle: int) -> DataFrame:
        marks = self.read("cycle_load", CYCLE_LOAD).filter(F.col("cycle") != cycle)
        return self.write("cycle_load", marks.unionByName(self.spark.range(1).select(F.lit(cycle).cast("int").alias("cycle"), F.current_timestamp().alias("loaded_at"))).coalesce(1))

    # --- answers that were looked up -------------------------------------------------------------------------------

    def resolutions(self, retry_nulls: bool = False) -> DataFrame:
        """Cached answers; retry_nulls leaves out those without a match, so that they are asked again."""
        cached = self.read("resolution", RESOLUTION)
        return cached.filter("id is not null") if retry_nulls else cached

    # --- scores -----------------------------------------------------------------------------------------------------

    def write_scores(self, computed: DataFrame, brands: DataFrame, cycles: Sequence[int]) -> DataFrame:
        """Computed scores of brands (name) that exist, upserted; what was not computed again stays. Clustered by brand for lookups."""
        fresh = computed.withColumns({"cycles": F.array(*(F.lit(c).cast("int") for c in cycles)), "computed_at": F.current_timestamp()})
        rows = scores_written(self.read("brand_score", SCORE), fresh, brands)
        return self.write("brand_score", rows.repartitionByRange("brand_name").sortWithinPartitions("brand_name", "issue_name", "scorecard_org"))

    def scores(self) -> DataFrame:
        """Stored scores; a filter on brand_name reaches the files, whose rows are in its order."""
        return self.read("brand_score", SCORE)

    # --- names by what is in them ----------------------------------------------------------------------------------

    def write_name_index(self, name: str, names: DataFrame) -> DataFrame:
        """Posting lists of the names' three-character runs, in folders by bucket, sorted, so that a search reads few files."""
        rows = filters.name_postings(names).repartition("bucket").sortWithinPartitions("gram", "name")
        return self.write(name, rows, by=("bucket",))

    def named(self, name: str, part: str) -> DataFrame | None:
        """(name) of the indexed names that hold part, without regard to case; None where part is too short for the index."""
        return filters.names_with(self.need(name, filters.POSTING), part)

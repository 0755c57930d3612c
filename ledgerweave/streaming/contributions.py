"""Contributions as a file stream: the state of each key decides what is an amendment, and only amendments reach the table.

Files come in any order. Each gift's key holds one state: its newest row, when that came, and how often the gift was
written. A write that is older than that is late and dropped without a look at the table; one that is newer is passed on,
and each micro-batch merges what was passed on into a table partitioned by cycle and key bucket, in which it writes only
the partitions that change. A micro-batch that runs again after a failure merges the same rows and changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledgerweave.operators.filters import supported
from ledgerweave.plans.store import Store

KEY = ("committee_id", "candidate_id", "transaction_id")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_on_disk(spark: SparkSession):
    """The state is kept in RocksDB, not in the heap; the setting is read when a query starts and given back after."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def contributions_stream(spark: SparkSession, source: str, schema: StructType, files: int | None = None) -> DataFrame:
    """New Parquet files of supporting contributions, at most ``files`` of them in a micro-batch, with ``_line``, a row's place in its file."""
    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)
    return supported(rows.select("*", F.col("_metadata.row_index").alias("_line")))


def amendments(stream: DataFrame, key: Sequence[str] = KEY, order: Sequence[str] = ("load_seq",)) -> DataFrame:
    """The stream's rows that are newer than all before of their key, one for each key and micro-batch, with ``writes``.

    A write without a place in the order counts as older than any with one; of equal places the first that came stays. The
    time of a micro-batch stands for all its rows, also when it runs again, and tells rows that came with it from kept ones.
    """
    columns, rest = [c for c in stream.columns if c != "_line"], [c for c in stream.columns if c not in (*key, "_line")]
    came = F.unix_millis(F.current_timestamp())
    rows = stream.withColumn("_came", came)
    place = F.struct(*order, (-F.col("_came")).alias("earlier"), (-F.col("_line")).alias("above"))
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest, "_came"), place).alias("last"), F.count(F.lit(1)).alias("writes"))
    return last.filter(F.col("last._came") == came).select(*(F.col(c) if c in key else F.col(f"last.{c}").alias(c) for c in columns), "writes")


def merge_available(
    spark: SparkSession, source: str, target: str, checkpoint: str, schema: StructType, key: Sequence[str] = KEY, order: Sequence[str] = ("load_seq",), by: str = "cycle", files: int | None = None, buckets: int = 4
) -> DataFrame:
    """Merges all files that are there and not merged yet; returns the table, a Store's ``contribution`` below target.

    Called again with the same checkpoint it goes on where it stopped, with the state it had.
    """
    store = Store(spark, target)
    stored = StructType([*schema.fields, StructField("writes", LongType())])
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.fields)
    whole = by not in schema.fieldNames()  # then all rows are of one cycle

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn(by, F.lit(0)) if whole else batch
        store.merge("contribution", rows, key, by, buckets)  # the batch's only use: each would compute it again

    with _state_on_disk(spark):
        rows = amendments(contributions_stream(spark, source, schema, files), key, order)
        query = rows.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return store.read("contribution", ddl)

"""The queue as a stream: event log in, current state of each work item out, leases that run out by timer, outcomes that are recorded once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "work_id long, state string, attempts long, retries long, last_sequence long"
_TO = {"admitted": "pending", "retry_scheduled": "pending", "released": "pending", "leased": "leased", "succeeded": "succeeded", "failed": "failed", "cancelled": "cancelled"}
#: A lease without further events for so long returns its item to pending; events are known again for so long.
LEASE_MILLIS, REMEMBER_MILLIS = 60_000, 7 * 86_400_000
_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Events as Parquet files arrive."""
    return spark.readStream.schema(schema).parquet(path)


class Fold(StatefulProcessor):
    """One work item: its state so far, the events it has seen, a timer while it is leased."""

    def __init__(self, lease_millis: int, remember_millis: int):
        self.lease, self.remember = lease_millis, remember_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "decided long, state string, attempts long, retries long, last long")
        self.seen = handle.getMapState("seen", "sequence long", "kind string", ttlDurationMs=self.remember)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """The newest deciding event gives the state, in whatever order events come; an event that was seen before counts for nothing."""
        decided, state, attempts, retries, last = self.item.get() if self.item.exists() else (-1, None, 0, 0, -1)
        fresh = False
        for pdf in rows:
            for sequence, kind in zip(pdf["sequence"].tolist(), pdf["kind"].tolist()):
                if self.seen.containsKey((sequence,)):
                    continue
                self.seen.updateValue((sequence,), (kind,))
                fresh, last = True, max(last, sequence)
                attempts += kind == "leased"
                retries += kind == "retry_scheduled"
                if kind in _TO and sequence > decided:
                    decided, state = sequence, _TO[kind]
        if fresh:
            self.item.update((decided, state, attempts, retries, last))
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at if isinstance(at, int) else at[0])
            if state == "leased":
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.lease)
            yield self._row(key, state, attempts, retries, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A lease that nothing extended: the item goes back, to be tried once more."""
        decided, state, attempts, retries, last = self.item.get()
        if state == "leased":
            self.item.update((decided, "pending", attempts, retries + 1, last))
            yield self._row(key, "pending", attempts, retries + 1, last)

    def _row(self, key, state, attempts, retries, last) -> pd.DataFrame:
        return pd.DataFrame([(key[0], state, attempts, retries, last)], columns=["work_id", "state", "attempts", "retries", "last_sequence"])

    def close(self) -> None:
        return


def fold_stream(events: DataFrame, lease_millis: int = LEASE_MILLIS, remember_millis: int = REMEMBER_MILLIS) -> DataFrame:
    """State changes of work items; events: work_id, sequence, kind.

    The last row of each item is what queue.fold says of all its events, however they are shuffled or repeated within
    remember_millis; leases that run out come on top. State lives in RocksDB: the session's provider is set to it.
    """
    if events.sparkSession.conf.get(_PROVIDER) != _ROCKS:
        events.sparkSession.conf.set(_PROVIDER, _ROCKS)
    return events.groupBy("work_id").transformWithStateInPandas(Fold(lease_millis, remember_millis), OUT, "Update", "ProcessingTime")


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events per kind and window of event time; later events than the watermark allows are dropped by Spark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "kind").agg(F.count(F.lit(1)).alias("n"))


#: Folders that keys are dealt to; keys of a batch that are looked up by value.
BUCKETS, LOOKED_UP = 1024, 10_000


def _commits(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/_commits")
    return jvm, folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commit_outcomes(batch: DataFrame, epoch: int, path: str) -> int:
    """foreachBatch sink of one stream: outcomes (key and more) that are not there yet; how many it wrote, -1 for an epoch that was committed before.

    Outcomes are dealt to folders by a hash of the key and by epoch. A batch reads the keys of its own buckets only, and of these
    files (each with a Bloom filter over its keys) those that may have one of its keys. What a try that failed has left is of this epoch: it is not read and
    is overwritten. The commit is one rename; readers see committed epochs only. The first of a batch's rows of one key stays, any of them.
    """
    spark = batch.sparkSession
    jvm, folder, fs = _commits(spark, path)
    done = jvm.org.apache.hadoop.fs.Path(folder, f"{epoch}")
    if fs.exists(done):
        return -1
    new = batch.dropDuplicates(["key"]).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")).withColumn("epoch", F.lit(epoch).cast("long"))
    new = new.persist()
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
    data = jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    fresh = new
    if touched and fs.exists(data):
        there = spark.read.schema(new.schema).parquet(f"{path}/data").filter(F.col("bucket").isin(touched) & (F.col("epoch") != epoch))
        keys = [r["key"] for r in new.select("key").limit(LOOKED_UP + 1).collect()]
        if len(keys) <= LOOKED_UP:
            there = there.filter(F.col("key").isin(keys))
        fresh = new.join(there.select("bucket", "key"), ["bucket", "key"], "left_anti").select(*new.columns)
    n = fresh.count()
    if n:
        writer = fresh.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#key", "true")
        writer.partitionBy("bucket", "epoch").parquet(f"{path}/data")
    new.unpersist()
    staged = jvm.org.apache.hadoop.fs.Path(folder, f".{epoch}.staged")
    fs.create(staged, True).close()
    if not fs.rename(staged, done):
        raise OSError(f"epoch {epoch} was committed by someone else meanwhile")
    return n


def committed_outcomes(spark: SparkSession, path: str, schema) -> DataFrame:
    """All outcomes of committed epochs, without those of a try that failed. Epochs are told by their range and the gaps in it."""
    _, folder, fs = _commits(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    known = sorted(int(x) for x in names if x.isdigit())
    if not known:
        return spark.createDataFrame([], schema)
    gaps = sorted(set(range(known[0], known[-1] + 1)) - set(known))
    rows = spark.read.parquet(f"{path}/data").filter(F.col("epoch").between(known[0], known[-1]))
    return (rows.filter(~F.col("epoch").isin(gaps)) if gaps else rows).drop("bucket", "epoch")

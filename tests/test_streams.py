"""The queue's stream against the batch fold, leases that run out, and outcomes recorded once."""

import random
import time

from pyspark.sql import functions as F

from lodestar.operators import queue
from lodestar.streaming import queue_stream as S

EVENT = "sequence long, work_id long, kind string"


def run_until(folded, out, checkpoint, done):
    """Run the stream until done() holds."""
    q = folded.writeStream.outputMode("update").foreachBatch(lambda b, e: b.withColumn("epoch", F.lit(e)).write.mode("append").parquet(out)).option("checkpointLocation", checkpoint).trigger(processingTime="1 second").start()
    end = time.time() + 120
    try:
        while time.time() < end and q.exception() is None and not done():
            time.sleep(1)
        assert q.exception() is None and done()
    finally:
        q.stop()


def latest(spark, out):
    rows = spark.read.parquet(out)
    return {r["work_id"]: tuple(r["r"])[1:] for r in rows.groupBy("work_id").agg(F.max(F.struct("epoch", "state", "attempts", "retries", "last_sequence")).alias("r")).collect()}


def test_shuffled_and_repeated_events_fold_as_in_a_batch(spark, tmp_path):
    rng = random.Random(3)
    kinds = ["admitted", "leased", "heartbeat", "retry_scheduled", "succeeded", "failed", "released"]
    events = [(k, rng.randrange(8), rng.choice(kinds)) for k in range(120)]
    want = {r["work_id"]: (r["state"], r["attempts"], r["retries"], r["last_sequence"]) for r in queue.fold(spark.createDataFrame(events, EVENT)).collect()}
    shuffled = events + rng.sample(events, 40)
    rng.shuffle(shuffled)
    for k in range(3):
        spark.createDataFrame(shuffled[k::3], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")

    def done():
        return (tmp_path / "out").exists() and any((tmp_path / "out").glob("*.parquet")) and latest(spark, out) == want

    run_until(S.fold_stream(stream, lease_millis=600_000), out, str(tmp_path / "cp"), done)


def test_a_lease_that_ends_returns_its_item(spark, tmp_path):
    spark.createDataFrame([(1, 1, "admitted"), (2, 1, "leased"), (3, 2, "leased"), (4, 2, "succeeded")], EVENT).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")

    def done():
        return (tmp_path / "out").exists() and any((tmp_path / "out").glob("*.parquet")) and latest(spark, out) == {1: ("pending", 1, 1, 2), 2: ("succeeded", 1, 0, 4)}

    run_until(S.fold_stream(S.event_stream(spark, str(tmp_path / "in"), EVENT), lease_millis=1500), out, str(tmp_path / "cp"), done)


def test_outcomes_are_recorded_once(spark, tmp_path):
    path = str(tmp_path / "o")
    frame = lambda rows: spark.createDataFrame(rows, "key string, v int")
    assert S.commit_outcomes(frame([("a", 1), ("b", 1), ("a", 1)]), 0, path) == 2
    assert S.commit_outcomes(frame([("a", 1), ("b", 1)]), 0, path) == -1  # replayed
    assert S.commit_outcomes(frame([("b", 2), ("c", 2)]), 1, path) == 1
    read = lambda: sorted((r["key"], r["v"]) for r in S.committed_outcomes(spark, path, "key string, v int").collect())
    assert read() == [("a", 1), ("b", 1), ("c", 2)]
    # a try that wrote and then died: its rows are not there for readers, and its epoch is done again
    left = frame([("d", 9)]).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(S.BUCKETS)).cast("int")).withColumn("epoch", F.lit(2).cast("long"))
    left.write.mode("append").partitionBy("bucket", "epoch").parquet(f"{path}/data")
    assert read() == [("a", 1), ("b", 1), ("c", 2)]
    assert S.commit_outcomes(frame([("d", 3), ("a", 3)]), 2, path) == 1 and read() == [("a", 1), ("b", 1), ("c", 2), ("d", 3)]
    assert S.commit_outcomes(frame([]), 3, path) == 0 and S.commit_outcomes(frame([("e", 4)]), 5, path) == 1 and len(read()) == 5


def test_a_batch_reads_its_own_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BUCKETS", 16)
    path = str(tmp_path / "o")
    for epoch in range(3):
        S.commit_outcomes(spark.range(epoch * 300, epoch * 300 + 300).select(F.col("id").cast("string").alias("key"), F.lit(epoch).alias("v")), epoch, path)
    there = spark.read.parquet(f"{path}/data")
    bucket = there.first()["bucket"]
    plan = there.filter(F.col("bucket").isin([bucket]))._jdf.queryExecution().executedPlan().toString()
    assert f"(bucket#" in plan.partition("PartitionFilters: [")[2].partition("]")[0]
    assert S.commit_outcomes(spark.range(0, 600).select(F.col("id").cast("string").alias("key"), F.lit(9).alias("v")), 3, path) == 0

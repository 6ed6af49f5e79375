"""Intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _OWN.setdefault("local", "file://" + tempfile.mkdtemp(prefix="lodestar-"))


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended before the interpreter: the cluster's own retention clears the folder
        return


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and lost executors don't lose it. Removed when the driver exits."""
    path = f"{_folder(df.sparkSession)}/lodestar-cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, condition: str = "true") -> tuple[DataFrame, int]:
    """cut(df), and how many of its rows meet the condition: counted while they are written, without another job."""
    seen = Observation()
    out = cut(df.observe(seen, F.count_if(F.expr(condition)).alias("n")))
    return out, seen.get["n"]


#: Pairs that a task of pairs_by makes, about.
PAIRS = 1 << 24


def pairs_by(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined with right by a key of which a few values may make most pairs: a value's left rows are dealt over slices of about PAIRS pairs, its right rows copied to each."""
    count = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    slices = count(left, "_left").join(count(right, "_right"), key)
    slices = cut(slices.select(key, F.least("_left", F.ceil(F.col("_left") * F.col("_right") / PAIRS)).cast("int").alias("_slices")))
    tasks = slices.agg(F.sum("_slices")).first()[0] or 1
    dealt = left.join(slices, key).withColumn("_slice", F.pmod(F.xxhash64(*left.columns), "_slices").cast("int")).drop("_slices")
    copied = right.join(slices, key).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")
    return dealt.repartition(min(2 * tasks, 20_000), key, "_slice").join(copied, [key, "_slice"]).drop("_slice")

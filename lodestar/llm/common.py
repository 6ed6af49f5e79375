"""Shared helpers: the shared working folder, table reading and checkpoints that survive executor loss."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset (local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            base = set_before.get()
        elif spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            base = _OWN.setdefault("local", "file://" + tempfile.mkdtemp(prefix="lodestar-"))
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended before the interpreter: the cluster's own retention clears the folder
        return


def new_table(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver exits."""
    path = f"{shared_dir(spark)}/lodestar-{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and lost executors don't lose it."""
    path = new_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch that goes to a Python worker, about; Spark's own bound is 64 MB.
ARROW_BYTES = 4 << 20
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow_bounded(df: DataFrame) -> DataFrame:
    """df; from now on its session's batches to Python hold ARROW_BYTES at most (or one row), unless the session has a bound of its own."""
    if df.sparkSession.conf.get(_ARROW_BYTES) in (None, "67108864b"):
        df.sparkSession.conf.set(_ARROW_BYTES, f"{ARROW_BYTES}b")
    return df


def release() -> None:
    """Give memory that a Python worker has freed back to the system: workers live on, and share an executor's memory."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        return


def whole_id(name: str) -> Column:
    """An id as text, for pandas: there a null makes the other ids of a batch floats, which hold 53 bits."""
    return F.col(name).cast("long").cast("string")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: Bits of a membership bitmap, at most (16 MB), so that a broadcast of it has a bound whatever the input.
BITS = 1 << 27
_ROW = 1 << 15
#: Helper columns beside columns of any name.
MAYBE, _AT, _BIT_ROW, _BIT_MAP, _KEY, _GONE, _LEAST, _PART = (f"__lodestar_{x}_column" for x in ("maybe", "at", "bit_row", "bit_map", "key", "gone", "least", "part"))


class Bitmap:
    """Which of few keys a row may have: a one-hash filter, built and tested with built-in functions.

    It only spares rows that surely have no such key from a join that follows; false hits cost, but change nothing.
    """

    def __init__(self, keys: DataFrame, *cols: str):
        n = keys.count()
        self.bits = max(1 << 20, min(BITS, 1 << (16 * max(n, 1) - 1).bit_length()))
        at = self._at(*[F.col(c) for c in cols])
        self.rows = keys.select(at.alias("at")).groupBy(F.expr(f"at div {_ROW}").alias(_BIT_ROW)).agg(F.bitmap_construct_agg(F.col("at") % _ROW).alias(_BIT_MAP))

    def _at(self, *cols: Column) -> Column:
        return F.pmod(F.xxhash64(*cols), F.lit(self.bits))

    def mark(self, df: DataFrame, *cols: Column) -> DataFrame:
        """df with a boolean column MAYBE; its other columns may have any name."""
        df = df.withColumn(_AT, self._at(*cols))
        df = df.join(F.broadcast(self.rows), F.expr(f"{_AT} div {_ROW}") == F.col(_BIT_ROW), "left")  # at most BITS bits
        byte = F.conv(F.hex(F.substring(_BIT_MAP, F.expr(f"cast(({_AT} % {_ROW}) div 8 as int) + 1"), F.lit(1))), 16, 10).cast("int")
        bit = F.expr(f"cast({_AT} % 8 as int)")
        hit = F.col(_BIT_ROW).isNotNull() & (F.expr("1").bitwiseAND(F.call_function("shiftright", byte, bit)) == 1)
        return df.withColumn(MAYBE, F.coalesce(hit, F.lit(False))).drop(_AT, _BIT_ROW, _BIT_MAP)

    def maybe(self, df: DataFrame, *cols: Column) -> DataFrame:
        """The rows of df that may have one of the keys."""
        return self.mark(df, *cols).filter(F.col(MAYBE)).drop(MAYBE)


#: Rows of one key that one task joins, about; a key with more is spread, over WIDEST tasks at most (adaptive execution splits those on).
PER_TASK, WIDEST = 4096, 1024


def join_uneven(left: DataFrame, right: DataFrame, key: str, n: str, by: Column, how: str = "inner") -> DataFrame:
    """left joined with right on key. right has one row a key, small, whose n says how many rows of left have it, about.

    Keys of many rows meet their row of right in several tasks, dealt by a hash of `by`, columns of left. Only these
    keys' rows of right are copied, at most WIDEST ** 2 times as many as the largest key goes into all rows.
    """
    most = right.agg(F.max(n)).first()[0] or 0
    if most <= PER_TASK:
        return left.join(right, key, how)
    parts = min(WIDEST, -(-most // PER_TASK))
    big = Bitmap(right.filter(F.col(n) > -(-most // parts)).select(key), key)
    marked, of = big.mark(left, F.col(key)), big.mark(right, F.col(key))
    few = marked.filter(~F.col(MAYBE)).drop(MAYBE).join(of.filter(~F.col(MAYBE)).drop(MAYBE), key, how)
    spread = of.filter(F.col(MAYBE)).drop(MAYBE).withColumn(_PART, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    many = marked.filter(F.col(MAYBE)).drop(MAYBE).withColumn(_PART, F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")).join(spread, [key, _PART], how).drop(_PART)
    return few.unionByName(many)


def without_rows(df: DataFrame, gone: DataFrame, key: Column, gone_key: str) -> DataFrame:
    """Rows of df whose key is not among gone's; only rows that may be are shuffled."""
    marked = Bitmap(gone, gone_key).mark(df, key)
    keep = marked.filter(~F.col(MAYBE)).drop(MAYBE)
    rest = marked.filter(F.col(MAYBE)).drop(MAYBE).withColumn(_KEY, key)
    rest = rest.join(gone.select(F.col(gone_key).alias(_GONE)).distinct(), F.col(_KEY) == F.col(_GONE), "left_anti").drop(_KEY)
    return keep.unionByName(rest)


def without_copies(df: DataFrame, lost: DataFrame, key: Column) -> DataFrame:
    """Rows of df whose key is not among lost's `gone`; of rows whose key is there with `again` one stays, the least as JSON."""
    lost = stash(lost.distinct(), "gone")
    kept = without_rows(df, lost, key, "gone")
    again = lost.filter("again").select(F.col("gone").alias(_KEY))
    if again.isEmpty():
        return kept
    found = Bitmap(again, _KEY).maybe(df, key).withColumn(_KEY, key).join(again, _KEY, "left_semi")
    row = F.struct(*df.columns)
    return kept.unionByName(found.groupBy(_KEY).agg(F.min_by(row, F.to_json(row)).alias(_LEAST)).select(f"{_LEAST}.*"))

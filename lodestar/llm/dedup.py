"""Exact deduplication by a log-structured merge index, with DataFrame functions only.

A memtable (a batch of rows, aggregated by digest) flushes as a run: a table bucketed by digest and sorted by it within
its buckets, with a membership filter over its digests. An entry is a digest, the best identifier (most code points in
the original text, then the smallest id) and the number of rows. When a level holds two runs, compaction merges them
into one of the next level: the buckets of both are aligned, so that the sort-merge join needs no shuffle. A probe
consults each run's filter, and only rows that pass it meet the run.

Hits, the rows whose digest more than one row has, receive byte verification: their normalised texts themselves are
grouped within their digest, so that a digest with two texts (a collision) is found, and its rows are told apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import MAYBE, Bitmap, delete, join_uneven, new_table, stash, text_or_empty, without_copies

#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Batches that a whole table is inserted in.
MEMTABLES = 4
#: Runs of a level that are merged into one of the next.
FANOUT = 2


def normalised(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def entries(rows: DataFrame) -> DataFrame:
    """One entry for each digest of rows (digest, neg, doc_id, row): `best` of neg (code points negated), doc_id, row; `size`, the number of rows."""
    return rows.groupBy("digest").agg(F.min(F.struct("neg", "doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("size"))


class Run:
    """Entries bucketed and sorted by digest, and a filter over the digests."""

    def __init__(self, made: DataFrame, buckets: int):
        self.spark, self.buckets = made.sparkSession, buckets
        self.path, self.name = new_table(self.spark, "run"), f"lodestar_run_{uuid.uuid4().hex}"
        made.write.bucketBy(buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)
        self.rows = self.spark.table(self.name)
        self._filter: Bitmap | None = None

    @property
    def filter(self) -> Bitmap:
        if self._filter is None:
            self._filter = Bitmap(self.rows, "digest")
        return self._filter

    def merge(self, other: "Run") -> "Run":
        """Both runs as one; entries of one digest become one. Aligned buckets: no shuffle."""
        a, b = self.rows, other.rows.select("digest", F.col("best").alias("best2"), F.col("size").alias("size2"))
        both = a.hint("merge").join(b, "digest", "full_outer")
        size = F.coalesce("size", F.lit(0)) + F.coalesce("size2", F.lit(0))
        return Run(both.select("digest", F.least("best", "best2").alias("best"), size.alias("size")), self.buckets)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


class Index:
    """Levels of runs; level k holds runs of about FANOUT ** k memtables."""

    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[Run]] = []

    def insert(self, rows: DataFrame) -> None:
        """Flush rows (digest, neg, doc_id, row) as a run, and compact levels that are full."""
        run, level = Run(entries(rows), self.buckets), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < FANOUT:
                return
            run, level = self._merged(self.levels[level]), level + 1
            self.levels[level - 1] = []

    def _merged(self, runs: list[Run]) -> Run:
        run = runs[0]
        for other in runs[1:]:
            both = run.merge(other)
            run.drop()
            other.drop()
            run = both
        return run

    def compact(self) -> Run:
        """All runs as one."""
        runs = [r for level in self.levels for r in level]
        run = self._merged(runs) if runs else Run(self.spark.createDataFrame([], "digest string, best struct<neg:int,doc_id:long,row:long>, size long"), self.buckets)
        self.levels = [[], [run]]
        return run

    def probe(self, batch: DataFrame) -> DataFrame:
        """batch (with digest) and found: the entry (best, size) of its digest over all runs, null where no run has it."""
        best, size = F.lit(None).cast("struct<neg:int,doc_id:bigint,row:bigint>"), F.lit(0).cast("long")
        out = batch.withColumn("found", F.when(F.lit(False), F.struct(best.alias("best"), size.alias("size"))))
        for run in (r for level in self.levels for r in level):
            marked = run.filter.mark(out, F.col("digest"))
            passed = marked.filter(F.col(MAYBE)).join(run.rows, "digest", "left")
            had = F.struct(F.least("found.best", "best").alias("best"), (F.coalesce("found.size", F.lit(0)) + F.col("size")).alias("size"))
            passed = passed.withColumn("found", F.when(F.col("size").isNull(), F.col("found")).otherwise(had))
            out = marked.filter(~F.col(MAYBE)).select(*out.columns).unionByName(passed.select(*out.columns))
        return out

    def drop(self) -> None:
        for run in (r for level in self.levels for r in level):
            run.drop()
        self.levels = []


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """For every row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are equal after blanks are deleted; null counts as empty, and empty texts are equal.
    Ties in code points go to the smallest id; a null id counts as smaller than any. Rows that share
    the keeper's id and length all carry its id, but kept is true for exactly one row of each group.
    An empty table gives an empty result; other columns are dropped.
    """
    return _ranked(docs, id_col, text_col, digest).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _ranked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows of exact_dedup with neg, and whether a row is `like_kept`: of the keeper's id and code points."""
    text = text_or_empty(text_col)
    norm = normalised(text)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(norm).alias("digest"), sha256(norm).alias("text_sha256"), F.xxhash64(norm).alias("other"), (-F.char_length(text)).alias("neg"), F.monotonically_increasing_id().alias("row"))
    rows = stash(rows, "rows")  # row numbers hold from here on
    index = Index(docs.sparkSession)
    for k in range(MEMTABLES):
        index.insert(rows.filter(F.pmod(F.xxhash64("row"), F.lit(MEMTABLES)) == k).select("digest", "neg", "doc_id", "row"))
    level = stash(index.compact().rows.filter("size > 1"), "level")
    index.drop()

    # byte verification of the hits: only texts that may have one of the digests leave the scan, each text once a task
    texts = Bitmap(level, "digest").maybe(docs.select(norm.alias("norm"), digest(norm).alias("digest")), F.col("digest"))
    collisions = stash(texts.distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"), "collisions")

    keep = level.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.neg").alias("keep_neg"), F.col("best.row").alias("keep_row"), F.col("size").alias("group_size"))
    out = join_uneven(rows, keep, "digest", "group_size", F.col("row"), "left")
    alone = F.col("group_size").isNull()
    keeper = [F.when(alone, F.col(own)).otherwise(F.col(kept)).alias(kept) for own, kept in (("doc_id", "keep_id"), ("neg", "keep_neg"), ("row", "keep_row"))]
    mine = ["doc_id", "digest", "text_sha256", "other", "neg", "row"]
    out = out.select(*mine, F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), *keeper)
    if not collisions.isEmpty():  # their rows are grouped by what tells the texts apart
        group = ["digest", "text_sha256", "other"]
        split = rows.join(collisions, "digest", "left_semi").groupBy(*group).agg(F.min(F.struct("neg", "doc_id", "row")).alias("k"), F.count(F.lit(1)).alias("k_size"))
        out = out.join(split, group, "left")
        hit = F.col("k_size").isNotNull()
        keeper = [F.when(hit, F.col(k)).otherwise(F.col(name)).alias(name) for k, name in (("k_size", "group_size"), ("k.doc_id", "keep_id"), ("k.neg", "keep_neg"), ("k.row", "keep_row"))]
        out = out.select(*mine, *keeper)
    like_kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("neg") == F.col("keep_neg"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "neg", like_kept.alias("like_kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the rows of documents that exact_dedup keeps, exactly one for each group, all columns as they were.

    Rows of the keeper's id and length differ in blanks or other columns at most; the least as JSON stays.
    """
    found = _ranked(docs).filter(~F.col("kept"))
    gone = found.select(_row_key(F.col("doc_id"), F.col("neg"), F.col("text_sha256")).alias("gone"), F.col("like_kept").alias("again"))
    text = text_or_empty()
    return without_copies(docs, gone, _row_key(F.col("doc_id").cast("long"), -F.char_length(text), sha256(normalised(text))))


def _row_key(doc_id: Column, neg: Column, sha: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), neg.cast("string"), sha)

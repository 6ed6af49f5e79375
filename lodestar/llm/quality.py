"""Quality by importance resampling: two hashed n-gram models, their log ratio as weight, Gumbel top-k as sample.

Target model: counts of hashed word unigrams and bigrams over a bounded sample of rows labelled good. Raw model: the
same counts over every document. A document's log weight is the sum over its n-grams of log p(bucket) - log q(bucket),
less a charge for each n-gram, which is fitted on labelled rows that the models have not seen: without a charge the
longest texts would weigh most whatever they hold. Adding independent Gumbel noise to the log weights (over a
temperature) and taking the k largest draws k documents without replacement in proportion to their weights. The noise is
a hash of the id, so a lost task's rerun draws the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_bounded, stash, text_or_empty, whole_id, without_rows
from lodestar.llm.textnum import PLAIN, batches, mix, word_hashes

BUCKETS = 1 << 16
#: At most so many labelled ids fit the target model and the charge; those of smallest hashed id.
LABELLED = 20_000
#: Share of labelled good rows whose weight may be below zero once the charge is fitted.
GOOD_LOST = 0.001
#: Log weights are divided by it before noise is added; 1 draws in proportion to the weights.
TEMPERATURE = 1.0


def grams(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, start of each text's n-grams, one more at the end); words split at ASCII blanks.

    A word's hash covers its case and marks, as these tell prose from shouting, tables and noise.
    """
    h, of = word_hashes(texts, PLAIN)
    if not len(h):
        return np.zeros(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
    with np.errstate(over="ignore"):
        pair = mix(h[:-1] * np.uint64(3) + h[1:])
    both = np.empty(2 * len(h) - 1, dtype=np.int64)
    both[::2] = (h % np.uint64(buckets)).astype(np.int64)
    both[1::2] = (pair % np.uint64(buckets)).astype(np.int64)
    keep = np.ones(len(both), dtype=bool)
    keep[1::2] = of[:-1] == of[1:]
    owner = np.repeat(of, 2)[:-1][keep]
    return both[keep], np.searchsorted(owner, np.arange(len(texts) + 1))


def counts(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """n-gram counts (bucket, raw, target) over all rows; rows: text, target. Each task sends one row a bucket at most."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, target = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for pdf in batches(frames):
            found, at = grams(pdf["text"].tolist(), buckets)
            raw += np.bincount(found, minlength=buckets)
            flags = np.repeat(pdf["target"].to_numpy(dtype=bool), np.diff(at))
            target += np.bincount(found[flags], minlength=buckets)
        seen = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": seen.astype(np.int32), "raw": raw[seen], "target": target[seen]})

    return arrow_bounded(rows).mapInPandas(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


class Model:
    """Log ratio for each bucket."""

    def __init__(self, ratio: np.ndarray):
        self.ratio = ratio

    @classmethod
    def fit(cls, found: pd.DataFrame, buckets: int = BUCKETS, smooth: float = 1.0) -> "Model":
        raw, target = np.zeros(buckets), np.zeros(buckets)
        raw[found["bucket"]] = found["raw"]
        target[found["bucket"]] = found["target"]
        if target.sum() == 0:  # nothing labelled: no preference
            return cls(np.zeros(buckets))
        q = (raw + smooth) / (raw.sum() + smooth * buckets)
        p = (target + smooth * buckets * q) / (target.sum() + smooth * buckets)  # the raw model is the target's prior
        return cls(np.log(p) - np.log(q))

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log weight and number of n-grams of each text."""
        found, at = grams(texts, len(self.ratio))
        total = np.concatenate(([0.0], np.cumsum(self.ratio[found])))
        return np.round(total[at[1:]] - total[at[:-1]], 6), np.diff(at)


def labelled(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """At most `limit` (doc_id, good) rows, those of smallest hashed id; a row labelled twice is good if all labels say so, null labels don't count."""
    clean = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_label_id")).agg((F.min("quality") >= 1).alias("_good"))
    return clean.orderBy(F.xxhash64("_label_id", F.lit(5)), "_label_id").limit(limit)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, limit: int = LABELLED, seed: int = 11, k: int | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """For every row: doc_id, n_grams, log_weight, mean_ratio, gumbel_key, accepted.

    log_weight: sum of the n-grams' log ratios, each less the charge; gumbel_key: log_weight / temperature plus Gumbel
    noise; accepted: among the k largest keys, ties at the k-th key included. k is by default the number of rows of
    weight zero or more, those that the target model explains better than the raw one. One half of the labelled sample
    (by a hash of the id) fits the target model; on the other half the charge is fitted so that it parts good from bad
    rows best while at most GOOD_LOST of the good weigh less than zero. Null and empty texts have no n-grams, no key and
    are not accepted when labels tell good from bad, as they hold nothing to train on. Without usable labels every row is
    accepted. Repeated rows have equal keys; null ids share one draw of noise. An empty table gives an empty result.
    Other columns are dropped.
    """
    return _judged(docs, labels, F.lit(None), id_col, text_col, buckets, limit, seed, k, temperature).drop("key")


def _judged(docs: DataFrame, labels: DataFrame, key: Column, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, limit: int = LABELLED, seed: int = 11, k: int | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """The rows of quality with a key of their own."""
    spark = docs.sparkSession
    sample = stash(labelled(docs, labels, limit), "labelled")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_id(id_col).alias("id"), key.cast("string").alias("key"), text_or_empty(text_col).alias("text"))
    flagged = rows.join(F.broadcast(sample), F.col("doc_id") == F.col("_label_id"), "left")  # at most `limit` rows of 9 bytes
    held = F.pmod(F.xxhash64("_label_id", F.lit(29)), F.lit(2)) == 1
    target, good = F.coalesce(F.col("_good") & ~held, F.lit(False)), F.when(held, F.col("_good").cast("string"))
    found = counts(flagged.select("text", target.alias("target")), buckets).toPandas()  # one row a bucket
    shared = spark.sparkContext.broadcast(Model.fit(found, buckets).ratio)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(shared.value)
        for pdf in batches(frames):
            w, n = m.scores(pdf["text"].tolist())
            yield pd.DataFrame({"id": pdf["id"], "key": pdf["key"], "good": pdf["good"], "ratio": w, "n_grams": n.astype(np.int64)})

    scored = arrow_bounded(flagged.select("id", "key", "text", good.alias("good"))).mapInPandas(score, "id string, key string, good string, ratio double, n_grams long")
    scored = stash(scored.select(F.col("id").cast("long").alias("doc_id"), "key", F.col("good").cast("boolean").alias("good"), "ratio", "n_grams"), "weights")
    mean = F.when(F.col("n_grams") > 0, F.round(F.col("ratio") / F.col("n_grams"), 9))
    scored = scored.withColumn("mean_ratio", mean)
    known = scored.filter("good is not null and n_grams > 0").groupBy("doc_id", "good").agg(F.avg("mean_ratio").alias("mean_ratio"))
    charge = fit_cut(known.select("good", "mean_ratio").toPandas())  # at most `limit` labelled ids
    weight = F.round(F.col("ratio") - F.col("n_grams") * F.lit(charge or 0.0), 6)
    uniform = (F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    noisy = F.round(F.col("log_weight") / F.lit(temperature) - F.log(-F.log(uniform)), 9)
    keyed = scored.withColumn("log_weight", weight).withColumn("gumbel_key", F.when(F.col("n_grams") > 0, noisy))
    shape = ["doc_id", "key", "n_grams", "log_weight", "mean_ratio", "gumbel_key"]
    if charge is None:
        return keyed.select(*shape, F.lit(True).alias("accepted"))
    wanted = keyed.filter("n_grams > 0 and log_weight >= 0").count() if k is None else k
    least = kth_largest(keyed, "gumbel_key", wanted)
    return keyed.select(*shape, F.coalesce(F.col("gumbel_key") >= F.lit(least), F.lit(False)).alias("accepted"))


def fit_cut(known: pd.DataFrame) -> float | None:
    """The cut that misplaces fewest labelled rows (in shares of either kind) among those that lose at most GOOD_LOST of the good."""
    good, bad = np.sort(known.loc[known["good"].astype(bool), "mean_ratio"]), np.sort(known.loc[~known["good"].astype(bool), "mean_ratio"])
    if not len(good) or not len(bad):
        return None
    most = float(good[int(GOOD_LOST * len(good))])  # no more good rows than that lie below it
    tried = np.unique(np.concatenate((bad[bad < most], [most])))
    lost = np.searchsorted(good, tried) / len(good)
    kept = 1 - np.searchsorted(bad, tried) / len(bad)
    at = int((lost + kept).argmin())
    below = max([float(x) for x in (good[good < tried[at]][-1:].tolist() + bad[bad < tried[at]][-1:].tolist())], default=float(tried[at]) - 1e-6)
    return (float(tried[at]) + below) / 2


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 4096) -> float:
    """The exact k-th largest value of a column, by narrowing an interval with one histogram a pass; +inf if k is 0."""
    if k <= 0:
        return float("inf")
    lo, hi, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if not n or k >= n:
        return float("-inf") if not n else lo
    while lo < hi:  # ends: the least and the largest value never share a bin
        width = (hi - lo) / bins
        within = df.filter((F.col(col) >= lo) & (F.col(col) <= hi))
        above = df.filter(F.col(col) > hi).count()
        at = F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
        got = within.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).toPandas().sort_values("bin", ascending=False)
        run = above + got["n"].cumsum()
        row = got[run >= k].iloc[0]
        lo, hi = float(row["lo"]), float(row["hi"])
        if row["n"] <= 100_000 or width == 0:
            over = df.filter(F.col(col) > hi).count()
            values = df.filter((F.col(col) >= lo) & (F.col(col) <= hi)).select(col).toPandas()[col].sort_values(ascending=False)
            return float(values.iloc[k - over - 1])
    return lo


def accepted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pipeline stage: the rows of documents that quality() accepts, all columns as they were. Rows equal in id and text share one decision."""
    key = F.concat_ws(":", F.coalesce(whole_id("doc_id"), F.lit("null")), F.sha2(text_or_empty().cast("binary"), 256))
    bad = stash(_judged(docs, labels, key).filter(~F.col("accepted")).select(F.col("key").alias("gone")), "rejected")
    return without_rows(docs, bad, key, "gone")

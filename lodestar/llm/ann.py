"""Approximate nearest neighbours by multiprobe p-stable hashing.

Inner product search becomes Euclidean search by one more component (sqrt(M^2 - |x|^2) for candidates, 0 for queries).
A table hashes a vector to the slots of `m` Gaussian projections. For a neighbour at distance r the difference of two
projections is normal with deviation r, which gives each perturbation of the query's slots its probability of holding
the neighbour. A query visits buckets by falling probability until they sum to what a table must contribute to the
target; candidates of all tables are merged and ranked by the exact inner product of the original vectors.

Equal vectors are one candidate with its K + 1 smallest ids, more no query can return. Buckets are dealt to parts;
those larger than a part are split by a hash of the vector, and queries visit all their splits: nothing is capped.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import stash

K = 20
#: Tables; slot width in units of the projections' deviation; estimated recall at which a query stops.
TABLES, SLOT, TARGET = 4, 1.0, 0.965
#: Rows of a part, about; tables of no more distinct vectors of a dimension are searched whole.
PART = 4096
#: Vectors of the sample from which the usual distance of the K-th neighbour is taken; nothing else depends on it.
SAMPLE = 4000
#: Columns that give a query's floor before all are screened.
FIRST = 1024


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (array<double>) without vectors that are null, empty, zero or hold null or non-finite components."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(F.coalesce(fine, F.lit(False)))


class Hashes:
    """Projections of all tables for one dimension, the same wherever they are made."""

    def __init__(self, dim: int, m: int, tables: int, top: float, r: float, seed: int = 17):
        rng = np.random.default_rng(seed + dim)
        self.m, self.tables, self.top, self.r, self.dim = m, tables, top, r, dim
        draws = [rng.normal(size=(dim + 1, m)) for _ in range(tables)]
        self.a = [np.linalg.qr(x)[0] * math.sqrt(dim + 1) if dim + 1 >= m else x for x in draws]
        self.b = [rng.uniform(0, SLOT, m) for _ in range(tables)]
        self.reach = math.ceil(6 * r / SLOT) + 1  # moves beyond it hold a neighbour with probability 1e-9

    def slots(self, x: np.ndarray, table: int, query: bool = False) -> np.ndarray:
        x = x / (np.linalg.norm(x, axis=1, keepdims=True) if query else self.top)
        more = np.zeros((len(x), 1)) if query else np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))
        return (np.concatenate((x, more), axis=1) @ self.a[table] + self.b[table]) / SLOT

    def code(self, slots: np.ndarray) -> np.ndarray:
        """One number for a bucket; slots beyond +-500 share the last ones."""
        s = np.clip(slots.astype(np.int64), -500, 500) + 500
        return s @ (1001 ** np.arange(self.m, dtype=np.int64))

    def probes(self, place: np.ndarray, need: float) -> np.ndarray:
        """Buckets of a query at `place` (slots with fractions) by falling probability, until they sum to need.

        Moves of all slots whose probabilities' product reaches a floor are listed slot by slot; products that cannot
        reach it any more are left out. The floor falls until the listed buckets sum to need.
        """
        low = np.floor(place)
        moves = np.arange(-self.reach, self.reach + 2)
        below = np.array([[0.5 * (1 + math.erf((d - x) * SLOT / (self.r * math.sqrt(2)))) for d in moves] for x in place - low])
        p = np.diff(below, axis=1)
        most = np.append(np.cumprod(p.max(axis=1)[::-1])[::-1][1:], 1.0)  # of the slots after each
        floor = 0.25 * float(np.prod(p.max(axis=1)))
        while True:
            chance, at = np.ones(1), np.zeros((1, 0), dtype=np.int64)
            for slot in range(self.m):
                both = chance[:, None] * p[slot]
                row, move = np.nonzero(both * most[slot] >= floor)
                chance, at = both[row, move], np.concatenate((at[row], move[:, None]), axis=1)
            if chance.sum() >= need:
                break
            floor /= 4
        order = np.argsort(-chance, kind="stable")
        n = int(np.searchsorted(np.cumsum(chance[order]), need)) + 1
        return np.unique(self.code(low + moves[at[order[:n]]]))


def _distance(rows: DataFrame, n: int, top: float, k: int) -> float:
    """Usual distance (after scaling) of a query's k-th neighbour, from a bounded sample."""
    got = rows.orderBy(F.xxhash64("vec_id", F.lit(23)), "vec_id").limit(SAMPLE).toPandas()
    x = np.array(got["v"].tolist(), dtype=float)
    if len(x) < 3:
        return 1.0
    q = x[:100] / np.linalg.norm(x[:100], axis=1, keepdims=True)
    s = q @ (x / top).T
    s[np.arange(len(q)), np.arange(len(q))] = -np.inf
    at = min(len(x) - 2, max(0, round(k * len(x) / n) - 1))
    near = -np.sort(-s, axis=1)[:, at]
    return float(np.clip(np.quantile(np.sqrt(np.maximum(0, 2 - 2 * near)), 0.6), 0.05, 2))


def enough(found: list[tuple[float, int]], k: int) -> list[tuple[float, int]]:
    """The head of a sorted list of (score, id) that holds the k first of every id's view, from which its own entries are absent."""
    out, often, most = [], Counter(), 0
    for pair in found:
        if often[pair[1]] < k:
            out.append(pair)
            often[pair[1]] += 1
            most = max(most, often[pair[1]])
            if len(out) - most >= k:
                break
    return out


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = K, target: float = TARGET, whole: int = PART) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every query row: rows whose id is divisible by `every`.

    Candidates are all rows but the query's own id; nearness is the largest inner product, ties go to the smaller id.
    Invalid vectors and null ids take no part; vectors of different dimensions don't meet. A query with no candidate
    has no row. Rows repeated with one id and vector count once; rows of one id with different vectors are candidates of
    their own, but none for a query of that id. Fewer than k candidates found give fewer rows. An empty table gives an
    empty result. Other columns are dropped. At most `whole` distinct vectors of a dimension are searched whole, without
    hashing: 0 hashes whatever has more than k + 1, a larger bound is the exact way.
    """
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vec_col).distinct()
    first = Window.partitionBy("v").orderBy("vec_id")
    ids = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    index = ids.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    index = stash(index.select(F.xxhash64(F.lit(1), "v").alias("k1"), F.xxhash64(F.lit(2), "v").alias("k2"), F.size("v").alias("dim"), "v", "ids"), "vectors")
    shape = "query_id long, rank int, vec_id long, score double"
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    wanted = stash(asked.select("v").distinct().select(F.xxhash64(F.lit(1), "v").alias("k1"), F.xxhash64(F.lit(2), "v").alias("k2"), F.size("v").alias("dim"), "v"), "queries")
    out = spark.createDataFrame([], "k1 long, k2 long, best array<struct<neg:double,vec_id:long>>")
    sizes = index.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("top")).orderBy("dim").collect()  # one row a dimension
    for dim, n, top in sizes:
        out = out.unionByName(_search(index.filter(F.col("dim") == dim), wanted.filter(F.col("dim") == dim), dim, n, top, k, target, n <= max(whole, k + 1)))
    asked = asked.select(F.col("vec_id").alias("query_id"), F.xxhash64(F.lit(1), "v").alias("k1"), F.xxhash64(F.lit(2), "v").alias("k2"))
    told = asked.join(stash(out, "found"), ["k1", "k2"])
    best = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    told = told.select("query_id", F.posexplode(best).alias("p", "b"))
    return told.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.neg")).alias("score")).select(*[c.split()[0] for c in shape.split(", ")])


def _search(index: DataFrame, queries: DataFrame, dim: int, n: int, top: float, k: int, target: float, whole: bool) -> DataFrame:
    parts = max(1, -(-n // PART))
    m = 4 + max(0, int(math.log(max(1, n / 65_536), 4)))
    tables = 1 if whole else TABLES
    m = 1 if whole else min(m, 8, dim + 1)
    r = _distance(index.select("ids", "v").select(F.col("ids")[0].alias("vec_id"), "v"), n, top, k)
    need = 1 - (1 - target) ** (1 / tables)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = Hashes(dim, m, tables, top, r)
        for pdf in frames:
            x = np.array(pdf["v"].tolist(), dtype=float).reshape(len(pdf), dim)
            for t in range(tables):
                yield pdf[["k1", "k2", "v", "ids"]].assign(t=t, bucket=0 if whole else h.code(np.floor(h.slots(x, t))))

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = Hashes(dim, m, tables, top, r)
        for pdf in frames:
            x = np.array(pdf["v"].tolist(), dtype=float).reshape(len(pdf), dim)
            for t in range(tables):
                places = h.slots(x, t, query=True)
                yield pdf[["k1", "k2"]].assign(t=t, buckets=[np.zeros(1, dtype=np.int64) if whole else h.probes(p, need) for p in places])

    placed = stash(index.mapInPandas(place, "k1 long, k2 long, v array<double>, ids array<long>, t int, bucket long"), "index")
    large = placed.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > PART).select("t", "bucket", F.ceil(F.col("size") / PART).cast("int").alias("splits"))
    large = stash(large, "large")

    def part(split):
        return F.pmod(F.xxhash64("bucket", split), F.lit(parts)).cast("int")

    one = F.coalesce("splits", F.lit(1))
    x = placed.join(large, ["t", "bucket"], "left").select("t", part(F.pmod(F.xxhash64("k1", "k2"), one).cast("int")).alias("part"), "bucket", "v", "ids")
    probes = queries.mapInPandas(probe, "k1 long, k2 long, t int, buckets array<long>").select("k1", "k2", "t", F.explode("buckets").alias("bucket"))
    probes = probes.join(large, ["t", "bucket"], "left").withColumn("split", F.explode(F.sequence(F.lit(0), one - 1))).select("k1", "k2", "t", part(F.col("split")).alias("part"), "bucket")
    visits = probes.groupBy("k1", "k2", "t", "part").agg(F.array_sort(F.collect_set("bucket")).alias("buckets"))
    visits = visits.join(queries.select("k1", "k2", "v"), ["k1", "k2"])

    def rank(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        """The best of the visited buckets for each query: screened in single precision with slack, scored in double."""
        out = []
        if len(q) and len(c):
            xs, code = np.stack(c["v"].to_list()), c["bucket"].to_numpy()
            ids = c["ids"].to_list()
            own, column = np.unique(code, return_inverse=True)
            scale = float(np.abs(xs).max())  # so that single precision holds any finite component
            low = np.ascontiguousarray((xs / scale).T, dtype=np.float32)
            longest = float(np.sqrt(((xs / scale) ** 2).sum(axis=1)).max())
            often = int(np.unique([i for row in ids for i in row], return_counts=True)[1].max())  # vectors that one id has
            floor_at = k - 1 + often  # so many may be a query's own
            for at in range(0, len(q), 256):
                block = q.iloc[at : at + 256]
                qs = np.stack(block["v"].to_list())
                visit = np.zeros((len(block), len(own)), dtype=bool)
                for row, want in enumerate(block["buckets"]):
                    visit[row, np.searchsorted(own, np.intersect1d(own, want, assume_unique=True))] = True
                small = qs / np.abs(qs).max(axis=1, keepdims=True)
                slack = (2 * (dim + 4) * 2.0**-23 * longest * np.sqrt((small * small).sum(axis=1))).astype(np.float32)[:, None]
                s = small.astype(np.float32) @ low
                first = np.where(visit[:, column[:FIRST]], s[:, :FIRST], -np.inf)
                if first.shape[1] > floor_at:  # a rank among the first columns is a floor for that among all
                    floor = -np.partition(-first, floor_at, axis=1)[:, floor_at : floor_at + 1] - slack
                else:
                    floor = np.full_like(slack, -np.inf)
                rows, cols = np.nonzero(s >= floor)
                seen = visit[rows, column[cols]]
                rows, cols = rows[seen], cols[seen]
                cuts = np.searchsorted(rows, np.arange(len(block) + 1))
                k1, k2 = block["k1"].to_list(), block["k2"].to_list()
                for row in range(len(block)):
                    mine = cols[cuts[row] : cuts[row + 1]]
                    if len(mine) > floor_at + 1:
                        near = s[row, mine]
                        mine = mine[near >= -np.partition(-near, floor_at)[floor_at] - slack[row]]
                    if len(mine):
                        score = (xs[mine] * qs[row]).sum(axis=1).tolist()
                        found = enough(sorted((-v, int(i)) for v, j in zip(score, mine.tolist()) for i in ids[j]), k)
                        out.append((k1[row], k2[row], [v for v, _ in found], [i for _, i in found]))
        return pd.DataFrame(out, columns=["k1", "k2", "neg", "vec"])

    ranked = visits.groupBy("t", "part").cogroup(x.groupBy("t", "part")).applyInPandas(rank, "k1 long, k2 long, neg array<double>, vec array<long>")
    pairs = ranked.select("k1", "k2", F.zip_with("neg", "vec", lambda a, b: F.struct(a.alias("neg"), b.alias("vec_id"))).alias("pairs"))
    merged = pairs.groupBy("k1", "k2").agg(F.sort_array(F.flatten(F.collect_list("pairs"))).alias("all"))  # at most 2 k of each part visited
    once = F.filter("all", lambda x, i: (i == 0) | (x != F.element_at("all", i)))  # a candidate of several tables stands side by side
    return merged.select("k1", "k2", once.alias("best"))

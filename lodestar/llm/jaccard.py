"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of hashed five-word shingles (64 bits). Equal sets are one class, so copies are never paired. Classes
meet in buckets of MinHash bands. Within a bucket two classes' MinHash values are compared step by step; a pair is
dropped as soon as the posterior probability (uniform prior) that its similarity reaches the threshold falls below the
tolerance. Those left are verified on the whole shingle sets. A pair that meets in several bands belongs to the first.

A bucket is dealt out in blocks, each pair of blocks a group of its own, so that no group is larger than two blocks;
what comes out of a group is one row for each class: how many documents it links to there, and one neighbour that
keeps the group's components together. Pairs themselves are never emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import Bitmap, arrow_bounded, join_uneven, stash, text_or_empty, whole_id, without_copies
from lodestar.llm.textnum import batches, mix, shingles

WIDTH, THRESHOLD = 5, 0.8
#: A pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8**4)**24 = 1 - 3e-6.
BANDS, ROWS = 24, 4
TOLERANCE = 1e-6
STEP = 16
#: Members of a block at most, about, and their shingles. A member of a bucket of b blocks is copied b times.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 20


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(sets: list[np.ndarray], n: int = BANDS * ROWS) -> np.ndarray:
    """MinHash values (uint32) of non-empty sets, one row each."""
    out = np.empty((len(sets), n), dtype=np.uint32)
    a = _multipliers(n)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 32_768):
            size += len(sets[end])
            end += 1
        h = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *(len(s) for s in sets[at : end - 1])])
        with np.errstate(over="ignore"):
            for k in range(n):
                out[at:end, k] = np.minimum.reduceat(((h * a[k]) >> np.uint64(32)).astype(np.uint32), starts)
        at = end
    return out


def fewest_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest of n equal values for which P(similarity >= threshold) is at least the tolerance, under a uniform prior."""
    p = 0.0
    for m in range(n + 1):
        p += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if p >= tolerance:
            return m
    return n + 1


def survivors(sig: np.ndarray, i: np.ndarray, j: np.ndarray, band: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """Which pairs (i, j) of rows of sig, met in `band`, stay: not pruned, and in no earlier band."""
    alive = np.arange(len(i))
    same = np.zeros(len(i), dtype=np.int32)
    for a in range(0, sig.shape[1], STEP):
        b = min(a + STEP, sig.shape[1])
        same[alive] += (sig[i[alive], a:b] == sig[j[alive], a:b]).sum(axis=1)
        alive = alive[same[alive] >= fewest_matches(b, threshold, tolerance)]
    if not len(alive):
        return alive
    equal = (sig[i[alive]] == sig[j[alive]]).reshape(len(alive), -1, ROWS).all(axis=2)
    return alive[equal.argmax(axis=1) == band[alive]]


def _pairs(sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within one block (sides 0), or between the two blocks (sides 0 and 1)."""
    if not sides.any():
        return np.triu_indices(len(sides), 1)
    left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    return np.repeat(left, len(right)), np.tile(right, len(left))


def _groups(frames: Iterator[pd.DataFrame], rows: int = 4096) -> Iterator[pd.DataFrame]:
    """Rows sorted by (bucket, lo, hi), cut so that no group is cut; a group has at most two blocks."""
    rest = None
    for pdf in frames:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if len(pdf) < rows:
            rest = pdf
            continue
        key = pdf[["bucket", "lo", "hi"]].to_numpy()
        last = np.flatnonzero((key[1:] != key[:-1]).any(axis=1))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield pdf.iloc[:cut]
        rest = pdf.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def _candidates(pdf: pd.DataFrame, threshold: float, tolerance: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first row and last of a group), then its surviving pairs: tuples (rows of the group, i, j) with indices into pdf."""
    key = pdf[["bucket", "lo", "hi"]].to_numpy()
    sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint32).reshape(len(pdf), -1)
    sides, band = pdf["side"].to_numpy(), pdf["band"].to_numpy()
    cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]
    for a, b in zip(cuts, cuts[1:]):
        if b - a > 1:
            i, j = _pairs(sides[a:b])
            for at in range(0, len(i), 100_000):
                x, y = i[at : at + 100_000] + a, j[at : at + 100_000] + a
                keep = survivors(sig, x, y, band[x], threshold, tolerance)
                if len(keep):
                    yield np.array([a, b]), x[keep], y[keep]


def profiles(docs: DataFrame, id_col: str, text_col: str, key: Column) -> DataFrame:
    """doc_id, key, number of the row (fixed once this is written), digest of the shingle set (null if it is empty), MinHash values, number of shingles, for every row."""
    rows = docs.select(whole_id(id_col).alias("doc_id"), key.cast("string").alias("key"), F.monotonically_increasing_id().alias("row"), text_or_empty(text_col).alias("text"))

    def profile(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches(frames):
            sets = shingles(pdf["text"].tolist(), WIDTH)
            full = [s for s in sets if len(s)]
            sig = iter(signatures(full)) if full else iter(())
            digest = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "key": pdf["key"], "row": pdf["row"], "set_id": digest, "sig": [next(sig).tobytes() if len(s) else None for s in sets], "width": [len(s) for s in sets]})

    found = arrow_bounded(rows).mapInPandas(profile, "doc_id string, key string, row long, set_id binary, sig binary, width long")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def links(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """set_id, to_id (a neighbour in the group, for components), n (documents linked to in the group); classes: set_id, rep, size, sig, width."""
    banded = classes.select("set_id", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "sig", "width")
    key = F.xxhash64("band", F.expr(f"substring(sig, band * {4 * ROWS} + 1, {4 * ROWS})"))
    banded = banded.select("set_id", "band", key.alias("bucket"), "width")
    full = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("width").alias("shingles")).filter("n > 1")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.least("n", F.col("shingles") / BLOCK_SHINGLES))).cast("int")
    met = banded.join(full, "bucket").select("set_id", "band", "bucket", blocks.alias("blocks"))
    met = met.withColumn("block", F.pmod(F.xxhash64("set_id", F.lit(3)), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    met = met.select("set_id", "band", "bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    dealt = met.join(classes.select("set_id", "sig"), "set_id").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "set_id")

    def prune(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _groups(frames):
            wanted = np.zeros(len(pdf), dtype=bool)
            for _, x, y in _candidates(pdf, threshold, tolerance):
                wanted[x] = wanted[y] = True
            yield pdf[wanted]

    shape = "set_id binary, band int, bucket long, lo int, hi int, side int, sig binary"
    left = stash(arrow_bounded(dealt).select("set_id", "band", "bucket", "lo", "hi", "side", "sig").mapInPandas(prune, shape), "survivors")

    texts = docs.select(F.col(id_col).cast("long").alias("rep"), text_or_empty(text_col).alias("text"))
    needed = stash(classes.join(left.select("set_id").distinct(), "set_id", "left_semi").select("set_id", "rep", "size"), "needed")
    texts = Bitmap(needed, "rep").maybe(texts, F.col("rep")).select("text")

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Digests and shingle sets, each text's once: whatever ids rows share, a set is known by its digest."""
        for pdf in batches(frames):
            found = {blake2b(s.tobytes(), digest_size=16).digest(): s.tobytes() for s in shingles(pdf["text"].tolist(), WIDTH) if len(s)}
            yield pd.DataFrame({"set_id": list(found), "shingles": list(found.values())})

    known = Bitmap(needed, "set_id").maybe(texts.mapInPandas(sets, "set_id binary, shingles binary"), F.col("set_id"))
    known = known.join(needed.select("set_id", "size"), "set_id").dropDuplicates(["set_id"])
    ready = left.join(known, "set_id").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "set_id")

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _groups(frames, 512):
            own = [np.frombuffer(s, dtype=np.uint64) for s in pdf["shingles"]]
            size, ids = pdf["size"].to_numpy(), pdf["set_id"].tolist()
            count, parent = np.zeros(len(pdf), dtype=np.int64), np.arange(len(pdf))

            def root(k: int) -> int:
                while parent[k] != k:
                    parent[k] = parent[parent[k]]
                    k = parent[k]
                return k

            for x, y in _linked(pdf, own, threshold, tolerance):
                np.add.at(count, x, size[y])
                np.add.at(count, y, size[x])
                for u, v in zip(x.tolist(), y.tolist()):
                    ru, rv = root(u), root(v)
                    if ru != rv:
                        parent[max(ru, rv)] = min(ru, rv)
            has = np.flatnonzero(count)
            yield pd.DataFrame({"set_id": [ids[k] for k in has], "to_id": [ids[root(k)] for k in has], "n": count[has]})

    return ready.select("set_id", "band", "bucket", "lo", "hi", "side", "sig", "size", "shingles").mapInPandas(verify, "set_id binary, to_id binary, n long")


def _linked(pdf: pd.DataFrame, own: list[np.ndarray], threshold: float, tolerance: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that reach the threshold exactly: per class the sizes of its intersections with all surviving partners at once."""
    for (a, b), x, y in _candidates(pdf, threshold, tolerance):
        lengths = np.array([len(s) for s in own[a:b]])
        starts = np.cumsum(lengths) - lengths
        _, code = np.unique(np.concatenate(own[a:b]), return_inverse=True)
        flag = np.zeros(int(code.max()) + 1, dtype=bool)
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        cuts = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), len(x)]
        for p, q in zip(cuts, cuts[1:]):
            u, partners = int(x[p]) - a, y[p:q] - a
            mine = code[starts[u] : starts[u] + lengths[u]]
            flag[mine] = True
            if len(partners) * 3 > b - a:
                both = np.add.reduceat(flag[code], starts)[partners]
            else:
                both = np.array([int(flag[code[starts[v] : starts[v] + lengths[v]]].sum()) for v in partners])
            flag[mine] = False
            union = lengths[u] + lengths[partners] - both
            near = both >= threshold * union - 1e-9
            if near.any():
                yield x[p:q][near], y[p:q][near]


def components(edges: DataFrame, u: str = "set_id", v: str = "to_id") -> DataFrame:
    """node, root for every node of the edges: alternating large and small stars until nothing changes. Roots are least nodes."""
    e = stash(edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).filter("a != b").distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stash(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "least")
        large = join_uneven(both.filter("b > a"), least, "a", "n", F.col("b")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = stash(large, "large")
        least = stash(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        small = join_uneven(large, least, "a", "n", F.col("b")).select("a", "b", "m")
        e = stash(small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("p")).select("p.a", "p.b").filter("a != b").distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """For every row: doc_id, class_id, copy_id, n_links.

    copy_id: smallest id of the rows with the same shingle set; class_id: smallest id of the connected component that
    links of similarity at least `threshold` make; n_links: rows that this row links to, copies included. Texts of one
    to four words have one shingle, of all their words. Null, empty and wordless texts link to nothing: class_id and
    copy_id are their own id. Null ids take part like others. An empty table gives an empty result. Other columns are dropped.
    """
    return _grouped(docs, id_col, text_col, threshold, tolerance, F.lit(None)).select("doc_id", "class_id", "copy_id", "n_links")


def _grouped(docs: DataFrame, id_col: str, text_col: str, threshold: float, tolerance: float, key: Column) -> DataFrame:
    """The rows of near_duplicates with key, row and, unless a row links to nothing, `best`: its component's smallest id (nulls last), key, row."""
    rows = stash(profiles(docs, id_col, text_col, key), "profiles")
    classes = rows.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.max("sig").alias("sig"), F.max("width").alias("width"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "row")).alias("best"))
    classes = stash(classes, "classes")
    found = stash(links(docs, classes, id_col, text_col, threshold, tolerance), "links")
    root = components(found)
    counted = found.groupBy("set_id").agg(F.sum("n").alias("n"))
    member = classes.select("set_id", "rep", "size", "best").join(counted, "set_id", "left").join(root.withColumnRenamed("node", "set_id"), "set_id", "left")
    member = stash(member.filter("size > 1 or n is not null or root is not null").select("set_id", "rep", "size", "best", "n", F.coalesce("root", "set_id").alias("root")), "members")
    of = member.groupBy("root").agg(F.min("rep").alias("class_id"), F.min("best").alias("root_best"), F.count(F.lit(1)).alias("root_classes"))
    of = stash(of, "roots")
    member = join_uneven(member, of, "root", "root_classes", F.col("set_id"))
    member = member.select("set_id", F.col("root_best").alias("best"), F.col("rep").alias("copy_id"), "class_id", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "size")
    out = join_uneven(rows.select("doc_id", "key", "row", "set_id"), stash(member, "members"), "set_id", "size", F.col("row"), "left")
    own = F.col("n_links").isNull()
    return out.select("doc_id", "key", "row", "best", F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(own, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each connected group of near copies one row of the smallest id stays, all columns as they were.

    Rows are told apart by id and text, so a row that links to nothing stays whatever shares its id. Null ids come after
    all others. Of rows that share the smallest id the one of the least text digest stays, of repeated rows the least as
    JSON. Null, empty and wordless texts link to nothing and all stay; exact dedup, which comes before, leaves few.
    """
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), F.sha2(text_or_empty().cast("binary"), 256))
    found = _grouped(docs, "doc_id", "text", THRESHOLD, TOLERANCE, key).filter(F.col("row") != F.col("best.row"))
    return without_copies(docs, found.select(F.col("key").alias("gone"), (F.col("key") == F.col("best.key")).alias("again")), key)

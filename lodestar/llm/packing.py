"""Best-fit packing of documents into bins of fixed capacity, under conflicts.

No bin holds two pieces of one source or of one duplicate cluster. A document longer than a bin is cut: full pieces
fill bins of their own, the rest is packed. Pieces are dealt by a hash of the id into shards of bounded size (bins never
span shards), so that a source with a third of all rows is spread over all shards; within a shard pieces go in by
falling size. Open bins stand in levels by residual; each carries bitmaps of its sources and clusters. The successor
search begins at the tightest residual that fits and goes on until it finds a compatible bin: per source the number of
bins without it on each level leads from level to level, the bitmaps decide within one. Otherwise a bin is opened.
Every piece is packed; there is no limit on bins.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import stash, text_or_empty, whole_id

CAPACITY = 2048
#: Rows of a shard, about; more shards for more rows, never much larger ones.
SHARD = 4096
#: Rows equal in id, words and text that one shard takes, about; more of them are spread by their place in the input.
REPEATS = 256


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY) -> list[int]:
    """Bin of each item, items in the order given. Sources and clusters of None conflict with nothing."""
    often = Counter(s for s in sources if s is not None)
    bit = {s: k for k, s in enumerate(sorted((s for s, n in often.items() if n > 1), key=str))}
    twice = Counter(c for c in clusters if c is not None)
    cbit = {c: k for k, c in enumerate(sorted((c for c, n in twice.items() if n > 1), key=str))}
    kinds = len(bit) + 1  # the last stands for sources that conflict with nothing
    free = np.zeros((kinds, capacity + 1), dtype=np.int32)  # bins on a level without the source
    levels: list[dict[int, tuple[int, int]]] = [{} for _ in range(capacity + 1)]  # bin -> bitmaps of sources and clusters
    out, opened = [], 0
    for size, source, cluster in zip(sizes, sources, clusters):
        s, c = bit.get(source, kinds - 1), cbit.get(cluster)
        smask, cmask = (1 << s if s < kinds - 1 else 0), (1 << c if c is not None else 0)
        at, found = size, None
        while at <= capacity:
            row = free[s, at:]
            step = int((row > 0).argmax())
            if row[step] <= 0:
                break
            at += step
            found = next((b for b, (sm, cm) in levels[at].items() if not (sm & smask or cm & cmask)), None)
            if found is not None:
                break
            at += 1
        if found is None:
            found, at, masks = opened, capacity, (0, 0)
            opened += 1
        else:
            masks = levels[at].pop(found)
            free[:, at] -= 1
            held = masks[0]
            while held:
                low = held & -held
                free[low.bit_length() - 1, at] += 1
                held ^= low
        masks = (masks[0] | smask, masks[1] | cmask)
        rest = at - size
        levels[rest][found] = masks
        free[:, rest] += 1
        held = masks[0]
        while held:
            low = held & -held
            free[low.bit_length() - 1, rest] -= 1
            held ^= low
        out.append(found)
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """One row for each piece: doc_id, piece (from 0), n_pieces, start, size (in words), source, bin, position in the bin.

    Size is the number of words (runs of characters other than ASCII blanks). Duplicate clusters are texts equal after
    blanks are deleted. Null, empty and wordless texts have one piece of size 0, in a bin as any other. A null source
    conflicts with nothing. Equal sizes go in by id; repeated rows are pieces like others (their cluster keeps them in
    bins of their own). bin is `shard-number`, fill the share of the bin that is used. The number of shards follows the
    number of rows. Null ids stay null. An empty table gives an empty result. Other columns are dropped.
    """
    text = text_or_empty(text_col)
    words = F.regexp_count(text, F.lit("[^\\x09-\\x0D\\x20]+")).cast("int")
    cluster = F.when(text != "", F.xxhash64(F.translate(text, " \t\n\x0b\x0c\r", "")))
    same = F.xxhash64(F.col(id_col).cast("long"), words, cluster, F.lit(13)).alias("same")
    rows = docs.select(whole_id(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.alias("words"), cluster.alias("cluster"), same, F.monotonically_increasing_id().alias("row"))
    rows = stash(rows, "sizes")  # small rows; places in the input hold from here on
    total = rows.count()
    shards = max(1, -(-total // shard))
    often = stash(rows.groupBy("same").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > REPEATS).select("same", F.lit(True).alias("often")), "repeats")  # at most total / REPEATS rows
    if shards > 1 and not often.isEmpty():
        rows = rows.join(often, "same", "left")
        turn = F.when(F.col("often"), F.xxhash64(F.expr(f"row div {REPEATS}"))).otherwise(F.lit(0))
    else:
        turn = F.lit(0)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("same", turn), F.lit(shards)).cast("int")).select("doc_id", "source", "words", "cluster", "shard")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=["doc_id", "piece", "n_pieces", "start", "size", "source", "bin", "position", "fill"])
        number = np.array([-1 if x is None else int(x) for x in pdf["doc_id"]], dtype=np.int64)
        pdf = pdf.assign(number=number).sort_values(["number", "cluster"], kind="stable", na_position="first")
        full, rest = pdf["words"] // capacity, pdf["words"] % capacity
        whole = (full > 0) & (rest == 0)  # ends with a full piece
        full = full - whole
        tail = rest.where(~whole, capacity).astype(int)
        parts = []
        for r, n, t in zip(pdf.itertuples(index=False), full, tail):
            parts += [(r.doc_id, r.number, k, n + 1, k * capacity, capacity, r.source, r.cluster) for k in range(n)]
            parts.append((r.doc_id, r.number, n, n + 1, n * capacity, t, r.source, r.cluster))
        out = pd.DataFrame(parts, columns=["doc_id", "number", "piece", "n_pieces", "start", "size", "source", "cluster"])
        out = out.sort_values(["size", "number", "piece"], ascending=[False, True, True], kind="stable")
        none = lambda v: [None if x is None or x != x else x for x in v]
        bins = best_fit(out["size"].tolist(), none(out["source"]), none(out["cluster"]), capacity)
        out["bin"] = [f"{pdf['shard'].iloc[0]}-{b}" for b in bins]
        out["position"] = out.groupby("bin").cumcount()
        out["fill"] = out.groupby("bin")["size"].transform("sum") / capacity
        return out.drop(columns=["cluster", "number"])

    shape = "doc_id string, piece int, n_pieces int, start long, size int, source string, bin string, position int, fill double"
    return rows.groupBy("shard").applyInPandas(place, shape).withColumn("doc_id", F.col("doc_id").cast("long"))

"""Periodic runs of words: every maximal repetition of a text, by the runs theorem.

The words of a text are numbered; any order of the numbers will do as an alphabet. Each run (a stretch of smallest period
p, at least 2 p long, that no neighbouring word extends) has a Lyndon root of length p that is the longest Lyndon word at
its start, under the order or under the reversed one. The longest Lyndon word at i ends before the next smaller value of
the inverse suffix array, so two suffix arrays give all candidate roots (i, p), fewer than two a word. A root is extended
to the right by the longest common prefix of the suffixes at i and i + p and to the left by that of the reversed text: both
are minima of an LCP array between two ranks, looked up in a sparse table. Roots that give stretches of 2 p or more are the runs.

Texts are handled in batches of bounded size, a longer text alone: they stand side by side in one array, and ranks of
different texts never meet. All steps are O(n log n) in numpy, but for one pass over each inverse suffix array.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_bounded, release, text_or_empty

#: Least length of a run that is told, in words.
LEAST = 12
#: Bytes of text of a batch, about; a longer text is a batch.
BYTES = 400_000
#: Words that common prefixes are compared by, all at once, before the longest ones are compared one by one.
STEPS = 64
#: Blanks between words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = "[\\x20\\x09-\\x0D]"


def _ranks(codes: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, its inverse) of texts side by side; codes from 1, a text's end is less than any word.

    Later texts rank first, so that beyond a text's end everything is smaller. Prefix doubling: as many words as 63 bits
    hold are sorted at once, then only suffixes that are still tied.
    """
    n = len(codes)
    width = max(1, int(codes.max()).bit_length())
    taken = max(1, (62 - int(doc[-1]).bit_length()) // width)
    key = (int(doc[-1]) - doc).astype(np.int64)
    padded = np.concatenate((codes.astype(np.int64), np.zeros(taken, dtype=np.int64)))
    at = np.arange(n)
    for k in range(taken):
        key = (key << width) | np.where(at + k < end, padded[k : k + n], 0)
    order = np.argsort(key)
    held = key[order]
    rank = np.empty(n, dtype=np.int64)
    first = np.concatenate(([True], held[1:] != held[:-1]))
    rank[order] = np.maximum.accumulate(np.where(first, at, 0))
    tied = ~(first & np.concatenate((first[1:], [True])))
    slots, h = np.flatnonzero(tied), taken
    while len(slots):
        who = order[slots]
        key = rank[who] * (n + 1) + np.where(who + h < end[who], rank[np.minimum(who + h, n - 1)] + 1, 0)
        by = np.argsort(key)
        who, key = who[by], key[by]
        order[slots] = who
        first = np.concatenate(([True], key[1:] != key[:-1]))
        rank[who] = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        slots = slots[~(first & np.concatenate((first[1:], [True])))]
        h *= 2
    return order, rank


def _common(codes: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at a and b (of one text each pair, a != b) have in common."""
    out = np.zeros(len(a), dtype=np.int64)
    most = np.minimum(end[a] - a, end[b] - b)
    live = np.arange(len(a))
    for k in range(STEPS):
        live = live[most[live] > k]
        live = live[codes[a[live] + k] == codes[b[live] + k]]
        if not len(live):
            return out
        out[live] = k + 1
    for j in live.tolist():
        x, y, k, m, step = int(a[j]), int(b[j]), STEPS, int(most[j]), 2 * STEPS
        while k < m:
            differ = codes[x + k : x + min(k + step, m)] != codes[y + k : y + min(k + step, m)]
            if differ.any():
                k += int(differ.argmax())
                break
            k, step = min(k + step, m), 2 * step
        out[j] = k
    return out


def _lcp(codes: np.ndarray, doc: np.ndarray, end: np.ndarray, order: np.ndarray) -> np.ndarray:
    """LCP of each suffix with the one before it in the suffix array; 0 where that is of another text.

    Only suffixes whose preceding word differs from that of their neighbour are compared (their sum is O(n log n)); any
    other one's prefix is one word shorter than that of the suffix before it in the text.
    """
    n = len(codes)
    before = np.full(n, -1)
    before[order[1:]] = np.where(doc[order[1:]] == doc[order[:-1]], order[:-1], -1)
    at = np.arange(n)
    paired = before >= 0
    inner = paired & (before > 0) & (at > 0)
    inner[inner] = (doc[at[inner] - 1] == doc[at[inner]]) & (doc[before[inner] - 1] == doc[at[inner]]) & (codes[at[inner] - 1] == codes[before[inner] - 1])
    own = np.flatnonzero(paired & ~inner)
    reach = np.zeros(n, dtype=np.int64)
    reach[own] = _common(codes, end, own, before[own]) + own
    last = np.maximum.accumulate(np.where(inner, 0, at))
    return np.where(paired, np.maximum(reach[last] - at, 0), 0)[order]


def _minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo : hi + 1]) for each pair: a sparse table, of which one level at a time is kept."""
    out = np.empty(len(lo), dtype=np.int64)
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    order = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[order], np.arange(int(level.max()) + 2)) if len(lo) else [0]
    row = values
    for k in range(len(cuts) - 1):
        if k:
            half = 1 << (k - 1)
            row = np.minimum(row[:-half], row[half:])
        mine = order[cuts[k] : cuts[k + 1]]
        out[mine] = np.minimum(row[lo[mine]], row[hi[mine] + 1 - (1 << k)])
    return out


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value, else the length."""
    value = rank.tolist()
    n = len(value)
    value.append(-1)
    out = [n] * n
    for i in range(n - 1, -1, -1):
        v, j = value[i], i + 1
        while value[j] > v:
            j = out[j]
        out[i] = j
    return np.array(out, dtype=np.int64)


def find_runs(codes: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in it, length, period) of every run of at least `least` words, by text, start, period. codes: whole numbers from 1."""
    lengths = np.asarray(lengths, dtype=np.int64)
    n = len(codes)
    if not n:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    end, begin = ends[doc], (ends - lengths)[doc]
    order, rank = _ranks(codes, doc, end)
    _, turned = _ranks(codes.max() + 1 - codes, doc, end)
    at = np.arange(n)
    i, j = np.concatenate((at, at)), np.concatenate([_next_smaller(r) for r in (rank, turned)])
    p = j - i  # of the root [i, j); a root that goes on on neither side is no run
    right = j < end[i]
    right[right] = codes[i[right]] == codes[j[right]]
    left = i > begin[i]
    left[left] = codes[i[left] - 1] == codes[j[left] - 1]
    some = (right | left) & (p * 2 <= lengths[doc[i]])
    i, p, j, right, left = (x[some] for x in (i, p, j, right, left))

    ahead, behind = np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=np.int64)
    if right.any():
        x, y = rank[i[right]], rank[j[right]]
        ahead[right] = _minima(_lcp(codes, doc, end, order), np.minimum(x, y) + 1, np.maximum(x, y))
    if left.any():
        codes2, doc2 = codes[::-1], doc[-1] - doc[::-1]
        end2 = np.cumsum(lengths[doc[0] : doc[-1] + 1][::-1])[doc2] if len(lengths) else end
        order2, rank2 = _ranks(codes2, doc2, end2)
        x, y = rank2[n - i[left]], rank2[n - j[left]]
        behind[left] = _minima(_lcp(codes2, doc2, end2, order2), np.minimum(x, y) + 1, np.maximum(x, y))
    start, length = i - behind, behind + p + ahead
    full = length >= np.maximum(least, 2 * p)
    _, one = np.unique(start[full] * (n + 1) + p[full], return_index=True)
    start, length, p = start[full][one], length[full][one], p[full][one]
    return doc[start], start - begin[start], length, p


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of about BYTES of text, or one row."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)) // BYTES
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    release()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """For every row: doc_id, n_words, runs (array of start, length, period: in words from 0, by start, then period), collapsed.

    Words are stretches without blanks, compared byte by byte. collapsed is the text without words that a run holds after
    its first period, joined by one space. Null, empty and blank texts have no words, no runs and an empty collapsed text.
    Repeated rows, ids and null ids each give a row of their own. An empty table gives an empty result; other columns are
    dropped. A text is one task's work whatever its length: memory follows the longest text, not the table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            words = [t.encode("utf-8", "surrogatepass").split() for t in batch.column("text").to_pylist()]  # bytes: split at these six blanks and no others
            lengths = np.array([len(w) for w in words], dtype=np.int64)
            number: defaultdict[bytes, int] = defaultdict()
            number.default_factory = lambda: len(number) + 1
            codes = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=int(lengths.sum()))
            of, start, length, period = find_runs(codes, lengths, least)
            first = np.cumsum(lengths) - lengths
            edge = np.zeros(len(codes) + 1, dtype=np.int64)
            np.add.at(edge, first[of] + start + period, 1)
            np.add.at(edge, first[of] + start + length, -1)
            kept = np.cumsum(edge[:-1]) == 0
            whole = np.ones(len(words), dtype=bool)
            whole[of] = False
            collapsed = [b" ".join(ws) if w else b" ".join([ws[k] for k in np.flatnonzero(kept[f : f + len(ws)]).tolist()]) for ws, w, f in zip(words, whole, first)]
            offsets = pa.array(np.searchsorted(of, np.arange(len(words) + 1)), type=pa.int32())
            runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x, type=pa.int64()) for x in (start, length, period)], fields=list(run)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths), runs, pa.array(collapsed, type=pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return arrow_bounded(rows).mapInArrow(find, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, where every tenth id's text (by CRC) repeats a stretch of its own words to the end.

    h is the CRC-32 of the decimal id, g = h div 10; where h % 10 = 0, word i from a = g % n on becomes the word
    a + (i - a) % p, p = 1 + (n - a) div (3 + g % 8). A null id's text stays as it is.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    words = F.filter(F.split("text", BLANKS + "+"), lambda w: w != "")
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.expr("nullif(cast(size(words) as bigint), 0)"))
    rows = rows.withColumn("a", F.expr("(h div 10) % n")).withColumn("p", F.expr("1 + (n - a) div (3 + (h div 10) % 8)"))
    repeated = F.expr("array_join(transform(sequence(0L, n - 1), i -> words[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return rows.select("doc_id", F.when(F.col("h") % 10 == 0, F.coalesce(repeated, "text")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The rows of periodic_runs as doc_id, n_runs, the longest run (ties: least start, then period), exponent_milli, digests of runs and collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return rows.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"), sha("lines").alias("runs_sha256"), sha("collapsed").alias("collapsed_sha256"),
    )

"""Collocations by suffix sorting: phrase counts from truncated suffixes, then scores of phrases against their parts.

Each word occurrence gives the suffix of its piece of text that starts there, cut after `longest` words. Tasks add up equal
suffixes before anything is shuffled. Suffixes meet by language and first word, sorted in reverse order, so that a
prefix's suffixes stand together and one stack counts all prefixes in a pass. First words of very many suffixes
are dealt to several tasks by the whole suffix; the prefixes counted there are partial and are added up afterwards.
Phrases are then joined with their parts.

A suffix is a key: its language and words, joined by a zero byte, which sorts before all others (zeros and ones within
words are written as pairs that begin with a one), so that sorted keys keep the order of their words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_bounded, release, stash, text_or_empty

SEP = "\x00"
#: Marks and line breaks that part a text into pieces; words within are parted by spaces and tabs.
PIECES = ".,;:!?\n\x0b\x0c\r"
#: Fewest occurrences of a phrase, most words, share of a phrase's occurrences (in hundredths) that a longer phrase takes over, rows a language.
LEAST, LONGEST, TAKEN, TOP = 10, 3, 50, 2000
#: Suffixes and words that a task holds before it adds them up and passes them on; bytes of text that are split at once.
PENDING, VOCABULARY, SLICE = 3_000_000, 1 << 20, 1 << 20
_FOLD = bytes.maketrans((ascii_uppercase + PIECES).encode(), (ascii_lowercase + "\n" * len(PIECES)).encode())


def _escaped(b: bytes) -> bytes:
    return b.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01") if b"\x00" in b or b"\x01" in b else b


def plain(key: Column) -> Column:
    """A key's words joined by spaces, as they were."""
    return F.replace(F.replace(F.replace(key, F.lit(SEP), F.lit(" ")), F.lit("\x01\x01"), F.lit("\x00")), F.lit("\x01\x02"), F.lit("\x01"))


def added_up(columns: Iterable[np.ndarray], longest: int, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of `longest` columns of numbers below `words`, and how often each is there. Columns are taken one after the other, so that not all need be there at once."""
    width = max(1, int(words).bit_length())
    if width * longest <= 63:
        key = None
        for c in columns:
            if key is None:
                key = c.astype(np.int64)
            else:
                key <<= width
                key |= c
        key.sort()
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1])))
        n = np.diff(np.append(first, len(key)))
        key = key[first]
        return [(key >> (width * k)) & ((1 << width) - 1) for k in range(longest - 1, -1, -1)], n
    columns = list(columns)
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0)))
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.diff(np.append(at, len(new)))


class _Tally:
    """Suffixes of one language, as numbers of words (0: the end of a piece)."""

    def __init__(self, lang: bytes, longest: int):
        self.lang, self.longest, self.number, self.held, self.size = lang, longest, _numbering(), [], 0

    def add(self, text: bytes) -> Iterator[pa.RecordBatch]:
        """Take all suffixes of a text; what is held is passed on when it is large."""
        carry: list[bytes] = []
        at = 0
        while at < len(text):
            cut = len(text) if at + SLICE >= len(text) else max(text.rfind(b" ", at, at + SLICE), text.rfind(b"\n", at, at + SLICE)) + 1
            if cut <= at:  # a word longer than a slice
                ends = [k for k in (text.find(b" ", at + SLICE), text.find(b"\n", at + SLICE)) if k >= 0]
                cut = min(ends) + 1 if ends else len(text)
            tokens = carry + text[at:cut].replace(b"\n", b" \x00 ").split()
            codes = np.fromiter(map(self.number.__getitem__, tokens), dtype=np.int64, count=len(tokens))
            at = cut
            carry = tokens[max(0, len(tokens) - self.longest + 1) :] if at < len(text) else []
            whole = len(codes) - len(carry)
            padded = np.concatenate((codes, np.zeros(self.longest, dtype=np.int64)))
            columns = [padded[k : k + whole] for k in range(self.longest)]
            for k in range(1, self.longest):  # nothing follows a piece's end
                columns[k] = np.where(columns[k - 1] == 0, 0, columns[k])
            starts = columns[0] > 0
            self.held.append(np.stack([c[starts] for c in columns]).astype(np.int32))
            self.size += int(starts.sum())
            if self.size > PENDING or len(self.number) > VOCABULARY:
                yield from self.passed_on()

    def passed_on(self) -> Iterator[pa.RecordBatch]:
        held = self.held or [np.zeros((self.longest, 0), dtype=np.int32)]
        words = np.array(list(self.number), dtype=object)
        order = np.argsort(words, kind="stable")  # the mark stays first; keys in order shrink well where they are stored
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        words = words[order]
        columns, n = added_up((place[np.concatenate([h[k] for h in held])] for k in range(self.longest)), self.longest, len(words))
        del held
        tails = np.array([b"", *(b"\x00" + w for w in words[1:])], dtype=object)
        self.number, self.held, self.size = _numbering(), [], 0
        columns = [c.astype(np.int32) for c in columns]
        for a in range(0, len(n), 50_000):
            keys = self.lang + tails[columns[0][a : a + 50_000]]
            for c in columns[1:]:
                keys = keys + tails[c[a : a + 50_000]]
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.binary()).cast(pa.string()), pa.array(n[a : a + 50_000], type=pa.int64())], names=["key", "n"])


class _numbering(dict):
    """Numbers of words in the order in which they are seen, from 1; 0 is the mark between pieces."""

    def __init__(self):
        super().__init__({b"\x00": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def suffixes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST) -> DataFrame:
    """key (language, then 1 to `longest` words), n: occurrences; a key has at most a row for each portion of a task."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, _Tally] = {}
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, some in texts.items():
                if lang not in tallies:
                    tallies[lang] = _Tally(_escaped(lang.encode("utf-8", "surrogatepass")), longest)
                yield from tallies[lang].add(_escaped("\n".join(some).encode("utf-8", "surrogatepass")).translate(_FOLD))
            if sum(t.size for t in tallies.values()) > PENDING or sum(len(t.number) for t in tallies.values()) > VOCABULARY or len(tallies) > 1000:
                for t in tallies.values():
                    yield from t.passed_on()
                tallies = {}
        for t in tallies.values():
            yield from t.passed_on()
        release()

    return arrow_bounded(rows).mapInArrow(find, "key string, n long")


def counts(found: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """key, size (words), f: every prefix that `found`, rows of suffixes(), has at least `least` times."""
    spark = found.sparkSession
    found = found.withColumn("first", F.substring_index("key", SEP, 2))
    heads = stash(found.groupBy("first").agg(F.count(F.lit(1)).alias("rows")), "heads")
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(1, (heads.agg(F.sum("rows")).first()[0] or 0) // (2 * deal))
    hot = heads.filter(F.col("rows") > most).select("first", F.ceil(F.col("rows") / most).cast("int").alias("salts"))  # at most 2 * deal rows, for their sum is known
    rows = found.join(F.broadcast(hot), "first", "left")
    rows = rows.select("key", "n", F.coalesce("salts", F.lit(0)).alias("salts"))  # no more than these is shuffled
    rows = rows.repartition(F.substring_index("key", SEP, 2), F.when(F.col("salts") > 0, F.pmod(F.xxhash64("key"), F.col("salts")))).sortWithinPartitions(F.col("key").desc())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = _Stack(least, longest)
        for batch in batches:
            yield from stack.take(batch.column("key").cast(pa.binary()), batch.column("n").to_numpy(), batch.column("salts").to_numpy() > 0)
        yield from stack.take(pa.array([b""], pa.binary()), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=bool))

    counted = stash(rows.mapInArrow(count, "key string, size int, f long, partial boolean"), "prefixes")
    whole = counted.filter(~F.col("partial")).select("key", "size", "f")
    parts = counted.filter("partial").groupBy("key", "size").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return whole.unionByName(parts)


class _Stack:
    """The open prefixes of sorted keys, one of each length, with the occurrences seen; a prefix that the next key doesn't have is counted to the end.

    A portion of keys is handled at once: where a prefix of k words differs from that of the key before, another one begins.
    """

    def __init__(self, least: int, longest: int):
        self.least, self.longest = least, longest
        self.key, self.part, self.open = b"", False, [0] * (longest + 1)

    def take(self, keys: pa.Array, n: np.ndarray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Prefixes that end before the last of these keys: those of `least` occurrences, and all shorter than `longest` of partial ones."""
        keys = pa.concat_arrays([pa.array([self.key], pa.binary()), keys])
        n, part = np.concatenate(([0], n)), np.concatenate(([self.part], part))
        offset = np.frombuffer(keys.buffers()[1], dtype=np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
        raw = np.concatenate((np.frombuffer(keys.buffers()[2] or b"", dtype=np.uint8), np.zeros(16, dtype=np.uint8)))
        size = np.diff(offset)
        marks = np.flatnonzero(raw[: offset[-1]] == 0)
        first = np.searchsorted(marks, offset[:-1])
        words = np.searchsorted(marks, offset[1:]) - first
        same = _same(raw, offset, size)
        for k in range(1, self.longest + 1):
            has = words >= k  # the prefix ends at the next mark, else at the key's end
            end = np.where(words > k, marks[np.minimum(first + k, max(0, len(marks) - 1))] - offset[:-1] if len(marks) else 0, size)
            goes_on = has[1:] & has[:-1] & (end[1:] == end[:-1]) & (same >= end[1:])
            begins = np.concatenate(([0], np.flatnonzero(~goes_on) + 1))
            total = np.add.reduceat(n, begins)
            total[0] += self.open[k]
            self.open[k] = int(total[-1]) if has[-1] else 0
            begins, total = begins[:-1], total[:-1]
            wanted = has[begins] & ((total >= self.least) | (part[begins] & (k < self.longest)))
            begins, total = begins[wanted], total[wanted]
            if len(begins):
                texts = [raw[a:b].tobytes() for a, b in zip(offset[begins].tolist(), (offset[begins] + end[begins]).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(np.full(len(total), k, dtype=np.int32)), pa.array(total), pa.array(part[begins] & (k < self.longest))], names=["key", "size", "f", "partial"]
                )
        self.key, self.part = keys[-1].as_py(), bool(part[-1])


def _same(raw: np.ndarray, offset: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes that each key (but the first) shares with the one before it, from their beginnings; raw ends in eight bytes more at least."""
    eight = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
    most = np.minimum(size[1:], size[:-1])
    out, live, k = most.copy(), np.flatnonzero(most > 0), 0
    while len(live):
        differ = eight[offset[live] + k] ^ eight[offset[live + 1] + k]
        apart = differ != 0
        at = live[apart]
        low = differ[apart] & (~differ[apart] + np.uint64(1))  # the lowest bit that differs
        out[at] = np.minimum(most[at], k + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3))
        k += 8
        live = live[~apart]
        live = live[most[live] > k]
    return out


def scored(f: DataFrame, taken: int = TAKEN) -> DataFrame:
    """key, a, l, r, score for every candidate of f (key, size, f) that no longer candidate takes over.

    A cut after the first k words gives l and r, the counts of its parts, and the score floor(10 ** 6 * a * a / (l * r));
    the lowest-scoring cut counts, of equal ones the first. Numbers are exact up to 38 digits; beyond, Spark raises an error.
    """
    candidates = f.filter("size > 1")
    cuts = candidates.select("key", "size", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    tail = F.concat(F.substring_index("key", SEP, 1), F.lit(SEP), F.expr(r"substring_index(key, '\0', k - size)"))
    cuts = cuts.withColumn("head", F.expr(r"substring_index(key, '\0', k + 1)")).withColumn("tail", tail)
    cuts = cuts.join(f.select(F.col("key").alias("head"), F.col("f").alias("l")), "head").join(f.select(F.col("key").alias("tail"), F.col("f").alias("r")), "tail")
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    score = F.call_function("div", whole("a") * whole("a") * F.lit(1_000_000).cast("decimal(7,0)"), whole("l") * whole("r"))
    best = cuts.groupBy("key", "a").agg(F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("cut"))
    inner = candidates.filter("size > 2").select("key", "size", "f", F.explode(F.expr("flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), s -> struct(s, n))))")).alias("at"))
    words = F.expr(r"slice(split(key, '\0'), at.s + 1, at.n)")
    inner = inner.select(F.concat(F.substring_index("key", SEP, 1), F.lit(SEP), F.array_join(words, SEP)).alias("key"), F.col("f").alias("longer"))
    inner = inner.groupBy("key").agg(F.max("longer").alias("longer"))
    kept = best.join(inner, "key", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < taken * F.col("a")))
    return kept.select("key", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, taken: int = TAKEN, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to `longest` words, by score, then a, both falling, then phrase.

    A-Z are lower-cased; pieces of text end at marks and line breaks, words at spaces and tabs. A null lang is `und`,
    together with rows that say so. Null, empty and wordless texts add nothing; repeated rows count each time. An empty
    table, or one without a phrase of `least` occurrences, gives an empty result. Other columns are dropped.
    """
    found = stash(suffixes(docs, text_col, lang_col, longest), "suffixes")
    f = stash(counts(found, least, longest), "counts")
    n = found.groupBy(F.substring_index("key", SEP, 1).alias("lang")).agg(F.sum("n").alias("n"))
    rows = scored(f, taken).select(F.substring_index("key", SEP, 1).alias("lang"), plain(F.expr(r"substr(key, instr(key, '\0') + 1)")).alias("phrase"), "a", "l", "r", "score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    deal = min(512, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(deal))).orderBy(*order)  # a language's first are among its portions' first
    rows = rows.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    rows = rows.join(n, "lang")
    return rows.select(plain(F.col("lang")).alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

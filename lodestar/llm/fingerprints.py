"""Document fingerprints: one-permutation MinHash with optimal densification, packed low-order bits and bias correction.

Only DataFrame functions. A text's five-word shingles are hashed once to 64 bits. The highest bits name a bin, so that in
a sorted array of the hashes each bin's least value is the first of its stretch; a last possible value of each bin is
sorted along and stays first where a bin is empty. An empty bin i takes the value of the first full bin among
hash(i, 1), hash(i, 2), ...; after PROBES of them, of the full bin j of least hash(i, j), so that this ends. Either order is
the same for all texts, which keeps the chance of equal values at the similarity. The low BITS of each bin are packed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import stash, text_or_empty

#: Words of a shingle; bins (a power of two); low-order bits kept of each (a byte, so that eight fill a long); probes of an empty bin.
WIDTH, BINS, BITS, PROBES = 5, 256, 8, 8
_SHIFT = 64 - (BINS.bit_length() - 1)
_LAST = (1 << _SHIFT) - 1
#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def packed(df: DataFrame, *texts: str) -> DataFrame:
    """df with each named text replaced by its packed fingerprint (array of BINS / 8 longs; null if it has no words).

    One select a step: an array that a step's functions use more than once has to be there as a column.
    """
    others = [c for c in df.columns if c not in texts]

    def step(now: DataFrame, f) -> DataFrame:
        return now.select(*others, *[f(c).alias(c) for c in texts])

    def words(c: str) -> Column:
        return F.split(F.btrim(F.col(c), F.lit(BLANKS)), "[\\x20\\x09-\\x0D]+")

    def hashes(c: str) -> Column:
        w = F.col(c)
        return F.when((F.size(w) > 1) | (w[0] != ""), F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (WIDTH - 1))), lambda i: F.xxhash64(F.slice(w, i, WIDTH))))

    last = F.array(*[F.lit(_signed((b << _SHIFT) | _LAST)) for b in range(BINS)])

    def least(c: str) -> Column:
        s = F.col(c)
        firsts = F.filter(s, lambda h, i: (i == 0) | (F.shiftright(h, _SHIFT) != F.shiftright(F.get(s, i - 1), _SHIFT)))
        return F.transform(firsts, lambda h: F.when(h.bitwiseAND(F.lit(_LAST)) != _LAST, h))

    def filled(c: str) -> Column:
        full = F.filter(F.transform(F.col(c), lambda v, j: F.struct(j.alias("j"), v.alias("v"))), lambda x: x["v"].isNotNull())

        def value(v: Column, i: Column) -> Column:
            probes = [F.get(F.col(c), F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(1, PROBES + 1)]
            tail = F.array_min(F.transform(F.col(f"{c}_full"), lambda x: F.struct(F.xxhash64(i, x["j"], F.lit(0)).alias("h"), x["v"].alias("v"))))["v"]
            return F.coalesce(v, *probes, tail)

        return full, F.transform(F.col(c), value)

    def longs(c: str) -> Column:
        v = F.col(c)

        def one(w: Column) -> Column:
            out = None
            for k in range(8):
                byte = F.shiftleft(F.get(v, w * 8 + k).bitwiseAND(F.lit((1 << BITS) - 1)), BITS * k)
                out = byte if out is None else out.bitwiseOR(byte)
            return out

        return F.when(v.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), one))

    now = step(step(df, words), hashes)
    now = step(now, lambda c: F.sort_array(F.concat(F.col(c), last)))
    now = step(now, least)
    now = now.select("*", *[filled(c)[0].alias(f"{c}_full") for c in texts])
    return step(step(now, lambda c: filled(c)[1]), longs)


def hexed(c: str) -> Column:
    """A packed fingerprint as hex; that of a text without words is empty."""
    return F.coalesce(F.array_join(F.transform(F.col(c), lambda x: F.lpad(F.hex(x), 16, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two packed fingerprints, 0 to 1: bins whose bits agree by chance are taken off. Texts without words are like each other only."""

    def folded(by: int, mask: int):
        return lambda x: x.bitwiseOR(F.shiftrightunsigned(x, by)).bitwiseAND(F.lit(mask))

    differ = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    for by, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):  # a byte's bits onto its lowest
        differ = F.transform(differ, folded(by, mask))
    apart = F.aggregate(differ, F.lit(0), lambda n, x: n + F.bit_count(x))
    chance = 0.5**BITS
    like = F.greatest(F.lit(0.0), ((F.lit(BINS) - apart) / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(like)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: doc_id, fingerprint (hex), packed. Null, empty and blank texts have an empty fingerprint and a null packed one.

    Words are stretches without blanks; a text of fewer than five words is one shingle. Equal texts have equal
    fingerprints. An empty table gives an empty result; other columns are dropped. Memory follows the longest text.
    """
    rows = packed(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("packed")), "packed")
    return rows.select("doc_id", hexed("packed").alias("fingerprint"), "packed")


def _numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """Distinct rows of (key, doc_id, text) in order of doc_id (nulls first), then text digest: key, doc_id, idx, n_chars, times; and their number.

    Ranges are sorted apart; a table of a row a range, as many as partitions, gives the number that each begins with.
    """
    small = docs.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("times"), F.max("n_chars").alias("n_chars"))
    small = small.repartitionByRange(F.col("doc_id").asc_nulls_first(), "key").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "key")
    small = stash(small.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33).alias("part")
    parts = small.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), "n")
    total = parts.agg(F.sum("n")).first()[0] or 0
    small = small.withColumn("part", part).join(F.broadcast(parts.select("part", "before")), "part")
    return small.select("key", "doc_id", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("idx"), "n_chars", "times"), total


def edited_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends in the next document's first floor(n_chars / 4) code points (or all of it) in place of its own
    last ones. Documents follow each other by doc_id, nulls first, rows of one id by the SHA-256 of their texts; the first comes after
    the last, and a lone document after itself. Of repeated rows each is followed by the next one, the last of them by
    another. Null counts as empty. An empty table gives an empty result; other columns are dropped.
    """
    text = text_or_empty(text_col)
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("null")), F.sha2(text.cast("binary"), 256))
    rows = docs.select(key.alias("key"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    small, total = _numbered(rows.select("key", "doc_id", F.char_length("text").cast("long").alias("n_chars")))
    small = stash(small, "numbered")
    quarter = F.expr("cast(n_chars div 4 as int)")
    before = small.select(((F.col("idx") + 1) % max(1, total)).alias("idx"), F.col("key").alias("before"), quarter.alias("wanted"))
    order = stash(small.join(before, "idx"), "order")

    texts = rows.select("key", "text").dropDuplicates(["key"])  # repeated rows have one text
    known = texts.join(order.select("key", "before", "wanted", "times", quarter.alias("own")), "key")
    lent = known.select(F.col("before").alias("key"), F.expr("substring(text, 1, wanted)").alias("head"), F.lit(1).cast("long").alias("copies"), F.lit(False).alias("itself"))
    again = known.filter("times > 1").select("key", F.expr("substring(text, 1, own)").alias("head"), (F.col("times") - 1).alias("copies"), F.lit(True).alias("itself"))
    both = texts.join(lent.unionByName(again), "key")
    edited = F.expr("concat(substring(text, 1, char_length(text) - cast(char_length(text) div 4 as int)), head)")
    both = both.select("key", "copies", "itself", F.col("text").alias("own"), edited.alias("edited"))
    both = both.select("key", "copies", "itself", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", "edited")
    both = stash(packed(both, "own", "edited"), "packed")

    own = both.filter(~F.col("itself")).select("key", F.col("own").alias("next"))
    follower = order.select(F.col("before").alias("key"), F.col("key").alias("next_key")).join(own.withColumnRenamed("key", "next_key"), "next_key")
    out = both.join(order.select("key", "doc_id", "n_chars"), "key").join(follower.select("key", "next"), "key")
    near = F.when(F.col("itself"), F.lit(1.0)).otherwise(likeness(F.col("own"), F.col("next")))
    out = out.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    return out.select("doc_id", "n_chars", "edited_sha256", hexed("own").alias("fingerprint"), hexed("edited").alias("edited_fingerprint"), likeness(F.col("own"), F.col("edited")).alias("near_edited"), near.alias("near_next"))

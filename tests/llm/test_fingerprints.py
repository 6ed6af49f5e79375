"""Fingerprints against a plain version of one-permutation hashing, and against exact similarities."""

import hashlib
import random
import re

import xxhash

from lodestar.llm import fingerprints as fp
from lodestar.llm import queries

SCHEMA = "doc_id long, text string, key string, own string, edited string, times string, next string, idx string"


def chained(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64(v if isinstance(v, bytes) else int(v).to_bytes(8 if v > 1 << 31 or v < 0 else 4, "little", signed=True), seed=h).intdigest()
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def shingles(text):
    words = [w.encode() for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    return {chained(*words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_fingerprint(text):
    """Bins by the highest bits, negative ones first; then each empty bin's probes."""
    found = sorted(map(signed, shingles(text)))
    if not found:
        return ""
    bins = [None] * 256
    for h in reversed(found):
        bins[((h >> 56) & 255) ^ 128] = h
    full = [j for j in range(256) if bins[j] is not None]

    def value(i):
        if bins[i] is not None:
            return bins[i]
        for t in range(1, 9):
            v = bins[signed(_ints(i, t)) % 256]
            if v is not None:
                return v
        return bins[min(full, key=lambda j: signed(_ints(i, j, 0)))]

    low = [value(i) & 255 for i in range(256)]
    return "".join("%016x" % int.from_bytes(bytes(low[8 * w : 8 * w + 8]), "little") for w in range(32))


def _ints(*values):
    h = 42
    for v in values:  # Spark hashes an int as four bytes of its own kind of round
        h = _hash_int(v, h)
    return h


def _hash_int(i, seed):
    m, p1, p2, p3, p5 = (1 << 64) - 1, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5
    h = (seed + p5 + 4) & m
    h ^= (i & 0xFFFFFFFF) * p1 & m
    h = ((h << 23 | h >> 41) & m) * p2 + p3 & m
    h ^= h >> 33
    h = h * p2 & m
    h ^= h >> 29
    h = h * p3 & m
    return h ^ h >> 32


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_fingerprints_equal_the_plain_version(spark):
    rng = random.Random(11)
    texts = [None, "", " \t", "one", "one two three four", "é ü\x1cx \x0b y z w", words(rng, 5), words(rng, 30), words(rng, 300), words(rng, 6000), "same " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"].lower() for r in fp.fingerprints(docs).collect()}
    assert got == {k: plain_fingerprint(t) for k, t in enumerate(texts)}


def test_edited_documents_against_plain_ones(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, words(rng, rng.choice([0, 1, 3, 4, 50, 400]))) for k in range(60)] + [(None, "no id at all, with words"), (None, None), (7, "another text of seven"), (-1, "x" * 50_000), (20, "again and again"), (20, "again and again"), (20, "again and again"), (1 << 60, "abcdefg")]
    docs = spark.createDataFrame([(i, t, *"abcdef") for i, t in rows], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, sha(r[1])))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        want.append((i is None, i, len(t), sha(edited), plain_fingerprint(t), plain_fingerprint(edited)))
    got = queries.op11_document_fingerprints(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"].lower(), r["edited_fingerprint"].lower()) for r in got) == sorted(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert sorted(r["near_next"] for r in got if r["doc_id"] == 20 and r["n_chars"] == 15)[-2:] == [1.0, 1.0]
    one = fp.edited_documents(docs.filter("doc_id = 7").limit(1)).collect()
    assert [r["near_next"] for r in one] == [1.0]
    assert fp.edited_documents(docs.limit(0)).count() == 0


def test_likeness_estimates_similarity(spark):
    rng = random.Random(3)
    pairs, exact = [], []
    for k in range(120):
        base = words(rng, 40 + 10 * k).split()
        other = list(base)
        for _ in range(rng.randint(0, len(base) // 4)):
            other[rng.randrange(len(other))] = words(rng, 1)
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        pairs.append((k, " ".join(base), " ".join(other)))
        exact.append(len(a & b) / len(a | b))
    df = fp.packed(spark.createDataFrame(pairs, "k int, a string, b string"), "a", "b")
    got = {r["k"]: r["near"] for r in df.select("k", fp.likeness(df["a"], df["b"]).alias("near")).collect()}
    errors = [got[k] - exact[k] for k in range(len(pairs))]
    assert abs(sum(errors) / len(errors)) < 0.015 and max(map(abs, errors)) < 0.15


def test_no_python_in_the_plan(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e g")], "doc_id long, text string")
    plan = fp.edited_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan

"""Periodic runs against brute force over all stretches and periods."""

import hashlib
import random
import re
from zlib import crc32

import numpy as np
import pytest

from lodestar.llm import periods, queries

SCHEMA = "doc_id long, text string, runs string, n_words string, h string, words string, collapsed string, n string"


def brute(words, least):
    """Every (start, length, period): smallest period, maximal, at least `least` and two periods long."""
    n, found = len(words), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, 2 * p):
                length = j - i + p
                if not any(all(words[k] == words[k + q] for k in range(i, i + length - q)) for q in range(1, p)):
                    found.add((i, length, p))
            i = j + 1
    return sorted(found)


@pytest.mark.parametrize("least", [2, 12])
def test_runs_equal_brute_force_over_texts_side_by_side(least):
    rng = random.Random(least)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            kind, letters = rng.random(), rng.randint(1, 4)
            text = [rng.randint(1, letters) for _ in range(rng.choice([0, 1, 2, 5, 20, 60]))]
            if kind < 0.3:
                text = (text[: rng.randint(0, 7)] * 12)[: rng.randint(1, 60)] + text[:3]
            texts.append(text)
        if rng.random() < 0.3:
            a, b = [1], [1, 2]
            while len(b) < 60:
                a, b = b, b + a
            texts.append(b)  # Fibonacci words have the most runs
        of, start, length, period = periods.find_runs(np.array([w for t in texts for w in t], dtype=np.int64), np.array([len(t) for t in texts]), least)
        got = [sorted((int(s), int(n), int(p)) for o, s, n, p in zip(of, start, length, period) if o == k) for k in range(len(texts))]
        assert got == [brute(t, least) for t in texts]


def test_long_runs_take_few_steps():
    one = np.ones(200_000, dtype=np.int64)
    assert [x.tolist() for x in periods.find_runs(one, np.array([200_000]))] == [[0], [0], [200_000], [1]]
    half = np.tile(np.arange(1, 50_001), 3)
    assert [x.tolist() for x in periods.find_runs(half, np.array([150_000]))] == [[0], [0], [150_000], [50_000]]


def expected(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    n = len(words)
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words, 12)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(13)
    words = ["a", "b", "Ä", "c d", "e\x1cf", "é"]
    texts = [None, "", " \t\r\n", "x", "ab " * 30, "a b c\x0b" * 9] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(120)]
    texts += ["\n".join(["one and the same line of words"] * 5) + " tail"] * 2
    rows = [(k, t) for k, t in enumerate(texts)] + [(7, "twice"), (7, "twice"), (None, "u v " * 8), (None, None), (-5, "w " * 40), (1 << 60, "w " * 12)]
    docs = spark.createDataFrame([(i, t, *"abcdef") for i, t in rows], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_periodic_run_detection(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((expected(*r) for r in rows), key=key)
    assert sum(1 for r in rows if expected(*r)[1]) > 12
    assert periods.digests(periods.periodic_runs(docs.limit(0))).count() == 0


def test_runs_and_collapsed_text_themselves(spark):
    docs = spark.createDataFrame([(1, "so " + "tick tock " * 7 + "end")], "doc_id long, text string")
    row = periods.periodic_runs(docs).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 14, 2)] and row["collapsed"] == "so tick tock end" and row["n_words"] == 16

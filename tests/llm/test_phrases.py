"""Collocations against brute force over all phrases."""

import random
import re
from collections import Counter

import pytest

from lodestar.llm import phrases, queries

SCHEMA = "doc_id long, text string, lang string, key string, n string, first string, rows string, f string"


def brute(rows, least=10, longest=3, taken=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    often = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    out = []
    for p, a in often.items():
        lang, words = p[0], p[1:]
        around = [b for q, b in often.items() if q[0] == lang and len(q) > len(p) and any(q[1 + s : 1 + s + len(words)] == words for s in range(len(q) - len(words)))]
        if any(100 * b >= taken * a for b in around):
            continue
        cut = min((10**6 * a * a // (f[p[: k + 1]] * f[(lang, *words[k:])]), k, f[p[: k + 1]], f[(lang, *words[k:])]) for k in range(1, len(words)))
        out.append((lang, " ".join(words), a, cut[2], cut[3], n[lang], cut[0]))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    seen, ranked = Counter(), []
    for r in out:
        seen[r[0]] += 1
        if seen[r[0]] <= top:
            ranked.append((r[0], seen[r[0]], *r[1:]))
    return ranked


@pytest.fixture(scope="module")
def texts():
    """A hot first word, words with control characters and blanks of other kinds, empty and null texts, repeats."""
    rng = random.Random(12)
    words = ["the", "The", "new", "york", "a\x01", "a", "a\x00b", "a\x01\x01", "é\x1cq", "\x02", "it's", "x y"]
    rows = [(None, None), ("en", ""), ("en", " .,\t"), ("", "of the of the " * 9), (None, "un\tdeux " * 20)]
    for _ in range(150):
        text = " ".join(rng.choice(["the"] * 6 + words) + rng.choice(["", "", "", "", ".", "\n", "!", "\t"]) for _ in range(rng.randint(1, 60)))
        rows.append((rng.choice(["en", "en", "en", "und", "l\x00x"]), text))
    return rows + rows[-3:] * 5


def test_query_equals_brute_force(spark, texts, tmp_path):
    docs = spark.createDataFrame([(k, t, lang, *"abcde") for k, (lang, t) in enumerate(texts)], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_phrase_collocations(spark, str(tmp_path))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(texts)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50
    assert phrases.collocations(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("least", "longest", "top"), [(3, 5, 40), (2, 2, 7)])
def test_other_lengths_and_bounds(spark, texts, least, longest, top):
    docs = spark.createDataFrame(texts, "lang string, text string")
    got = phrases.collocations(docs, least=least, longest=longest, top=top)
    assert sorted(map(tuple, got.collect())) == sorted(brute(texts, least, longest, top=top))


def test_numbers_past_64_bits(spark):
    big = 10**11
    f = spark.createDataFrame([("en\0x", 1, big), ("en\0y", 1, big + 3), ("en\0x\0y", 2, big - 1)], "key string, size int, f long")
    row = phrases.scored(f).first()
    assert row["score"] == 10**6 * (big - 1) ** 2 // (big * (big + 3)) and (row["a"], row["l"], row["r"]) == (big - 1, big, big + 3)


@pytest.mark.parametrize("size", [1, 7, 64])
def test_slices_and_portions_change_nothing(monkeypatch, size):
    rng = random.Random(size)
    text = " ".join(rng.choice(["aa", "b", "longer-than-a-slice" * 5, "b\n", "c\t"]) for _ in range(400)).encode()

    def total():
        out = Counter()
        tally = phrases._Tally(b"en", 3)
        for batch in [*tally.add(text), *tally.add(text), *tally.passed_on()]:
            for key, n in zip(batch.column("key").to_pylist(), batch.column("n").to_pylist()):
                out[key] += n
        return out

    whole = total()
    monkeypatch.setattr(phrases, "SLICE", size)
    monkeypatch.setattr(phrases, "PENDING", 50)
    assert total() == whole and sum(whole.values()) == 2 * len(text.split())


def test_wide_vocabularies_are_added_up_too():
    import numpy as np

    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 5, 1000) for _ in range(3)]
    narrow, n = phrases.added_up(columns, 3, 5)
    wide, m = phrases.added_up(columns, 3, 1 << 40)
    assert [c.tolist() for c in narrow] == [c.tolist() for c in wide] and n.tolist() == m.tolist()


@pytest.mark.parametrize("portion", [1, 3, 1000])
def test_the_stack_counts_all_prefixes_of_portions(portion):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(portion)
    keys = sorted({b"\x00".join([b"en", *(rng.choice([b"a", b"aa", b"ab", b"long-word-of-many-bytes", "é".encode(), b"\x7f"]) for _ in range(rng.randint(1, 3)))]) for _ in range(150)}, reverse=True)
    n = [rng.randint(1, 5) for _ in keys]
    want = Counter()
    for key, m in zip(keys, n):
        words = key.split(b"\x00")
        for k in range(1, len(words)):
            want[b"\x00".join(words[: k + 1]).decode(), k] += m
    for part in (False, True):
        stack, got = phrases._Stack(4, 3), {}
        for a in range(0, len(keys), portion):
            for out in stack.take(pa.array(keys[a : a + portion], pa.binary()), np.array(n[a : a + portion]), np.full(len(keys[a : a + portion]), part)):
                for r in out.to_pylist():
                    assert (r["key"], r["size"]) not in got and r["partial"] == (part and r["size"] < 3)
                    got[r["key"], r["size"]] = r["f"]
        for out in stack.take(pa.array([b""], pa.binary()), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=bool)):
            got |= {(r["key"], r["size"]): r["f"] for r in out.to_pylist()}
        assert got == {k: v for k, v in want.items() if v >= 4 or part and k[1] < 3}

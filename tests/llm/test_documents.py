"""Operators on documents: the odd cases that every one of them must take, and brute force."""

import hashlib
import random
import re

import pytest

from lodestar.llm import dedup, jaccard, licenses, packing, pii, quality, spm, textnum

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, salt string, digest string, key string, rep string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "x", "x", "x") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, a very long text, ties, repeated rows, near copies, personal data."""
    rng = random.Random(4)
    base = words(rng, 120)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, base, "a"), (5, base + " ", "b"), (6, base, "b"), (6, base, "b"), (7, near, "a"), (8, words(rng, 9000), "a"), (9, "one", "c"), (None, "one two", "c"), (10, "é" * 50_000, "c"), (11, "call +1 (222) 555-0100 or a.b@c.example.org", "a")]
    rows += [(20 + k, words(rng, 40), "hot") for k in range(30)]
    return frame(spark, rows)


def test_every_operator_takes_odd_and_empty_tables(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (8, 1, 0), (9, 0, None), (None, 1, 0), (21, None, 0)], "doc_id long, quality int, toxic int")
    model = pii.Tagger(1)
    empty = odd.limit(0)
    runs = [
        lambda d: spm.encode_documents(d, chunk=500), dedup.exact_dedup, jaccard.near_duplicates, licenses.scan_licenses, lambda d: pii.find_pii(d, model=model), lambda d: quality.quality(d, labels),
    ]
    for run in runs:
        assert run(odd).count() == odd.count()
        assert run(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert quality.quality(odd, labels.limit(0)).filter("accepted").count() == odd.count()


def test_sentencepiece_equals_the_library(spark, odd):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    for r in spm.encode_documents(odd, chunk=400).join(odd.select("doc_id", "text"), "doc_id").collect():
        assert list(r["ids"]) == sp.encode(r["text"] or "") and r["round_trip"]


def test_sentencepiece_chunks_of_any_size():
    import sentencepiece

    sp, v, rng = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL), spm.load(), random.Random(8)
    for text in ["a" * 3000, "ab" * 999, " " * 77 + "x", "the" * 500, "", "\n\n \n"] + ["".join(rng.choice("abtheion  \n.,'é文😀019{}_-=") for _ in range(rng.randint(1, 200))) for _ in range(300)]:
        want = sp.encode(text)
        assert v.encode(text) == want
        for size in (7, 20, 50):
            assert v.encode(text, size) == want, (text, size)
        assert v.decode(want) == text


def test_sentencepiece_words_of_all_lengths_share_their_passes(monkeypatch):
    import sentencepiece

    sp, v, rng = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL), spm.Pieces.from_file(spm.MODEL), random.Random(12)
    calls, joined = [], spm.Table.joined
    monkeypatch.setattr(spm.Table, "joined", lambda *a: calls.append(1) or joined(*a))
    monkeypatch.setattr(spm, "MEMO", 100)
    texts = [" ".join("".join(rng.choice("abcdefghinorstu-.0") for _ in range(n)) for n in range(1, 40)) for _ in range(3)] + ["", "a\0b é文 \0", "x" * 50]
    for part in (texts[:1], texts, [], texts[::-1]):  # the memo is dropped in between
        assert [x.tolist() for x in v.stretches([v.marked(t) for t in part])] == [sp.encode(t) for t in part]
        assert len(calls) <= spm.Table.LONGEST_WORD  # not one pass for each pair of a word's length and a place in it
        calls.clear()


def test_products_are_associative():
    rng = random.Random(2)
    v = spm.load()
    t = v.marked("".join(rng.choice("abtheion .,") for _ in range(90)))
    a, b, c = (v.matrix(t, x, y) for x, y in ((0, 31), (31, 60), (60, len(t))))
    left, right = spm.product(spm.product(a, b), c), spm.product(a, spm.product(b, c))
    assert (left == right).all() and left.max() == 0


def plain(text):
    return re.sub(r"[\x20\x09-\x0d]", "", text or "")


def brute_dedup(rows):
    best = {}
    for r in rows:
        k = plain(r["text"])
        rank = (-len(r["text"] or ""), r["doc_id"] is not None, r["doc_id"] or 0)
        best.setdefault(k, []).append((rank, r["doc_id"]))
    return sorted((str(r["doc_id"]), str(min(best[plain(r["text"])], key=lambda x: x[0])[1]), len(best[plain(r["text"])]), hashlib.sha256(plain(r["text"]).encode()).hexdigest()) for r in rows)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_even_when_digests_collide(spark, odd, weak):
    from pyspark.sql import functions as F

    digest = (lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1)) if weak else dedup.sha256
    got = dedup.exact_dedup(odd, digest=digest).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == brute_dedup(odd.collect())


def test_exact_stage_keeps_one_of_each(odd):
    kept = dedup.keep_first(odd)
    assert kept.columns == odd.columns
    texts = [plain(r["text"]) for r in kept.distinct().collect()]
    assert sorted(texts) == sorted({plain(r["text"]) for r in odd.collect()})


def test_exact_stage_keeps_one_row_of_each_without_distinct(spark, odd):
    rows = [(6, "a b", "a"), (6, "ab", "b"), (None, "c d", "a"), (None, "cd", "a"), (None, " cd", "b"), (7, "e", "a"), (7, "e", "a"), (8, "e", "a"), (9, "f", "a"), (9, "f", "b"), (9, "g", "b")]
    for docs in (frame(spark, rows), odd):
        want = sorted({plain(r["text"]) for r in docs.collect()})
        assert sorted(plain(r["text"]) for r in dedup.keep_first(docs).collect()) == want
        weak = lambda c: dedup.F.substring(dedup.sha256(c), 1, 1)
        for digest in (dedup.sha256, weak):
            assert dedup.exact_dedup(docs, digest=digest).filter("kept").count() == len(want)
    kept = sorted((str(r["doc_id"]), r["text"], r["source"]) for r in dedup.keep_first(frame(spark, rows)).collect())
    assert kept == [("6", "a b", "a"), ("7", "e", "a"), ("9", "f", "a"), ("9", "g", "b"), ("None", " cd", "b")]


def brute_links(rows):
    sets = [set(textnum.shingles([r["text"] or ""])[0].tolist()) for r in rows]
    return sorted((str(r["doc_id"]), sum(1 for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9)) for i, (r, a) in enumerate(zip(rows, sets)))


def test_jaccard_links_equal_brute_force(spark, odd):
    rng = random.Random(5)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    for k in range(12):  # groups of near copies with one to forty changed words
        base = words(rng, 150).split()
        for j in range(12):
            w = list(base)
            for at in rng.sample(range(150), rng.choice([0, 1, 2, 3, 5, 40])):
                w[at] = "edit" + str(rng.randint(0, 99))
            rows.append((1000 + 100 * k + j, " ".join(w), "n"))
    docs = frame(spark, rows)
    got = jaccard.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in got) == brute_links(docs.collect())
    for r in got:
        if r["n_links"] == 0:
            assert r["class_id"] == r["doc_id"] == r["copy_id"]


def test_blocks_of_a_large_bucket_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(6)
    base = words(rng, 100).split()
    rows = []
    for j in range(60):
        w = list(base)
        w[rng.randrange(100)] = f"edit{j}"
        rows.append((j, " ".join(w), "n"))
    docs = frame(spark, rows)
    got = jaccard.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in got) == brute_links(docs.collect())
    assert {r["class_id"] for r in got} == {0}


def test_near_stage_decides_by_row_not_by_id(spark):
    rng = random.Random(16)
    a, b, c = words(rng, 120), words(rng, 120), words(rng, 120)
    near = lambda t, k: t.replace(t.split()[k], "changed", 1)
    rows = [(1, a, "a"), (2, near(a, 50), "a"), (2, "a text of its own that nothing else here is like", "a"), (None, near(a, 20), "a"), (None, "null has a text of its own as well", "a"), (None, b, "a"), (None, near(b, 30), "a"), (5, c, "a"), (5, near(c, 40), "a"), (5, c, "a"), (None, "", "a"), (None, "", "b")]
    kept = jaccard.one_of_each(frame(spark, rows)).collect()
    texts = [r["text"] for r in kept]
    assert len(kept) == 7 and texts.count(a) == 1 and texts.count("") == 2
    assert sum(t.startswith(("a text of its own", "null has")) for t in texts) == 2
    assert sum(t in (b, near(b, 30)) for t in texts) == 1 and [r["doc_id"] for r in kept if r["text"] in (c, near(c, 40))] == [5]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"{k:04d}".encode(), f"{k + 1:04d}".encode()) for k in range(200)], "set_id binary, to_id binary")
    assert {bytes(r["root"]) for r in jaccard.components(edges).collect()} == {b"0000"}


def test_base_spans_equal_plain_patterns():
    rng = random.Random(9)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(4000):
        t = "".join(rng.choice("a1b0@.+- (9_é\n") for _ in range(rng.randint(0, 60)))
        spans = pii.base_spans(t)
        assert [s[1:] for s in spans if s[0] == 0] == [m.span() for m in email.finditer(t)]
        assert [s[1:] for s in spans if s[0] == 1] == [m.span() for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]


def test_tagger_is_accurate_on_held_out_windows_and_adds_spans():
    model = pii.trained()
    batch, tags = pii.examples(random.Random(77), 200, pii.WINDOW)
    got, _ = model.decode(batch)
    assert (got == tags)[tags > 0].mean() > 0.9 and (got == tags).mean() > 0.97
    text = "x " * 60 + "ring (212) 555-0187 today"
    base, every = pii.all_spans([text], model)[0]
    assert base == [] and [text[a:b] for _, a, b in every] == ["(212) 555-0187"]


def test_gradients_of_the_tagger():
    import numpy as np

    model = pii.Tagger(2)
    batch, tags = pii.examples(random.Random(1), 3, 12)
    _, grads = model.loss(batch, tags)
    for name in ("E", "Wf", "Ub", "O", "T"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        kept = model.p[name][at]
        model.p[name][at] = kept + 1e-4
        up, _ = model.loss(batch, tags)
        model.p[name][at] = kept - 1e-4
        down, _ = model.loss(batch, tags)
        model.p[name][at] = kept
        assert abs((up - down) / 2e-4 - grads[name][at]) < 1e-3 * max(1, abs(grads[name][at]))


def test_schedule_against_all_subsets():
    import itertools

    rng = random.Random(3)
    for _ in range(200):
        spans = [(0, a, a + rng.randint(1, 6), rng.randint(1, 9) + k / 100) for k, a in enumerate(rng.sample(range(20), 6))]
        best = max((sum(s[3] for s in c) for n in range(7) for c in itertools.combinations(spans, n) if all(x[2] <= y[1] or y[2] <= x[1] for x, y in itertools.combinations(c, 2))), default=0)
        assert abs(sum(s[3] for s in spans if s[:3] in pii.schedule(spans)) - best) < 1e-9


def test_redaction_leaves_nothing(odd):
    out = {r["doc_id"]: r for r in pii.redacted(odd, pii.Tagger(1)).collect()}
    assert "555" not in out[11]["text"] and "@" not in out[11]["text"] and out[11]["n_chars"] == len(out[11]["text"])
    assert out[1]["text"] is None and out[8]["text"] == {r["doc_id"]: r for r in odd.collect()}[8]["text"]


def test_quality_parts_prose_from_noise(spark):
    rng = random.Random(12)
    vocabulary = [words(rng, 1) for _ in range(300)]
    good = [(k, " ".join(rng.choice(vocabulary) for _ in range(80)), "a") for k in range(300)]
    bad = [(1000 + k, " ".join(rng.choice(vocabulary).upper() + "!!" for _ in range(80)), "a") for k in range(60)]
    docs = frame(spark, good + bad)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 300, 3)] + [(1000 + k, 0, 0) for k in range(0, 60, 3)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.accepted_documents(docs, labels).collect()}
    assert not any(k >= 1000 for k in kept) and len(kept) >= 297


def test_kth_largest_is_exact(spark):
    rng = random.Random(13)
    values = [round(rng.gauss(0, 5), 3) for _ in range(3000)] + [1.5] * 500
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 900, 1500, 3499):
        assert quality.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_license_blocks_and_phrases(spark):
    t = licenses.TEMPLATES["bsd"]
    docs = frame(spark, [(1, "hello\n" + t.replace(" with or", "\nwith or") + "\nbye", "a"), (2, "Cc-By x all RIGHTS reserved", "a"), (3, "cc byx", "a"), (4, t[: len(t) // 2], "a")])
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    assert got[1]["labels"] == "bsd" and got[1]["score"] == 1.0
    assert (got[2]["base_labels"], got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[2]["n_words"]) == ("cc-by,reserved", 2, 0, 3, 6)
    assert got[3]["n_base"] == 0 and got[3]["first_word"] is None and got[4]["labels"] == ""


def test_license_is_found_however_it_is_wrapped(spark):
    assert all(len(licenses.words(t)) > 4 for t in licenses.TEMPLATES.values())
    docs = frame(spark, [(k, "before\n" + "\n\n * ".join(" ".join(w[i : i + n]) for i in range(0, len(w), n)) + "\nafter", "a") for k, (w, n) in enumerate((t.split(), n) for t in licenses.TEMPLATES.values() for n in (1, 3, 5))])
    want = {k: name for k, name in enumerate(name for name in licenses.TEMPLATES for _ in range(3))}
    for r in licenses.scan_licenses(docs).collect():
        assert f"{want[r['doc_id']]}=1.0000" in r["templates"].split(",")
    index = licenses.Index({"short": "two words"})
    assert licenses.blocks("a line before\ntwo\nwords\nand many more words after it", index) == {"short": (1.0, 3, 5)}


def test_license_blocks_equal_brute_force_over_all_runs():
    rng = random.Random(41)
    names = ["t1", "t2", "t3"]
    for _ in range(120):
        made = {n: " ".join(rng.choice("abcde") for _ in range(rng.choice([1, 3, 6, 9, 14]))) for n in names}
        index = licenses.Index(made)
        text = []
        while len(text) < 45:
            t = made[rng.choice(names)].split()
            a = rng.randrange(len(t))
            text += t[a : a + rng.randint(1, 14)] + [rng.choice("abcdexyz") for _ in range(rng.randint(0, 3))]
        ws = licenses.words(" ".join(text))
        want = {}
        for n in names:
            longest = max(len(made[n].split()), int(len(made[n].split()) / 0.8 + 1e-9))
            width = min(5, len(made[n].split()))
            best = None
            for i in range(len(ws)):
                for j in range(i + 1, min(len(ws), i + longest) + 1):
                    found = {b" ".join(ws[k : k + width]) for k in range(i, j - width + 1)}
                    share = len(found & index.sets[n])
                    if share >= index.need[n]:
                        here = (-share, j - i, i)
                        best = here if best is None else min(best, here)
            if best:
                want[n] = (-best[0] / len(index.sets[n]), best[2], best[2] + best[1])
        assert licenses.blocks(" ".join(text), index) == want


def test_license_pieces_far_apart_are_no_block(spark):
    t = licenses.TEMPLATES["gpl-notice"].split()
    far = " ".join(t[:14]) + "\n" + "some other line of words\n" * 3000 + " ".join(t[14:])
    near = "x y\n" + " ".join(t[:14]) + "\nand\n" + " ".join(t[14:])
    got = {r["doc_id"]: r for r in licenses.scan_licenses(frame(spark, [(1, far, "a"), (2, near, "a")])).collect()}
    assert got[1]["templates"] == "" and got[1]["blocks"] == "" and got[2]["blocks"] == f"gpl-notice:2-{len(licenses.words(near))}"


def test_license_runs_are_counted_at_every_place(spark):
    rng = random.Random(23)
    made = {"short": "two words", "again": "x x x x x x", "long": "a b c d e a b c"}
    texts = ["Two words, two words two-words", "x " * 9, "a b c d e a b c d e a b c", "", "two\0words é文 x", *(" ".join(rng.choice("abcdex") for _ in range(60)) for _ in range(20))]
    got = licenses.template_counts(frame(spark, [(k, t, "a") for k, t in enumerate(texts)]), made)
    want = {}
    for t in texts:
        ws = licenses.words(t)
        for x in {x for m in made.values() for x in licenses.shingle_set(licenses.words(m))}:
            want[x] = want.get(x, 0) + sum(ws[k : k + x.count(b" ") + 1] == x.split() for k in range(len(ws)))
    assert got == {x: n for x, n in want.items() if n} and got[b"two words"] == 4 and got[b"x x x x x"] == 5  # neighbours and overlaps, too


def test_license_join_equals_brute_force():
    rng = random.Random(14)
    index = licenses.Index()
    for _ in range(400):
        name = rng.choice(list(licenses.TEMPLATES))
        w = [x for x in licenses.words(licenses.TEMPLATES[name]) if rng.random() > 0.03] + [b"more"] * rng.randint(0, 4)
        found = licenses.shingle_set(w)
        want = {n: len(s & found) / len(s) for n, s in index.sets.items() if len(s & found) >= index.need[n]}
        assert index.match(found) == want


def first_compatible(sizes, sources, clusters, capacity):
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters):
        fits = [(b[0], k) for k, b in enumerate(bins) if b[0] >= size and not (s is not None and s in b[1]) and not (c is not None and c in b[2])]
        if fits:
            tight = min(r for r, _ in fits)
            out.append((tight, {k for r, k in fits if r == tight}))
            k = min(k for r, k in fits if r == tight)
        else:
            bins.append([capacity, set(), set()])
            k = len(bins) - 1
            out.append((capacity, {k}))
        bins[k][0] -= size
        bins[k][1].add(s)
        bins[k][2].add(c)
    return out, len(bins)


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(15)
    for _ in range(60):
        n, cap = 80, 50
        sizes = sorted((rng.randint(0, cap) for _ in range(n)), reverse=True)
        sources = [rng.choice([None, 0, 0, 1, 2, 3]) for _ in range(n)]
        clusters = [rng.choice([None, 5, 6, 7, 8, 9]) for _ in range(n)]
        got = packing.best_fit(sizes, sources, clusters, cap)
        rest, held = {}, {}
        for size, s, c, b in zip(sizes, sources, clusters, got):
            free = {k: r for k, r in rest.items() if r >= size and (s is None or s not in held[k][0]) and (c is None or c not in held[k][1])}
            assert (rest[b] == min(free.values()) and b in free) if free else b not in rest
            rest[b] = rest.get(b, cap) - size
            x = held.setdefault(b, (set(), set()))
            x[0].add(s)
            x[1].add(c)


def test_packing_covers_every_word_without_conflicts(odd):
    got = packing.pack(odd, capacity=64, shard=16).collect()
    assert sum(r["size"] for r in got) == sum(len((r["text"] or "").split()) for r in odd.collect())
    used, seen = {}, set()
    for r in got:
        used[r["bin"]] = used.get(r["bin"], 0) + r["size"]
        if r["source"] is not None:
            assert (r["bin"], r["source"]) not in seen
            seen.add((r["bin"], r["source"]))
    assert max(used.values()) <= 64


def test_pipeline_runs_and_writes_pieces_of_kept_documents(spark, tmp_path, odd):
    import corpus_pipeline

    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in out}
    assert 4 not in ids or 7 not in ids
    assert 8 in ids and 5 in ids | {4}


BIG = [9007199254740993, 9007199254740995, -9007199254740993]


def test_large_ids_stay_exact_beside_nulls(spark):
    rng = random.Random(30)
    rows = [(i, words(rng, 30) + " mail a.b@c.example.org", "s") for i in BIG] + [(None, words(rng, 30) + " +1 (222) 555-0100", "s")]
    docs = frame(spark, rows).coalesce(1)
    labels = spark.createDataFrame([(BIG[0], 1, 0), (BIG[1], 0, 0)], "doc_id long, quality int, toxic int")
    model = pii.Tagger(1)
    for found in (pii.find_pii(docs, model=model), pii.redacted(docs, model), quality.quality(docs, labels), licenses.scan_licenses(docs), jaccard.near_duplicates(docs), packing.pack(docs), spm.encode_documents(docs, chunk=40), dedup.exact_dedup(docs)):
        assert {r["doc_id"] for r in found.collect()} == {*BIG, None}
        assert dict(found.dtypes)["doc_id"] == "bigint"
    assert "@" not in "".join(r["text"] for r in pii.redacted(docs, model).collect())


def test_stages_keep_columns_of_any_name(spark):
    rows = [(1, "same text here", "en", "s", 14, "x", "y", "z", "w"), (2, "same text here", "en", "s", 14, "x", "y", "z", "w"), (3, "other words there", "en", "s", 17, "x", "y", "z", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _at string, _maybe string, _bit_row string, gone string")
    for stage in (dedup.keep_first, jaccard.one_of_each, lambda d: pii.redacted(d, pii.Tagger(1)), lambda d: quality.accepted_documents(d, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int"))):
        out = stage(docs)
        assert out.columns == docs.columns and all(r["_at"] == "x" and r["gone"] == "w" for r in out.collect())
    assert sorted(r["doc_id"] for r in dedup.keep_first(docs).collect()) == [1, 3]


def test_base_cards_and_phones_equal_plain_patterns():
    rng = random.Random(31)
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    seen = 0
    for _ in range(4000):
        t = "".join(rng.choice("00123456789" + rng.choice(["", " -", "+( )."]) + "x") for _ in range(rng.randint(0, 70)))
        if rng.random() < 0.5:
            d = "".join(rng.choice("0123456789") for _ in range(rng.randint(15, 18)))
            d += next(c for c in "0123456789" if pii.luhn(d + c))
            t += " x" + rng.choice(["", " ", "-"]).join(d) + "x"
        digits = lambda s: [c for c in s if c.isdigit()]
        cards = [m.span() for m in card.finditer(t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn("".join(digits(m[0])))]
        phones = [m.span() for m in phone.finditer(t) if 8 <= len(digits(m[0])) <= 15]
        spans = pii.base_spans(t)
        assert [s[1:] for s in spans if s[0] == 2] == cards and [s[1:] for s in spans if s[0] == 3] == phones
        seen += bool(cards)
    assert seen > 500


def test_posteriors_sum_over_all_paths():
    import itertools

    import numpy as np

    model = pii.Tagger(4)
    batch = np.array([pii.codes("a1@b")], dtype=np.int64)
    e, _ = model.emissions(batch)
    T, S = model._transitions()
    weight = lambda p: S[p[0]] + e[0, 0, p[0]] + sum(T[a, b] + e[t + 1, 0, b] for t, (a, b) in enumerate(itertools.pairwise(p)))
    every = {p: np.exp(weight(p)) for p in itertools.product(range(pii.TAGS), repeat=4)}
    for _, kind, a, b, sure in model.spans(batch):
        own = [1 + 2 * kind] + [2 + 2 * kind] * (b - a - 1)
        fits = sum(w for p, w in every.items() if list(p[a:b]) == own and (b == 4 or p[b] != 2 + 2 * kind))
        assert abs(sure - fits / sum(every.values())) < 1e-9


def test_windows_are_reconciled_over_the_whole_text():
    model = pii.trained()
    item = "(212) 555-0187"
    for gap in range(0, 97, 7):  # a number at every place within the windows' grid
        text = "word " * 30 + "x" * gap + " " + item + " and more words follow here"
        spans = [text[a:b] for k, a, b in pii.all_spans([text], model)[0][1] if k == 3]
        assert len(spans) <= 1
    assert sum(bool(pii.all_spans(["word " * n + item + " word"], model)[0][1]) for n in range(12)) >= 11


def test_importance_weights_and_sample_equal_brute_force(spark):
    import math

    import numpy as np

    rng = random.Random(32)
    docs = [(k, words(rng, rng.randint(3, 40)) if k % 3 else words(rng, 20).upper(), "a") for k in range(90)]
    labels = spark.createDataFrame([(k, int(k % 3 != 0)) for k in range(60)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.quality(frame(spark, docs), labels, buckets=512, k=25).collect()}
    keys = sorted((r["gumbel_key"] for r in got.values()), reverse=True)
    assert {k for k, r in got.items() if r["accepted"]} == {k for k, r in got.items() if r["gumbel_key"] >= keys[24]} and sum(r["accepted"] for r in got.values()) == 25
    # every weight is that of one pair of models and one charge for an n-gram
    raw = {k: np.bincount(quality.grams([t], 512)[0], minlength=512) for k, t, _ in docs}
    a = np.array([[*raw[k], -raw[k].sum()] for k in got], dtype=float)
    w = np.array([got[k]["log_weight"] for k in got])
    solved = np.linalg.lstsq(a, w, rcond=None)[0]
    assert np.abs(a @ solved - w).max() < 1e-3
    noise = [got[k]["gumbel_key"] - got[k]["log_weight"] for k in got]
    assert abs(np.mean(noise) - 0.5772) < 0.5 and all(math.isfinite(x) for x in noise)


def test_pipeline_equals_plain_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(33)
    a, b = words(rng, 120), words(rng, 120)
    rows = [(1, a, "s"), (2, a + " ", "s"), (3, a.replace(a.split()[50], "changed", 1), "t"), (4, b + " call +1 (222) 555-0100", "s"), (5, b + " call +1 (222) 555-0100", "u"), (6, words(rng, 90), "t"), (7, "", "t"), (8, None, "t")]
    docs = frame(spark, rows)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))  # nothing is rejected
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # of equal texts the longest stays, of near copies the least id, of empty ones one
    plainly = {1, 2, 3} & {r["doc_id"] for r in out}
    assert len(plainly) == 1 and {r["doc_id"] for r in out} - plainly in ({4, 6, 7}, {4, 6, 8})
    assert {r["doc_id"]: r["size"] for r in out}[6] == 90 and {r["doc_id"]: r["size"] for r in out}[4] == 122


def test_near_copies_without_ids_are_read_once(spark):
    """Rows without an id, and rows of one id with different texts, meet by their texts, not by their ids."""
    rng = random.Random(9)
    base = words(rng, 60).split()
    texts = [" ".join([*base[:k], f"own{j}", *base[k + 1 :]]) for j in range(60) for k in [j % 58 + 1]]
    rows = [(None, t, "a") for t in texts] + [(5, t + " tail", "a") for t in texts[:40]] + [(None, texts[0], "a")]
    from pyspark.sql import functions as F

    classes = jaccard.profiles(frame(spark, rows), "doc_id", "text", F.lit(None)).groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.max("sig").alias("sig"), F.max("width").alias("width"))
    found = jaccard.links(frame(spark, rows), jaccard.stash(classes, "classes"))
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for t in texts + [t + " tail" for t in texts[:40]]]
    size = [2] + [1] * (len(sets) - 1)
    near = [sum(size[j] for j, b in enumerate(sets) if j != i and len(a & b) >= 0.8 * len(a | b) - 1e-9) for i, a in enumerate(sets)]
    assert sorted(r["n"] for r in found.groupBy("set_id").agg(F.sum("n").alias("n")).collect()) == sorted(n for n in near if n)
    assert jaccard.near_duplicates(frame(spark, rows)).count() == len(rows)

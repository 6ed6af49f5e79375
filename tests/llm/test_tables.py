"""Operators on pages and embeddings."""

import hashlib
import random

import numpy as np
import pytest

from lodestar.llm import ann, urls, warc


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "x" * 2000
    rows = [(1, "https://A.example.com/en/1?x", None), (2, None, big), (3, "nothing", big), (4, "http://m.www.example.com/en/", ""), (5, "http://x.net/es/a", "<a href='https://good.org/a'>"), (6, "http://y.net:80/fr", big), (6, "http://y.net:80/fr", big), (None, "ftp://h#/fr/", "short"), (7, "http://q.net/fr/#", "short")]
    rows += [(100 + k, f"http://h{k}.org/", f'<a href="http://x.net/es/a">z</a><a href=//h{(k + 1) % 5}.org>') for k in range(5)]
    return spark.createDataFrame([(*r, "z", "z") for r in rows], "page_id long, url string, html string, host string, digest string")


def test_url_rules(pages):
    found = urls.judge_urls(pages).collect()
    got = {r["page_id"]: r for r in found}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert (got[4]["rule"], got[4]["verdict"]) == ("www.example.com/en/", "allow")
    assert (got[2]["host"], got[2]["path"], got[2]["rule"]) == ("", "", None) == (got[3]["host"], got[3]["path"], got[3]["rule"])
    assert (got[5]["rule"], got[6]["rule"], got[7]["rule"]) == ("net/es/", None, "net/fr/")
    assert got[None]["host"] == "h" and got[None]["path"] == ""
    assert got[101]["verdict"] == "block" and got[101]["distrust"] > 0  # links to a blocked host
    assert urls.judge_urls(pages.limit(0)).count() == 0 and len(found) == pages.count()


def test_spread_equals_dense_pagerank(spark):
    rng = random.Random(1)
    e = sorted({(rng.randrange(12), rng.randrange(12)) for _ in range(40)})
    edges = spark.createDataFrame([("trust", f"n{a}", f"n{b}", 1 + (a + b) % 3) for a, b in e if a != b], "kind string, src string, dst string, w long")
    seeds = spark.createDataFrame([("trust", "n0"), ("trust", "n3")], "kind string, node string")
    got = {r["node"]: r["mass"] / urls.UNIT for r in urls.spread(edges, seeds).collect()}
    m = np.zeros((12, 12))
    for a, b in e:
        if a != b:
            m[b, a] = 1 + (a + b) % 3
    m = m / np.maximum(m.sum(axis=0), 1)
    s = np.zeros(12)
    s[[0, 3]] = 0.5
    x = s
    for _ in range(300):
        x = 0.85 * (m @ x) + 0.15 * s
    assert all(abs(got.get(f"n{k}", 0) - x[k]) < 1e-6 for k in range(12))


def test_spread_goes_to_the_end_of_a_chain_and_over_hubs(spark):
    n = 40
    edges = [("trust", f"c{k}", f"c{k + 1}", 1) for k in range(n)] + [("distrust", "hub", f"leaf{k}", 2) for k in range(9000)] + [("distrust", f"leaf{k}", "hub", 1) for k in range(0, 9000, 3)]
    got = {r["node"]: r["received"] / urls.UNIT for r in urls.spread(spark.createDataFrame(edges, "kind string, src string, dst string, w long"), spark.createDataFrame([("trust", "c0"), ("distrust", "hub")], "kind string, node string")).collect()}
    assert all(abs(got[f"c{k}"] - 0.15 * 0.85**k) < 1e-9 for k in range(1, n + 1))
    hub = 0.15 / (1 - 0.85**2 / 3)
    assert abs(got["hub"] + 0.15 - hub) < 1e-6 and abs(got["leaf5"] - 0.85 * hub / 9000) < 1e-9


def test_warc_round_trip(pages):
    got = sorted(warc.archive_pages(pages).collect(), key=str)
    assert len(got) == pages.count()
    html = {r["page_id"]: r["html"] or "" for r in pages.collect()}
    for r in got:
        p = html[r["page_id"]].encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(p), hashlib.sha1(p).hexdigest())
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got}
    assert kinds[2] == kinds[3] == ("revisit", 6) and kinds[6] == ("response", None) and kinds[7] == ("response", None)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_reader_streams_and_verifies(tmp_path):
    data = warc.page_record("1", "http://a\r\nX: y", b"p" * 300_000, None) + warc.page_record("2", "", b"", None) + warc.page_record("3", "u", b"q" * 2000, "9")
    for step in (1, 7, 100_000):
        some = data[:400] if step == 1 else data
        if step == 1:
            with pytest.raises(ValueError):
                list(warc.read_records(some[a : a + 1] for a in range(len(some))))
            continue
        got = list(warc.read_records(data[a : a + step] for a in range(0, len(data), step)))
        assert [h["WARC-Type"] for h, _ in got] == ["response", "response", "revisit"] and len(got[0][1]) == 300_000
    (tmp_path / "a.warc.gz").write_bytes(data)
    assert len(list(warc.read_file(str(tmp_path / "a.warc.gz")))) == 3
    bad = warc.record([("WARC-Type", "response"), ("WARC-Block-Digest", warc.base32_sha1(b"x"))], b"y")
    with pytest.raises(warc.Corrupt):
        list(warc.read_records([bad]))
    with pytest.raises(ValueError):
        list(warc.read_records([data[:-3]]))


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "a", "b") for i, v in rows], "vec_id long, embedding array<float>, v string, label string")


def brute(rows, every=20, k=20):
    good = {(i, tuple(np.float32(x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)}
    out = []
    for q, qv in sorted(good):
        if q % every == 0:
            near = sorted((-sum(float(a) * float(b) for a, b in zip(qv, v)), i) for i, v in good if i != q and len(v) == len(qv))
            out += [(q, r + 1, i) for r, (_, i) in enumerate(near[:k])]
    return out


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(90)]
    rows += [(200 + i, rows[0][1]) for i in range(60)] + [(300, None), (301, []), (302, [0] * 6), (303, [1, None, 1, 1, 1, 1]), (304, [float("nan")] * 6), (340, [float("inf")] * 6), (360, [1.0, 2.0]), (None, [1.0] * 6), (40, rows[40][1])]
    got = ann.nearest(vectors(spark, rows)).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == brute(rows)
    assert ann.nearest(vectors(spark, rows).limit(0)).count() == 0


def test_recall_of_the_hashed_search(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 32))
    x = centres[rng.integers(0, 10, 9000)] * 0.4 + rng.normal(size=(9000, 32))
    x *= rng.uniform(0.5, 2, (9000, 1))
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    got = {(r["query_id"], r["vec_id"]) for r in ann.nearest(vectors(spark, rows), every=90).collect()}
    s = x.astype(np.float32).astype(float)
    want = set()
    for q in range(0, 9000, 90):
        d = s @ s[q]
        d[q] = -np.inf
        want |= {(q, int(i)) for i in np.argsort(-d, kind="stable")[:20]}
    assert len(got & want) / len(want) >= 0.9


def test_odd_vectors_take_the_hashed_path_too(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(400)]
    rows += [(20, rng.normal(size=6).tolist()) for _ in range(30)]  # one id, many vectors
    rows += [(500 + i, rows[0][1]) for i in range(60)] + [(700, None), (701, [0] * 6), (702, [1, None, 1, 1, 1, 1]), (None, [1.0] * 6), (40, rows[40][1])]
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(vectors(spark, rows), whole=0).collect()]
    want = brute(rows)
    assert all(q != v for q, _, v in got)
    assert len({(q, v) for q, _, v in got} & {(q, v) for q, _, v in want}) / len({(q, v) for q, _, v in want}) >= 0.9
    ranked = ann.nearest(vectors(spark, rows)).filter("query_id = 20").collect()
    assert len(ranked) >= 20 and all(r["vec_id"] != 20 for r in ranked)


def test_own_vectors_leave_room_for_others(spark):
    rows = [(20, [1.0 + k / 100, 0.0]) for k in range(30)] + [(100 + k, [0.5, k / 100]) for k in range(1, 30) if (100 + k) % 20]
    got = {(r["query_id"], r["vec_id"]) for r in ann.nearest(vectors(spark, rows)).filter("query_id = 20").collect()}
    assert got and all(v != 20 for _, v in got)
    wide = [(20, [1e300, 1.0]), (21, [2e300, 1.0]), (22, [1e-3, 1.0])]
    df = spark.createDataFrame(wide, "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in ann.nearest(df).orderBy("rank").collect()] == [21, 22]


def test_probes_reach_their_target_in_falling_order():
    h = ann.Hashes(16, 5, 1, 1.0, 1.4)
    rng = np.random.default_rng(5)
    for need in (0.3, 0.6, 0.9):
        found = h.probes(rng.normal(size=5) * 3, need)
        assert len(np.unique(found)) == len(found) > 1
    assert len(h.probes(np.full(5, 0.5), 0.3)) < len(h.probes(np.full(5, 0.5), 0.9))


def test_url_verdicts_equal_brute_force(spark):
    rng = random.Random(21)
    hosts = [f"h{k}.org" for k in range(12)] + ["www.example.com", "a.net"]
    rows = []
    for k in range(60):
        host = rng.choice(hosts)
        path = rng.choice(["/en/x", "/es/x", "/fr/", "/"])
        links = "".join(f'<a href="http://{rng.choice(hosts)}/p">l</a>' for _ in range(rng.randint(0, 3)))
        rows.append((k, f"http://{host}{path}", links))
    got = {r["page_id"]: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    ruled = {}
    for k, url, _ in rows:
        host, path = url[7:].split("/", 1)
        fits = [(len(h + p), v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        ruled[k] = max(fits)[1] if fits else None
    names = sorted({u[7:].split("/", 1)[0] for _, u, _ in rows} | set(hosts))
    at = {h: i for i, h in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    for k, url, html in rows:
        src = url[7:].split("/", 1)[0]
        for dst in [x.split("/")[0] for x in html.split('href="http://')[1:]]:
            if dst != src:
                w[at[dst], at[src]] += 1
    seen = {u[7:].split("/", 1)[0] for _, u, _ in rows}
    bad = {u[7:].split("/", 1)[0] for k, u, _ in rows if ruled[k] == "block"}
    good = {u[7:].split("/", 1)[0] for k, u, _ in rows if ruled[k] == "allow"} - bad

    def mass(m, seeds):
        m = m / np.maximum(m.sum(axis=0), 1)
        s = np.array([1 / len(seeds) if h in seeds else 0 for h in names]) if seeds else np.zeros(len(names))
        x, r = s, np.zeros(len(names))
        for _ in range(300):
            r = 0.85 * (m @ x)
            x = r + 0.15 * s
        return x, r

    trust, _ = mass(w, good)
    _, distrust = mass(w.T, bad)
    for k, url, _ in rows:
        h = at[url[7:].split("/", 1)[0]]
        t, d = trust[h] * len(seen), distrust[h] * len(seen)
        if ruled[k] is not None:
            assert got[k]["verdict"] == ruled[k]
        elif abs(d - t) > 1e-6 and abs(d - urls.DISTRUST) > 1e-6:
            assert got[k]["verdict"] == ("block" if d > urls.DISTRUST and d > t else "allow"), (url, t, d)

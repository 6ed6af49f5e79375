"""Intervals of trees, counts below nodes and ends of chains against plain walks."""

import random
from collections import Counter, defaultdict

from lodestar.operators import forest as T


def test_intervals_and_counts_equal_walks(spark):
    rng = random.Random(2)
    parents = {k: None if k % 40 == 0 else rng.randrange(k - k % 40, k) for k in range(200)}
    parents |= {300 + k: 299 + k if k else None for k in range(60)}  # a chain
    parents |= {400 + k: 400 for k in range(1, 50)} | {400: 7, 500: 501, 501: 502, 502: 500, 503: 500, 600: 999}  # a wide node, a circle, one below it, an unknown parent
    mark = {k: rng.choice("abc") for k in parents if k % 11}
    rows = [(k, p) for k, p in parents.items()]
    tree = T.intervals(spark.createDataFrame(rows, "id int, parent int"))
    at = {r["id"]: (r["root"], r["enter"], r["leave"]) for r in tree.collect()}
    circle = {500, 501, 502, 503}
    assert set(at) == set(parents) - circle

    def above(k):
        while k in parents:
            yield k
            k = parents[k]

    for k in at:
        for j in rng.sample(sorted(at), 60):
            inside = at[j][0] == at[k][0] and at[j][1] <= at[k][1] <= at[j][2]
            assert inside == (j in set(above(k)))
    want = defaultdict(Counter)
    for k in at:
        for j in above(k):
            want[j][mark.get(k)] += 1
    scopes = [s for s in parents if s % 3 == 0]
    got = T.subtree_counts(tree, spark.createDataFrame(list(mark.items()), "id int, mark string"), spark.createDataFrame([(s,) for s in scopes], "id int"))
    assert {(r["scope"], r["mark"]): r["n"] for r in got.collect()} == {(s, m): want[s][m] for s in scopes if s in at for m in "abc"}
    assert T.intervals(spark.createDataFrame([], "id int, parent int")).count() == 0


def test_ends_of_chains(spark):
    rows = [(k, k + 1) for k in range(100)] + [(100, None), (200, 201), (201, 202), (202, 201), (203, 203), (300, 999), (301, 300)]
    got = {r["id"]: (r["last"], r["steps"], r["circle"]) for r in T.chains(spark.createDataFrame(rows, "id int, to int")).collect()}
    want = {k: (100, 100 - k, False) for k in range(101)} | {k: (None, None, True) for k in (200, 201, 202, 203)} | {300: (999, 1, False), 301: (999, 2, False)}
    assert got == want

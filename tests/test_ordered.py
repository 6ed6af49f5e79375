"""Scans over ranges, and places in spans, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import ordered as O
from lodestar.operators import spans as S


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(k, rng.choice(["hot"] * 9 + ["a", "b", None]), rng.randint(0, 50), rng.choice([None, *range(100)])) for k in range(3000)]
    return data, spark.createDataFrame(data, "id int, g string, o int, v int").repartition(5)


def test_ranks_and_minima_cross_ranges(rows):
    data, df = rows
    order = [F.col("o").desc(), F.col("id")]
    rank = {r["id"]: r["rank"] for r in O.ranked(df, ["g"], order, "rank").collect()}
    least = {r["id"]: r["least"] for r in O.running_min(df, ["g"], order, "v", "least").collect()}
    for g in {r[1] for r in data}:
        seen = None
        for k, r in enumerate(sorted((r for r in data if r[1] == g), key=lambda r: (-r[2], r[0])), 1):
            seen = seen if r[3] is None else r[3] if seen is None else min(seen, r[3])
            assert rank[r[0]] == k and least[r[0]] == seen
    number = sorted((r["n"], -r["o"], r["id"]) for r in O.numbered(df, order, "n", 10).collect())
    assert [n for n, _, _ in number] == list(range(11, 3011)) and [x[1:] for x in number] == sorted(x[1:] for x in number)
    assert O.ranked(df.limit(0), ["g"], order, "rank").count() == O.numbered(df.limit(0), order, "n").count() == 0


def brute(points, spans):
    out = {}
    for point, path, a, b in points:
        held = [(f, e - s, i, s) for i, p, s, e, f in spans if path is not None and p == path and s is not None and a is not None and b is not None and s <= a and e >= b and s <= e]
        if not held:
            out[point] = (None, "unmapped")
            continue
        f, n, i, s = min(held)
        out[point] = (i, "file_fallback" if f else "exact" if (s, s + n) == (a, b) else "containing_target")
    return out


@pytest.mark.parametrize("few", [0, 4, 32])
def test_places_equal_brute_force(spark, few):
    rng = random.Random(few)
    spans, points = [], []
    for path in ["a", "b", "c", None]:
        for _ in range(rng.choice([3, 60, 200])):
            s = rng.choice([0, 0, rng.randint(0, 70), rng.randint(0, 5000)])
            spans.append((len(spans), path, s, s + rng.choice([0, 0, 1, 10, rng.randint(0, 6000)]), rng.random() < 0.05))
    spans += [(900, "a", 7, 3, False), (901, "a", None, 3, False)] + spans[:1]
    spans += [(1000 + k, "deep", k, 200 - k, False) for k in range(100)] + [(2000, "deep", 0, 10**9, True), (2001, "big", (1 << 40) - 5, 1 << 40, False), (2002, "big", 0, 1 << 41, False)]
    for k in range(300):
        a = rng.choice([0, rng.randint(0, 100), rng.randint(0, 6000)])
        points.append((k, rng.choice(["a", "b", "c", "deep", "none", None]), a, a + rng.choice([0, 0, 1, 50, 3000])))
    points += [(1000, "big", 1 << 39, (1 << 39) + 1), (1001, "big", (1 << 40) - 5, 1 << 40), (1002, "a", None, 5), (1003, "deep", 100, 100), (1004, "deep", 0, 10**10)]
    points += [(2000 + s[0], s[1], s[2], s[3]) for s in spans[:40] if s[2] is not None]
    found = S.resolve_places(spark.createDataFrame(points, "point int, path string, start long, end long"), spark.createDataFrame(spans, "id int, path string, s long, e long, is_file boolean"), few)
    assert {r["point"]: (r["id"], r["quality"]) for r in found.collect()} == brute(points, spans)


def test_a_large_file_makes_few_candidates(spark):
    n = 20_000
    spans = spark.range(n).selectExpr("id", "concat('f', id div 1000000) as path", f"id as s", f"{2 * n} - id as e", "false as is_file")  # all nested
    points = spark.range(n).selectExpr("id as point", "concat('f', id div 1000000) as path", f"id as start", f"{2 * n} - id - 1 as end")
    found = S.resolve_places(points, spans)
    assert found.filter("id = point and quality = 'containing_target'").count() == n
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_equal_spans_and_places_are_dealt_once(spark, monkeypatch):
    dealt, plain = [], S.running_min
    monkeypatch.setattr(S, "running_min", lambda rows, *rest: dealt.append(rows.count()) or plain(rows, *rest))
    n = 5000
    spans = spark.range(n).selectExpr("id", "'f' as path", "id % 40 as s", "id % 40 + 100 as e", "false as is_file")
    points = spark.range(n).selectExpr("id as point", "'f' as path", "id % 3 as start", "id % 3 + 100 as end")
    found = S.resolve_places(points.unionByName(points.filter("point < 10")), spans)
    assert found.filter("id = point % 3 and quality = 'exact'").count() == found.count() == n
    assert sum(dealt) < 200

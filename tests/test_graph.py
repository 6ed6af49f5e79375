"""Reach and components against plain walks, on graphs with paths, trees, rings and hubs."""

import random
from collections import defaultdict

import pytest

from lodestar.operators import graph as G
from lodestar.operators import paths, tables


def walks(edges, seeds, roots, max_depth=None):
    """(node, root): (depth, via), level by level, for each root; then the nearest roots of each node."""
    out = defaultdict(set)
    for a, b in edges:
        if a != b:
            out[a].add(b)
    dist = {}
    for s in seeds:
        level, depth = {s}, 0
        while level and (max_depth is None or depth <= max_depth):
            for v in level:
                dist[v, s] = depth
            depth += 1
            level = {w for v in level for w in out[v] if (w, s) not in dist}
    kept = defaultdict(list)
    for (v, s), d in dist.items():
        kept[v].append((d, s))
    kept = {v: sorted(x)[:roots] for v, x in kept.items()}
    found = set()
    for v, x in kept.items():
        for d, s in x:
            via = min((u for u in out if v in out[u] and (d - 1, s) in kept.get(u, ())), default=None) if d else None
            found.add((v, s, d, via))
    return found


def graphs():
    """Some graphs side by side, and seeds."""
    edges, seeds = [], []
    for k, (own, at) in enumerate(_graphs()):
        edges += [(a + k * 1_000_000, b + k * 1_000_000) for a, b in own]
        seeds += [s + k * 1_000_000 for s in at]
    return edges, seeds


def _graphs():
    rng = random.Random(7)
    for k in range(6):
        n = rng.choice([5, 30, 80])
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * rng.choice([0.8, 1.1, 2])))]
        for _ in range(rng.randint(0, 3)):  # paths and rings that hang on somewhere
            a, m = rng.randrange(n), rng.randint(3, 40)
            nodes = [1000 * (k + 1) + len(edges) * 50 + j for j in range(m)]
            edges += [(a, nodes[0]), *zip(nodes, nodes[1:]), *rng.choice([[], [(nodes[-1], rng.randrange(n))], [(nodes[-1], a)], [(nodes[-1], nodes[0])]])]
        ring = [90_000 + j for j in range(rng.randint(2, 17))]
        edges += zip(ring, ring[1:] + ring[:1])
        comb = [70_000 + j for j in range(40)]  # a spine with a tooth at each node
        edges += [*zip(comb, comb[1:]), *((v, v + 500) for v in comb), (rng.randrange(n), comb[0])]
        yield edges, sorted({rng.randrange(n) for _ in range(rng.randint(1, 6))})


@pytest.mark.parametrize(("plain", "roots", "most"), [(0, 2, None), (1, 1, 7)])
def test_reach_equals_walks(spark, monkeypatch, plain, roots, most):
    monkeypatch.setattr(G, "PLAIN", plain)
    edges, seeds = graphs()
    df, at = spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(s,) for s in seeds], "node int")
    assert {tuple(r) for r in G.reach(df, at, most, roots).collect()} == walks(edges, seeds, roots, most)


def components(edges):
    """Tarjan's algorithm; label: least node."""
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
        out[b]
    index, low, stack, on, found = {}, {}, [], set(), {}
    for root in list(out):
        if root in index:
            continue
        todo = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while todo:
            v, it = todo[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    todo.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    if len(part) > 1 or v in out[v]:
                        found.update({w: (min(part), len(part)) for w in part})
    return found


def test_cycles_equal_tarjan(spark):
    edges, _ = graphs()
    df = spark.createDataFrame(edges, "src int, dst int")
    assert {r["node"]: (r["label"], r["size"]) for r in G.cycles(df).collect()} == components(edges)
    assert G.cycles(df.limit(0)).count() == 0
    assert [tuple(r) for r in G.cycles(spark.createDataFrame([(1, 1), (1, 2)], "src int, dst int")).collect()] == [(1, 1, 1)]


@pytest.fixture
def written(monkeypatch):
    """How many tables the rounds have written."""
    count, real = [0], tables.cut

    def counted(df):
        count[0] += 1
        return real(df)

    for m in (G, paths, tables):
        monkeypatch.setattr(m, "cut", counted)
    return count


def test_a_long_chain_takes_few_rounds(spark, written):
    n = 10_000
    chain = spark.range(n).selectExpr("id as src", "id + 1 as dst")
    got = G.reach(chain, spark.createDataFrame([(0,), (n // 2,)], "node long"))
    assert got.filter(f"depth = node % {n // 2} + if(node = {n}, {n // 2}, 0)").count() == n + 1
    assert got.filter("via is not distinct from if(depth = 0, null, node - 1)").count() == n + 1
    assert written[0] < 60  # a few tables a round, fewer than 40 rounds


def test_long_rings_and_chains_of_rings_take_few_rounds(spark, written):
    n = 1000
    ring = spark.range(n).selectExpr("id as src", f"(id + 1) % {n} as dst")
    rings = spark.range(100).selectExpr("explode(array(struct(100000 + 2 * id as src, 100001 + 2 * id as dst), struct(100001 + 2 * id as src, 100000 + 2 * id as dst), struct(100001 + 2 * id as src, 100002 + 2 * id as dst))) as e").select("e.*")
    got = G.cycles(ring.unionByName(rings))
    assert got.filter(f"label = 0 and size = {n}").count() == n
    assert got.filter("size = 2 and label = node - node % 2").count() == 200 and got.count() == n + 200


def test_what_is_reachable_over_long_ways(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(60)] + [(rng.randrange(100, 130), rng.randrange(100, 130)) for _ in range(40)] + [(7, 7), (60, 100), (200, 201)]
    e = spark.createDataFrame(edges, "src int, dst int")
    for seeds in ([0], [55, 300], [200, 201], []):
        want, last = set(seeds), set(seeds)
        while last:
            last = {b for a, b in edges if a in last} - want
            want |= last
        got = [r[0] for r in G.reachable(e, spark.createDataFrame([(s,) for s in seeds], "node int")).collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("pairs", [1, 7, 1 << 24])
def test_pairs_of_a_hub_are_dealt_over_slices(spark, monkeypatch, pairs):
    monkeypatch.setattr(tables, "PAIRS", pairs)
    left = [("hub", k) for k in range(30)] + [("few", 100), (None, 3), ("left", 4)]
    right = [("hub", f"r{k}") for k in range(9)] + [("few", "r"), (None, "x"), ("right", "y")]
    got = tables.pairs_by(spark.createDataFrame(left, "k string, a int"), spark.createDataFrame(right, "k string, b string"), "k")
    assert sorted((r["k"], r["a"], r["b"]) for r in got.collect()) == sorted((k, a, b) for k, a in left for j, b in right if k and k == j)
    if pairs == 7:
        assert got.rdd.getNumPartitions() > 30


def test_weak_siblings_that_are_all_affected_make_no_pairs(spark):
    """4,000 children of one parent, all weak and affected, and one spared: 4,000 pairs, not 16 million."""
    n = 4000
    rows = [("p", None, "represented"), ("hub", None, "represented"), ("spared", "p", "failed")] + [(f"c{k}", "p", "failed") for k in range(n)]
    targets = spark.createDataFrame(rows, "id string, parent string, inventory string")
    relations = spark.createDataFrame([(f"c{k}", "hub", "x:calls") for k in range(n)], "source string, target string, kind string")
    out = G.invalidation(relations, targets, targets.filter("id = 'hub'").select("id"))
    got = {r["reason"]: r["count"] for r in out.groupBy("reason").count().collect()}
    assert got == {"changed": 1, "calls": n, "contains": n, "conservative": n}
    joins = out.filter("reason = 'conservative'")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in joins  # who is affected is left out before the pairs are made

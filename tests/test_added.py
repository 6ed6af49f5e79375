"""Graph kernels, packing and visibility against plain Python; manifests, publication, compaction and seams."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestar.functions import ids, text
from lodestar.operators import graph, planning, policies, queue, seams, sinks


def test_components_equal_plain_search(spark):
    rng = random.Random(1)
    for n, m in ((12, 20), (20, 34)):
        pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        near = {k: {b for a, b in pairs if a == k} for k in range(n)}

        def seen(k):
            out, todo = set(), [k]
            while todo:
                for x in near[todo.pop()] - out:
                    out.add(x)
                    todo.append(x)
            return out

        ways = {k: seen(k) for k in range(n)}
        want = set()
        for k in range(n):
            mine = {x for x in ways[k] if k in ways[x]} | {k}
            if len(mine) > 1 or (k, k) in pairs:
                want.add((k, min(mine), len(mine)))
        got = {(r["node"], r["label"], r["size"]) for r in graph.cycles(spark.createDataFrame(sorted(pairs), "src int, dst int")).collect()}
        assert got == want


def test_reach_finds_the_nearest_roots(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("c", "e")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("d",)], "node string")
    one = {r["node"]: (r["root"], r["depth"], r["via"]) for r in graph.reach(edges, seeds).collect()}
    assert one == {"a": ("a", 0, None), "d": ("d", 0, None), "b": ("a", 1, "a"), "c": ("d", 1, "d"), "e": ("d", 2, "c")}
    two = {(r["node"], r["root"], r["depth"]) for r in graph.reach(edges, seeds, roots=2).collect()}
    assert two == {("a", "a", 0), ("d", "d", 0), ("b", "a", 1), ("c", "d", 1), ("c", "a", 2), ("e", "d", 2), ("e", "a", 3), ("a", "d", 2), ("b", "d", 3)}
    assert {r["node"] for r in graph.reach(edges, seeds, 1).collect()} == {"a", "b", "c", "d"}


@pytest.mark.parametrize("head", [4, 256])
def test_packing_equals_the_plain_walk(spark, monkeypatch, head):
    monkeypatch.setattr(planning, "HEAD", head)
    rng = random.Random(2)
    rows = [(f"g{rng.randrange(3)}", k, rng.random() < 0.2, rng.randrange(4), rng.randrange(1, 40), rng.randrange(1, 9), rng.randrange(4)) for k in range(150)]
    df = spark.createDataFrame(rows, "g string, id long, required boolean, priority int, bytes long, tokens long, depth int")
    got = {(r["g"], r["position"], r["id"]) for r in planning.greedy_pack(df, "g", 150, 7, 40, 2).collect()}
    want = set()
    for g in ("g0", "g1", "g2"):
        used = spent = n = 0
        for _, k, req, pri, size, tok, depth in sorted((r for r in rows if r[0] == g and r[6] <= 2), key=lambda r: (not r[2], -r[3], r[1])):
            if used + size <= 150 and spent + tok <= 40 and n < 7:
                want.add((g, n, k))
                used, spent, n = used + size, spent + tok, n + 1
    assert got == want


def test_visibility_of_deep_chains_and_circles(spark):
    rows = [("0", "public", None)] + [(str(k), "inherited", str(k - 1)) for k in range(1, 40)] + [("x", "inherited", "y"), ("y", "inherited", "x"), ("z", "inherited", "x"), ("o", "inherited", "gone"), ("r", "inherited", None)]
    got = {r["id"]: r["effective"] for r in planning.inherited_visibility(spark.createDataFrame(rows, "id string, visibility string, parent string")).collect()}
    assert all(got[str(k)] == "public" for k in range(40)) and {got[k] for k in "xyzor"} == {"unknown"}


def test_rules_must_be_terminal_and_single(spark):
    shape = "class string, visibility string, state string"
    for rows in ([("type", "public", "pending")], [("type", "public", "applicable"), ("type", "public", "not_applicable")]):
        with pytest.raises(ValueError):
            policies.checked_rules(spark.createDataFrame(rows, shape))
    for name in policies.UNMATCHED:
        assert policies.rule_table(spark, name).count() > 0


def test_one_workspace_is_kept_and_two_are_refused(spark):
    shape = "id string, kind string, name string, parent string"
    one = policies.one_workspace(spark.createDataFrame([("w", "workspace", "w", None), ("p", "package", "p", None), ("m", "module", "m", "p")], shape)).collect()
    assert {(r["id"], r["parent"]) for r in one} == {("w", None), ("p", "w"), ("m", "p")}
    with pytest.raises(ValueError):
        policies.one_workspace(spark.createDataFrame([("w", "workspace", "w", None), ("v", "workspace", "v", None)], shape))


def test_set_hash_ignores_order_and_counts_repeats(spark):
    h = lambda rows: spark.createDataFrame([(r,) for r in rows], "x string").agg(ids.set_hash("x").alias("h")).first()["h"]
    assert h(["a", "b", "c"]) == h(["c", "a", "b"]) != h(["a", "b"]) and h(["a", "a"]) != h(["a"])


def test_trim_never_cuts_a_character(spark):
    samples = ["é" * 300, "x" * 99 + "😀" * 100, "ab" * 400, "短" * 200, "a" * 120]
    for r in spark.createDataFrame([(t,) for t in samples], "t string").select("t", text.trim_bytes("t", 150).alias("out")).collect():
        out, t = r["out"], r["t"]
        if len(t.encode()) <= 150:
            assert out == t
        else:
            note = f"\n… {len(t.encode())} more bytes omitted to fit the evidence budget."
            head = out.removesuffix(note)
            assert out.endswith(note) and t.startswith(head) and len(out.encode()) <= 150 < len(out.encode()) + 4


def test_manifest_is_verified_when_it_is_read(spark, tmp_path):
    files = spark.createDataFrame([("a.rs", "h1", 3, "source"), ("b.md", None, 4, "documentation")], "path string, content string, size long, class string")
    sinks.write_manifest(files, f"{tmp_path}/m", "cfg", "r1")
    assert sinks.load_manifest(spark, f"{tmp_path}/m").count() == 2
    torn = next(p for p in (tmp_path / "m/files").glob("part-*.json") if "h1" in p.read_text())
    torn.write_text(torn.read_text().replace("h1", "h2"))
    torn.with_name(f".{torn.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        sinks.load_manifest(spark, f"{tmp_path}/m")


def test_inventory_is_switched_whole(spark, tmp_path):
    t = lambda *rows: {"target": spark.createDataFrame([(r,) for r in rows], "id string")}
    first = sinks.publish_inventory(t("a"), str(tmp_path), "rust")
    assert sinks.publish_inventory(t("a"), str(tmp_path), "rust") == first
    assert sinks.publish_inventory(t("a", "b"), str(tmp_path), "rust") != first
    assert sinks.read_inventory(spark, str(tmp_path), "rust", "target", "id string").count() == 2


def test_compaction_keeps_rows(spark, tmp_path):
    spark.range(100).repartition(10).write.parquet(f"{tmp_path}/t")
    assert sinks.compact(spark, f"{tmp_path}/t") == 1
    assert spark.read.parquet(f"{tmp_path}/t").count() == 100 and len(list((tmp_path / "t").glob("*.parquet"))) == 1


def test_seams_run_where_the_rows_are(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "g string, v long")
    assert seams.drain(rows, lambda items: sum(1 for _ in items)) == 3

    def adapter(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["g"].iloc[0] == "b":
            raise RuntimeError("broken")
        return pdf.assign(v=pdf["v"] * 2)

    got = {(r["g"], r["v"], r["failed"]) for r in seams.isolated(rows, adapter, "g string, v long", "g").collect()}
    assert got == {("a", 2, None), ("a", 4, None), ("b", None, "RuntimeError: broken")}


def test_numbers_follow_the_log_without_gaps(spark):
    log = spark.createDataFrame([(7,)], "sequence long")
    new = spark.range(500).select((F.col("id") * 37 % 500).alias("k"))
    got = sorted((r["sequence"], r["k"]) for r in queue.append_events(log, new, ["k"]).collect())
    assert [s for s, _ in got] == list(range(8, 508)) and [k for _, k in got] == list(range(500))

"""Small fixtures for what SQL does not reach: sources, parsers, sinks, streams, edge cases of the matching and the graph."""

import json
import time

from pyspark.sql import functions as F

from lodestar.functions import ids, text
from lodestar.operators import design, graph, planning, queue, report, sinks, snapshot
from lodestar.sources import repository


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_ids_do_not_collide_and_tell_null_from_empty(spark):
    a = one(spark, ids.derived_id("t", F.lit("ab"), F.lit("c")))
    assert a != one(spark, ids.derived_id("t", F.lit("a"), F.lit("bc"))) and len(a) == 64
    assert one(spark, ids.derived_id("t", F.lit(""))) != one(spark, ids.derived_id("t", F.lit(None)))


def test_list_hash_depends_on_order(spark):
    x, y = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("a"))
    assert one(spark, ids.list_hash(x)) != one(spark, ids.list_hash(y))


def test_file_classes(spark):
    cases = {"target/x.rs": "generated_input", "vendor/a.rs": "source", "a/Cargo.lock": "lockfile", "a.toml": "configuration", "README.md": "design_document", "vendor/x": "vendor", "a.png": "binary", "LICENSE": "unsupported"}
    got = {r["p"]: r["c"] for r in spark.createDataFrame([(k,) for k in cases], "p string").select("p", text.file_class("p").alias("c")).collect()}
    assert got == cases


def test_capture_hashes_sniffs_and_reports_issues(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.rs").write_text("fn a() {}")
    (tmp_path / "src/b.rs").write_bytes(b"x\x00y")
    (tmp_path / "big.md").write_text("z" * 500)
    got = {r["path"]: r for r in repository.capture(spark, str(tmp_path), 100).collect()}
    assert got["src/a.rs"]["class"] == "source" and got["src/b.rs"]["class"] == "binary"
    assert got["big.md"]["issue"] == "oversized" and got["big.md"]["content"] is None


def test_git_delta(spark):
    lines = spark.createDataFrame([("M\ta.rs",), ("R090\told.rs\tnew.rs",), ("D\tgone.rs",), ("?? fresh.rs",)], "value string")
    assert sorted(map(tuple, repository.git_delta(lines).collect())) == [("a.rs", "modified"), ("fresh.rs", "added"), ("gone.rs", "removed"), ("new.rs", "added"), ("old.rs", "removed")]


def test_syntax_facts_and_failures(spark):
    files = [("a.py", 'import os\nclass A(B):\n    """Doc."""\n    def f(self):\n        g()\n'), ("b.py", "def ("), ("c.rs", "/// Adds.\npub fn add() {}\nimpl T for S {}\n"), ("d.ts", "export class C extends D {}\nimport x from './y'"), ("e.java", "public class E implements F {\n  public int size() { return 0; }\n}"), ("f.xyz", "")]
    got = {(r["path"], r["fact"], r["name"]): r for r in repository.syntax(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got["a.py", "class", "A"]["detail"] == "Doc." and ("a.py", "callable", "A.f") in got and ("a.py", "call", "g") in got and ("a.py", "import", "os") in got
    assert ("b.py", "failed", "b.py") in got and got["c.rs", "callable", "add"]["detail"] == "Adds." and ("c.rs", "implements", "T") in got
    assert ("d.ts", "extends", "D") in got and ("e.java", "callable", "size") in got and ("f.xyz", "unsupported", "f.xyz") in got


def test_manifests_and_diagnostics(spark):
    m = spark.createDataFrame([("package.json", '{"name": "n", "dependencies": {"a": "1"}}'), ("requirements.txt", "b==2 # x\n"), ("cargo-metadata.json", '{"packages": [{"name": "p", "dependencies": [{"name": "c", "req": "^1"}]}]}'), ("x/package.json", "{")], "path string, text string")
    assert {(r["dependency"], r["version"]) for r in repository.manifests(m).collect()} == {("a", "1"), ("b", "2"), ("c", "^1"), (None, None)}
    d = [("a.ts(3,4): error TS12: bad",), ("A.java:7: error: no",), ("m.py:1:2: E501 long",), (json.dumps({"message": {"message": "m", "code": {"code": "E1"}, "spans": [{"file_name": "l.rs", "line_start": 9}]}}),), ("noise",)]
    assert {(r["tool"], r["path"], r["line"]) for r in repository.diagnostics(spark.createDataFrame(d, "value string")).collect()} == {("tsc", "a.ts", 3), ("javac", "A.java", 7), ("ruff", "m.py", 1), ("rustc", "l.rs", 9)}


def test_relative_imports_take_the_first_existing_candidate(spark):
    imports = spark.createDataFrame([("src/a.ts", "./b"), ("src/a.ts", "../lib"), ("src/a.ts", "react"), ("src/a.ts", "./none")], "path string, name string")
    files = spark.createDataFrame([("src/b.ts",), ("src/b.js",), ("lib/index.ts",)], "path string")
    assert sorted(r["target"] for r in repository.relative_imports(imports, files).collect()) == ["lib/index.ts", "src/b.ts"]


def test_inventory_lines(spark):
    lines = spark.createDataFrame([('{"record":"target","id":"t1","name":"n"}',), ('{"record":"relation","id":"r","source":"t1","target":"t2","kind":"core:calls"}',), ("broken",)], "value string")
    got = repository.inventory(lines)
    assert got["target"].first()["id"] == "t1" and got["relation"].first()["target"] == "t2" and got["rejected"].count() == 1


def test_closure_on_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "x"), ("c", "d")], "src string, dst string")
    got = {(r["node"], r["depth"]) for r in graph.closure(e, spark.createDataFrame([("a",)], "root string")).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {(r["node"], r["label"], r["size"]) for r in graph.cycles(e).collect()} == {("a", "a", 3), ("b", "a", 3), ("c", "a", 3), ("x", "x", 1)}


def test_two_phase_match_takes_the_latest_baseline_finding(spark):
    f = lambda rows: spark.createDataFrame(rows, "id string, policy string, target string, title string, severity string")
    b = f([("1", "p", "t", "Leak", "high"), ("2", "p", "t", " leak ", "high"), ("3", "p", "t", "same", "low")])
    c = f([("9", "p", "t", "LEAK", "high"), ("3", "p", "t", "same", "low"), ("8", "p", "u", "other", "critical")])
    got = {(r["baseline_id"], r["current_id"], r["category"], r["matched_by"]) for r in report.match(b, c).collect()}
    assert got == {("2", "9", "persistent", "claim"), ("3", "3", "persistent", "id"), ("1", None, "resolved", None), (None, "8", "new", None)}
    assert [r["rule"] for r in report.gate(report.match(b, c)).collect()] == ["max_new_critical"]


def test_stability_edges(spark):
    m = lambda rows: report.stability(spark.createDataFrame(rows, "run int, key int")).first()["stability_bp"]
    assert m([(1, 1)]) is None and m([(1, 1), (2, 1)]) == 10000 and m([(1, 1), (2, 2)]) == 0 and m([(1, 1), (1, 2), (2, 1)]) == 5000


def test_packing_skips_and_goes_on(spark):
    c = spark.createDataFrame([("g", "a", False, 3, 5), ("g", "b", False, 2, 9), ("g", "c", False, 1, 4), ("g", "d", True, 0, 1)], "g string, id string, required boolean, priority int, bytes long")
    assert [r["id"] for r in planning.greedy_pack(c, "g", 10, 5).orderBy("position").collect()] == ["d", "a", "c"]


def test_lease_is_over_at_its_very_moment(spark):
    w = spark.createDataFrame([(1, "leased", 100, 1), (2, "leased", 101, 1), (3, "pending", None, 0)], "work_id long, state string, lease_until long, attempts long")
    assert {r["work_id"] for r in queue.available(w, 100).collect()} == {1, 3}
    assert {r["work_id"] for r in queue.heartbeat(w, 100, 5).collect()} == {1, 2}


def test_snapshot_diff_treats_nulls_as_equal(spark):
    a = spark.createDataFrame([("x", None, 1), ("y", "h", 1)], "path string, content string, size int")
    b = spark.createDataFrame([("x", None, 1), ("y", None, 1)], "path string, content string, size int")
    assert {tuple(r) for r in snapshot.diff(a, b, "path", ["content", "size"]).collect()} == {("x", "unchanged"), ("y", "modified")}


def test_design_documents(spark):
    doc = "---\nid: ADR-7\nstatus: Superseded by ADR-9\nsupersedes: [ADR-1, \"ADR-2\"]\ngoverns:\n  - core\n---\n# Title\n## Rules\n- It MUST work\n- a note\nIt SHOULD be fast\n"
    r = design.parse_artifacts(spark.createDataFrame([("docs/adr/7.md", doc), ("x.md", None)], "path string, text string")).orderBy("path").collect()
    assert (r[0]["identifier"], r[0]["status"], r[0]["superseded_by"], r[0]["supersedes"], r[0]["governs"]) == ("ADR-7", "superseded", "adr-9", ["ADR-1", "ADR-2"], ["core"])
    assert [(q["id"], q["level"]) for q in r[0]["requirements"]] == [("Rules/REQ-1", "must"), ("Rules/REQ-2", "should")] and r[1]["title"] == ""


def test_bundle_is_written_once(spark, tmp_path):
    import pytest

    df = spark.createDataFrame([(1, "a")], "id long, name string")
    assert sinks.finalize_bundle({"work": df}, str(tmp_path / "b")).first()["rows"] == 1
    assert sinks.read_bundle(spark, str(tmp_path / "b"), "work", "id long, name string").collect() == df.collect()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.finalize_bundle({"work": df}, str(tmp_path / "b"))


def test_exports(spark):
    df = spark.createDataFrame([("a|b", 1)], "k string, n int")
    assert "a\\|b" in sinks.markdown("T", df) and "<td>a|b</td>" in sinks.html_page("T", df)
    lines = [json.loads(r["value"]) for r in sinks.report_lines(df, df).collect()]
    assert [x["record"] for x in lines] == ["summary", "finding_cluster"]
    assert json.loads(sinks.sarif_log(["r"], ['{"ruleId":"r"}']))["version"] == "2.1.0"


def test_json_repair_and_review(spark):
    from lodestar.operators import validation as V

    assert V.repair_json('```json\n{"a": [1, 2,], "b": "x}"\n```') == '{"a": [1, 2], "b": "x}"}' and V.repair_json("none") is None
    frames = spark.createDataFrame([(1, "ok"), (2, "bad")], "id long, prompt string")

    def reviewer(p):
        if p == "bad":
            raise ValueError("no")
        return '{"x": 1'

    got = {r["id"]: r for r in V.review(frames, reviewer).collect()}
    assert got["1"]["answer"] == '{"x": 1}' and got["2"]["error"] == "ValueError: no" and got["2"]["tries"] == 2


def test_scopes_are_trimmed_from_the_boundary(spark):
    from lodestar.operators import validation as V

    items = [("constituent", "c1", 5), ("boundary_target", "b1", 4), ("boundary_target", "b2", 4), ("internal", "i1", 3)]
    df = spark.createDataFrame([("s", items)], "scope string, items array<struct<class:string,name:string,bytes:long>>")
    r = V.trim_scope(df, 12).first()
    assert r["kept"] == ["b1", "c1", "i1"] and r["dropped"] == 1


def test_contract_sections(spark):
    from lodestar.operators import validation as V

    df = spark.createDataFrame([(1, "Adds.\n# Panics\nIf zero.\n\n# Errors\nNever.")], "id long, text string")
    assert {(r["section"], r["text"]) for r in V.contract_sections(df).collect()} == {("panics", "If zero."), ("errors", "Never.")}


def test_a_failing_adapter_costs_its_own_rows(spark):
    from lodestar.operators import validation as V

    def broken():
        raise RuntimeError("boom")

    found, failed = V.run_adapters({"a": lambda: spark.createDataFrame([("t",)], "id string"), "b": broken}, spark)
    assert found.count() == 1 and failed.first()["diagnostic"] == "boom"


def test_exported_relations_and_named_evidence(spark):
    t = spark.createDataFrame([("t1", "f", "a.rs"), ("t2", "f", "b.rs"), ("t3", "g", "b.rs")], "id string, name string, path string")
    lines = spark.createDataFrame([('{"source":"t1","target":"t2","kind":"call"}',), ('{"source":"t1","target":"zz","kind":"call"}',), ("{",)], "value string")
    got = repository.exported_relations(lines, t)
    assert [tuple(r) for r in got["relation"].collect()] == [("t1", "t2", "call")] and {r["problem"] for r in got["rejected"].collect()} == {"unknown_target", "malformed"}
    records = spark.createDataFrame([("f", "b.rs"), ("f", "c.rs"), ("m::g", "z.rs"), ("h", "a.rs")], "name string, file string")
    assert {(r["name"], r["file"]): r["id"] for r in repository.named_evidence(records, t).collect()} == {("f", "b.rs"): "t2", ("f", "c.rs"): None, ("m::g", "z.rs"): "t3", ("h", "a.rs"): None}


def test_markdown_files(spark, tmp_path):
    for p in ("docs/a.md", "vendor/b.md", ".git/c.md", "d.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("# x\n")
    assert [r["path"] for r in repository.markdown_files(spark, str(tmp_path)).collect()] == ["docs/a.md"]


def test_reports_hold_every_row_unless_limited(spark):
    from lodestar.operators import sinks

    frame = spark.range(250)
    assert sinks.html_page("t", frame).count("<td>") == 250 and "| 249 |" in sinks.markdown("t", frame) and sinks.markdown("t", frame).count("\n| ") == 252
    assert "240 more" in sinks.html_page("t", frame, 10) and "240 more" in sinks.markdown("t", frame, 10)

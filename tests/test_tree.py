"""Capture of a working tree, and ignore rules by folder."""

import os

from lodestar.sources import ignores as I
from lodestar.sources import repository
from lodestar.sources import tree as T


def write(root, path, data=b"x"):
    at = root / path
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_bytes(data)


def test_capture_says_what_it_cannot_read(spark, tmp_path, monkeypatch):
    write(tmp_path, "src/lib.rs", b"pub fn item() {}\n")
    write(tmp_path, "large.rs", b"12345" * 30)
    write(tmp_path, "invalid.rs", b"\xff\xfe")
    write(tmp_path, "data.bin", b"\xff\xfe")
    write(tmp_path, "zero.py", b"a\0b")
    write(tmp_path, "dependency/.git", b"gitdir: elsewhere\n")
    write(tmp_path, "dependency/lib.rs", b"external\n")
    write(tmp_path, ".git/config")
    for k in range(5):
        write(tmp_path, f"deep/a{k}/b/c/file{k}.md", b"text")
    os.symlink("src/lib.rs", tmp_path / "link.rs")
    os.symlink("src", tmp_path / "folder")
    os.symlink("nowhere", tmp_path / "broken")
    os.mkfifo(tmp_path / "pipe.rs")
    got = {r["path"]: (r["class"], r["issue"], r["content"] is not None) for r in repository.capture(spark, str(tmp_path), 100).collect()}
    want = {
        "src/lib.rs": ("source", None, True), "large.rs": ("source", "oversized", False), "invalid.rs": ("source", "unsupported_encoding", True), "data.bin": ("binary", None, True), "zero.py": ("binary", None, True),
        "dependency": ("unsupported", "submodule", False), "link.rs": ("unsupported", "symlink", False), "folder": ("unsupported", "symlink", False), "broken": ("unsupported", "symlink", False), "pipe.rs": ("source", "unreadable", False),
    }
    assert got == want | {f"deep/a{k}/b/c/file{k}.md": ("design_document", None, True) for k in range(5)}


def test_folders_are_dealt_once(tmp_path, monkeypatch):
    for k in range(40):
        write(tmp_path, f"a{k % 7}/b{k % 5}/c{k}/f.txt")
    for spread in (1, 4, 30, 1000):
        monkeypatch.setattr(T, "SPREAD", spread)
        reader = T.TreeReader(str(tmp_path), 100)
        found = sorted(row[0] for p in reader.partitions() for row in reader.read(p))
        assert found == sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("f.txt"))
    missing = T.TreeReader(str(tmp_path / "none"), 100)
    assert [row[3] for p in missing.partitions() for row in missing.read(p)] == ["unreadable"]


def ignored(spark, paths, lines, texts=None):
    files = spark.createDataFrame([(p, (texts or {}).get(p)) for p in [*paths, *(texts or {})]], "path string, text string")
    rules = I.rules_of(I.line_rows(spark, lines).unionByName(I.ignore_file_lines(files)))
    return {r["path"] for r in I.with_ignored(files, rules).filter("ignored").collect()}


def test_rules_of_every_form(spark):
    lines = [("", 2, x) for x in ["*.log", "!keep.log", "build/", "/top.txt", "a/*.tmp", "docs/**/*.bak", "q?.c", "# comment", "", "   ", "[ab].x", "**/deep.y", "\\#odd", "trail  "]] + [("web", 0, "dist/")]
    hit = {"x.log", "d/x.log", "build/x", "d/build/y/z", "top.txt", "a/x.tmp", "docs/a/b.bak", "docs/b.bak", "q1.c", "a.x", "p/q/deep.y", "#odd", "trail", "web/dist/x.js", ".git/config", "m/.git/x"}
    miss = {"keep.log", "d/keep.log", "build", "d/top.txt", "b/a/x.tmp", "q12.c", "c.x", "dist/x.js", "a/b/x.tmp", "log", "xlog"}
    assert ignored(spark, hit | miss, lines) == hit


def test_files_in_folders_and_layers(spark):
    texts = {".gitignore": "*.tmp\nout/\n", "web/.gitignore": "!keep.tmp\n/local\n*.js", "web/app/.gitignore": "!main.js"}
    paths = ["a.tmp", "keep.tmp", "web/keep.tmp", "web/x.tmp", "web/local", "local", "web/app/local", "web/x.js", "web/app/main.js", "web/app/y.js", "x.js", "out/a", "web/out/b", "web/out/keep.tmp"]
    assert ignored(spark, paths, [], texts) == {"a.tmp", "keep.tmp", "web/x.tmp", "web/local", "web/x.js", "web/app/y.js", "out/a", "web/out/b"}  # the file's own rule decides before its folder's
    assert "web/x.js" not in ignored(spark, paths, [("", I.OVERRIDES, "!x.js")], texts) and "x.js" in ignored(spark, paths, [("", I.EXTRA, "x.js")], texts)
    files = spark.createDataFrame([("a.tmp", None), ("b.rs", "x"), (".gitignore", "*.tmp")], "path string, text string")
    assert {r["path"] for r in repository.ignore_filter(files, ["*.md"], [("", "target/")]).collect()} == {"b.rs", ".gitignore"}


def test_many_rules_leave_the_plan_as_it_is(spark):
    files = spark.range(50).selectExpr("concat('d', id % 5, '/f', id, '.rs') as path")
    plan = lambda n: I.with_ignored(files, I.rules_of(spark.range(n).selectExpr("'' as folder", "1 as layer", "cast(id as int) as line_no", "concat('f', id * 2, '.rs') as line")))
    size = [len(plan(n)._jdf.queryExecution().optimizedPlan().toString()) for n in (10, 10_000)]
    assert abs(size[0] - size[1]) < 50 and plan(10_000).filter("ignored").count() == 25

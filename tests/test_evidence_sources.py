"""Tool output, manifests and deltas of every form."""

from lodestar.sources import evidence as E
from lodestar.sources import repository


def test_odd_tool_output(spark):
    lines = [(1, "not json"), (2, '{"reason":"compiler-artifact"}'), (3, '{"reason":"compiler-message","message":{"message":"m","level":"error","spans":[]}}'), (4, None), (5, '{"reason":"compiler-message","message":{"message":"m","level":"warning","code":null,"spans":[{"file_name":".\\\\src\\\\a.rs","byte_start":5,"byte_end":9,"line_start":2,"is_primary":true},{"file_name":"b.rs","byte_start":0,"byte_end":0,"line_start":1}]}}')]
    df = spark.createDataFrame(lines, "line int, value string")
    targets = spark.createDataFrame([("f", "src/a.rs", 5, 9, False), ("m", "src/a.rs", 0, 90, False)], "id string, path string, s long, e long, is_file boolean")
    got = sorted((r["line"], r["span"], r["path"], r["is_primary"], r["code"], r["target"], r["quality"]) for r in E.compiler_evidence(df, targets).collect())
    assert got == [(5, 0, "src/a.rs", True, None, "f", "exact"), (5, 1, "b.rs", False, None, None, "unmapped")]
    results = [(1, '{"status":"passed","summary":"ok"}'), (2, '{"status":"passed","summary":" "}'), (3, '{"status":"maybe","summary":"x"}'), (4, '{"status":"failed","summary":"x","target":"zz"}'), (5, '["a"]'), (6, None), (7, '{"target":"f","status":"ignored","summary":"x","detail":"d"}')]
    found = {r["line"]: r["rejected"] for r in E.tool_results(spark.createDataFrame(results, "line int, value string"), targets).collect()}
    assert found == {1: None, 2: "empty_summary", 3: "unknown_status", 4: "unknown_target", 5: "no_object", 6: "no_object", 7: None}
    reports = spark.createDataFrame([(1, "no xml"), (2, None), (3, '<checkstyle><file name="a\\B.java"><error severity="error" message="x &amp; y " source="r"/></file><file name="c.java"/></checkstyle>')], "report int, value string")
    assert [tuple(r) for r in E.checkstyle(reports).collect()] == [(3, "a/B.java", 1, None, "error", "x & y ", "r")]


def test_manifests_of_every_form(spark):
    files = [
        ("a/pyproject.toml", '[project]\nname = "one"\ndependencies = ["numpy>=1.2,<2", "rich[all]"]\n'), ("a/requirements.txt", "ignored==1\n"), ("b/setup.cfg", "[metadata]\nname = two\n[options]\ninstall_requires =\n  attrs ~= 3.1\n  six\n"), ("c/requirements.txt", "six==1\n"),
        ("d/pyproject.toml", '[tool.poetry]\nname = "three"\n[tool.poetry.dependencies]\npython = "^3"\nflask = "^2"\nx = {version = "1", extras = ["y"]}\n'), ("e/build.gradle", "dependencies {\n implementation 'g.h:art:1.0'\n testImplementation(\"j:unit\")\n}\n"), ("f/pyproject.toml", "not [ toml"), ("g/package.json", "[]"),
    ]
    got = sorted(((r["path"], r["package"], r["dependency"], r["version"]) for r in repository.manifests(spark.createDataFrame(files, "path string, text string")).collect()), key=str)
    assert got == sorted(
        [
            ("a/pyproject.toml", "one", "numpy", "1.2"), ("a/pyproject.toml", "one", "rich", None), ("b/setup.cfg", "two", "attrs", "3.1"), ("b/setup.cfg", "two", "six", None), ("c/requirements.txt", None, "six", "1"),
            ("d/pyproject.toml", "three", "flask", "^2"), ("d/pyproject.toml", "three", "x", "1"), ("e/build.gradle", None, "g.h:art", "1.0"), ("e/build.gradle", None, "j:unit", None), ("f/pyproject.toml", None, None, None), ("g/package.json", None, None, None),
        ], key=str,
    )


def test_deltas_of_both_commands(spark):
    lines = ["M\ta.rs", "C075\tb.rs\tc.rs", "R090\told.rs\tnew.rs", "?? fresh file.rs", "R  was.rs -> is.rs", " M touched.rs", "A  added.rs", " D gone.rs", "MM both.rs", "AM more.rs"]
    got = {tuple(r) for r in repository.git_delta(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {("a.rs", "modified"), ("c.rs", "added"), ("old.rs", "removed"), ("new.rs", "added"), ("fresh file.rs", "added"), ("was.rs", "removed"), ("is.rs", "added"), ("touched.rs", "modified"), ("added.rs", "added"), ("gone.rs", "removed"), ("both.rs", "modified"), ("more.rs", "added")}

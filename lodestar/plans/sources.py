"""Queries over sources, design documents and seams: example lines and files dealt to orders; the SQL holds what each gives, worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar import bridge as B
from lodestar.functions import text as T
from lodestar.operators import design as D
from lodestar.operators import seams
from lodestar.operators import sinks
from lodestar.operators import validation as V
from lodestar.plans.rules import order_key, pick, sql_pick, sql_values
from lodestar.registry import query
from lodestar.sources import repository as S

c = F.col
def orders(spark, sf):
    return B.t(spark, sf, "orders")


def filled(template):
    """An example with the order's key in the place of @."""
    return F.replace(template, F.lit("@"), order_key().cast("string"))


def example(spark, sf, lines, name="value"):
    return orders(spark, sf).select(filled(pick(lines, order_key())).alias(name))


DELTAS = ["M\tm@.rs", "R090\told@.rs\tnew@.rs", "D\td@.rs", "?? u@.rs", "A\ta@.rs", "T\tt@.rs"]
DELTA_ROWS = [(0, "m@.rs", "modified"), (1, "old@.rs", "removed"), (1, "new@.rs", "added"), (2, "d@.rs", "removed"), (3, "u@.rs", "added"), (4, "a@.rs", "added"), (5, "t@.rs", "modified")]


def sql_rows(rows, n, names, extra=""):
    """Expected rows of each example: (number of the example, columns...), the key put in."""
    cols = ", ".join(f"replace({x}, '@', o_orderkey::VARCHAR) AS {x}" for x in names)
    return f"SELECT {cols}{extra} FROM orders JOIN {sql_values(rows, 'k', *names)} ON k = o_orderkey % {n}"


@query(sql_rows(DELTA_ROWS, len(DELTAS), ["path", "change"]))
def git_delta(spark, sf):
    return S.git_delta(example(spark, sf, DELTAS))


DIAGNOSTICS = [
    "src/a@.ts(3,7): error TS2304: Cannot find name", "src/B@.java:12: warning: [unchecked] cast", "p@.py:4:1: F401 unused import", '{"message":{"message":"unused","code":{"code":"dead_code"},"spans":[{"file_name":"r@.rs","line_start":9}]}}',
    "note: nothing", "src/B@.java:1: error: ';' expected", '{"reason":"build"}',
]
DIAGNOSED = [
    (0, "tsc", "src/a@.ts", "3", "TS2304", "Cannot find name"), (1, "javac", "src/B@.java", "12", "warning", "[unchecked] cast"), (2, "ruff", "p@.py", "4", "F401", "unused import"), (3, "rustc", "r@.rs", "9", "dead_code", "unused"),
    (5, "javac", "src/B@.java", "1", "error", "';' expected"),
]


@query(f"SELECT tool, path, line::INTEGER AS line, code, message FROM ({sql_rows(DIAGNOSED, len(DIAGNOSTICS), ['tool', 'path', 'line', 'code', 'message'])})")
def tool_diagnostics(spark, sf):
    return S.diagnostics(example(spark, sf, DIAGNOSTICS))


INVENTORY = ['{"record":"target","id":"t@","kind":"callable","name":"f@","parent":"m","visibility":"public","inventory":"represented"}', '{"record":"relation","id":"r@","source":"t@","target":"u","kind":"calls"}', '{"record":"odd"}', "broken", '{"record":"target","id":"x@"}']


@query(f"""SELECT 'target' AS record, id, name FROM ({sql_rows([(0, 't@', 'f@'), (4, 'x@', None)], len(INVENTORY), ['id', 'name'])}) UNION ALL SELECT 'relation', id, source FROM ({sql_rows([(1, 'r@', 't@')], len(INVENTORY), ['id', 'source'])})
UNION ALL SELECT 'rejected', value, NULL FROM ({sql_rows([(2, '{"record":"odd"}'), (3, 'broken')], len(INVENTORY), ['value'])})""")
def inventory_records(spark, sf):
    r = S.inventory(example(spark, sf, INVENTORY))
    row = lambda df, tag, a, b: df.select(F.lit(tag).alias("record"), c(a).alias("id"), b.alias("name"))
    return row(r["target"], "target", "id", c("name")).unionByName(row(r["relation"], "relation", "id", c("source"))).unionByName(row(r["rejected"], "rejected", "value", F.lit(None).cast("string")))


EXPORTED = ['{"source":"a","target":"b","kind":"call"}', '{"source":"a","target":"zz","kind":"type"}', '{"source":"zz","target":"a","kind":"type"}', '{"source":"a","target":"b","kind":"odd"}', "{", '{"source":"b","target":"a","kind":"reference"}']
PROBLEMS = [None, "unknown_target", "unknown_source", "unknown_kind", "malformed", None]


@query(f"SELECT problem, count(*) AS n FROM (SELECT coalesce({sql_pick(PROBLEMS, 'o_orderkey')}, 'relation') AS problem FROM orders) GROUP BY problem")
def exported_relations(spark, sf):
    r = S.exported_relations(example(spark, sf, EXPORTED), spark.createDataFrame([("a",), ("b",)], "id string"))
    return r["relation"].select(F.lit("relation").alias("problem")).unionByName(r["rejected"].select("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


IMPORTS = [("a/b/x@.ts", "./util"), ("a/b/x@.ts", "../lib/z"), ("a/b/x@.ts", "react"), ("a/x@.ts", "./b"), ("x@.ts", "./a/../top.js"), ("a/x@.ts", "./none")]
PRESENT = ["a/b/util.tsx", "a/b/util.js", "a/lib/z/index.ts", "a/lib/z.d.ts", "a/b/index.js", "top.js"]
RESOLVED = [(0, "a/b/x@.ts", "a/b/util.tsx"), (1, "a/b/x@.ts", "a/lib/z.d.ts"), (3, "a/x@.ts", "a/b/index.js"), (4, "x@.ts", "top.js")]


@query(sql_rows(RESOLVED, len(IMPORTS), ["path", "target"]))
def relative_imports(spark, sf):
    i = orders(spark, sf).select(filled(pick([p for p, _ in IMPORTS], order_key())).alias("path"), pick([n for _, n in IMPORTS], order_key()).alias("name"))
    return S.relative_imports(i, spark.createDataFrame([(p,) for p in PRESENT], "path string"))


#: name, file, id: of targets f (a.rs), g (a.rs, b.rs), h (c.rs, d.rs).
EVIDENCE = [("x::f@", "q.rs", "f@"), ("f@", "a.rs", "f@"), ("g@", "b.rs", "g@-b"), ("m::h@", "z.rs", None), ("none@", "a.rs", None)]


@query(sql_rows([(k, *e) for k, e in enumerate(EVIDENCE)], len(EVIDENCE), ["name", "file", "id"]))
def named_evidence(spark, sf):
    records = orders(spark, sf).select(filled(pick([e[0] for e in EVIDENCE], order_key())).alias("name"), pick([e[1] for e in EVIDENCE], order_key()).alias("file"))
    own = [("f", "", "a.rs"), ("g", "-a", "a.rs"), ("g", "-b", "b.rs"), ("h", "-c", "c.rs"), ("h", "-d", "d.rs")]
    rows = F.array(*[F.struct(F.concat(F.lit(n), order_key().cast("string"), F.lit(end)).alias("id"), F.concat(F.lit(n), order_key().cast("string")).alias("name"), F.lit(path).alias("path")) for n, end, path in own])
    return S.named_evidence(records, orders(spark, sf).select(F.explode(rows).alias("t")).select("t.*"))


IGNORED = [("x.log", True), ("d/keep.log", False), ("build/x", True), ("build", False), ("top.txt", True), ("d/top.txt", False), ("a/x.tmp", True), ("b/a/x.tmp", False), ("docs/a/b.bak", True), ("docs/b.bak", True), ("web/dist/x.js", True), ("dist/x.js", False), ("q1.c", True), ("q12.c", False), ("keep/me.rs", False)]
LINES = ["*.log", "!keep.log", "build/", "/top.txt", "a/*.tmp", "docs/**/*.bak", "q?.c", "# comment", "", "keep/"]


@query(f"SELECT o_orderkey, {sql_pick([i for _, i in IGNORED], 'o_orderkey')} AS ignored FROM orders")
def ignored_paths(spark, sf):
    every = [("web", "dist/"), *[("", x) for x in LINES], ("", "!keep/")]
    return orders(spark, sf).select("o_orderkey", S.is_ignored(pick([p for p, _ in IGNORED], order_key()), every).alias("ignored"))


@query("SELECT doc_id, doc_id % 3 = 0 AND text IS NOT NULL AS is_binary FROM documents")
def binary_sniff(spark, sf):
    d = B.t(spark, sf, "documents").withColumn("content", F.when(c("doc_id") % 3 == 0, F.concat(F.lit("x\x00"), "text")).when(c("doc_id") % 3 == 1, F.concat(F.repeat(F.lit("y"), 8192), F.lit("\x00"), "text")).otherwise(c("text")))
    return d.select("doc_id", F.coalesce(T.looks_binary("content"), F.lit(False)).alias("is_binary"))


SYNTAX = [
    ("a@.py", 'import os\nclass A(B):\n    """Doc."""\n    def f(self):\n        g()\n'), ("b@.py", "def ("), ("c@.rs", "/// Adds.\npub fn add() {}\nimpl T for S {}\n"), ("d@.ts", "export class C extends D {}\nimport x from './y'"), ("f@.xyz", ""),
    ("g@.rs", 'fn run(n: u32) {\n    start();\n    if (n > 1) { step(1, load(n)) } // skip(me)\n    log("fake(call)");\n}\n'),
]
FACTS = [
    (0, "a@.py", "module", "a@.py", None), (0, "a@.py", "import", "os", None), (0, "a@.py", "class", "A", "Doc."), (0, "a@.py", "extends", "A", "B"), (0, "a@.py", "callable", "A.f", None), (0, "a@.py", "call", "g", None),
    (2, "c@.rs", "callable", "add", "Adds."), (2, "c@.rs", "implements", "T", None), (3, "d@.ts", "class", "C", None), (3, "d@.ts", "extends", "D", None), (3, "d@.ts", "import", "./y", None), (4, "f@.xyz", "unsupported", "f@.xyz", "xyz"),
    (5, "g@.rs", "callable", "run", None), (5, "g@.rs", "call", "start", None), (5, "g@.rs", "call", "step", None), (5, "g@.rs", "call", "load", None), (5, "g@.rs", "call", "log", None),
]


@query(f"SELECT path, fact, name, detail FROM ({sql_rows(FACTS, len(SYNTAX), ['path', 'fact', 'name', 'detail'])}) UNION ALL SELECT 'b' || o_orderkey || '.py', 'failed', 'b' || o_orderkey || '.py', NULL FROM orders WHERE o_orderkey % {len(SYNTAX)} = 1")
def syntax_facts(spark, sf):
    files = orders(spark, sf).select(filled(pick([p for p, _ in SYNTAX], order_key())).alias("path"), pick([t for _, t in SYNTAX], order_key()).alias("text"))
    f = S.syntax(files)
    return f.select("path", "fact", "name", F.when(c("fact") != "failed", c("detail")).alias("detail"))


MANIFESTS = [
    ("@/package.json", '{"name":"web","dependencies":{"react":"^18"},"devDependencies":{"jest":"1"}}'), ("@/requirements.txt", "# top\nnumpy==1.2\npandas\n"), ("@/cargo-metadata.json", '{"packages":[{"name":"core","dependencies":[{"name":"serde","req":"^1"}]}]}'),
    ("@/pom.xml", "<project><artifactId>app</artifactId><dependencies><dependency><groupId>g</groupId><artifactId>junit</artifactId><version>4</version></dependency></dependencies></project>"), ("@/readme.md", "x"),
]
DEPENDENCIES = [(0, "@/package.json", "web", "react", "^18"), (0, "@/package.json", "web", "jest", "1"), (1, "@/requirements.txt", None, "numpy", "1.2"), (1, "@/requirements.txt", None, "pandas", None), (2, "@/cargo-metadata.json", "core", "serde", "^1"), (3, "@/pom.xml", "app", "junit", "4")]


@query(sql_rows(DEPENDENCIES, len(MANIFESTS), ["path", "package", "dependency", "version"]))
def manifest_dependencies(spark, sf):
    return S.manifests(orders(spark, sf).select(filled(pick([p for p, _ in MANIFESTS], order_key())).alias("path"), pick([t for _, t in MANIFESTS], order_key()).alias("text")))


DESIGNS = [
    ("docs/adr/@.md", '---\nid: ADR-@\nstatus: Accepted\nsupersedes: [ADR-1, "ADR-2"]\ngoverns:\n  - crates/core\n  - src/x\n---\n# Use a queue\n## Rules\n- Workers MUST retry.\n- It SHOULD log.\n- plain\n'),
    ("docs/x@.md", "# RFC 7: Streams\nstatus\n## Goals\nThe system SHALL NOT block.\n"), ("docs/y@.md", "---\nstatus: superseded by ADR-9.\n---\n# Requirements of y\nnothing\n"), ("notes/@.md", "just text"),
]
PARSED = [(0, "docs/adr/@.md", "ADR-@", "Use a queue", "adr", "accepted", None, "ADR-1|ADR-2", "crates/core|src/x", "2"), (1, "docs/x@.md", "RFC-7", "RFC 7: Streams", "rfc", "other", None, "", "", "1"), (2, "docs/y@.md", None, "Requirements of y", "requirements", "superseded", "adr-9", "", "", "0"), (3, "notes/@.md", None, "", "design", "other", None, "", "", "0")]
PARSED_COLS = ["path", "identifier", "title", "kind", "status", "superseded_by", "supersedes", "governs", "n_requirements"]


@query(sql_rows(PARSED, len(DESIGNS), PARSED_COLS))
def design_documents(spark, sf):
    files = orders(spark, sf).select(filled(pick([p for p, _ in DESIGNS], order_key())).alias("path"), filled(pick([t for _, t in DESIGNS], order_key())).alias("text"))
    a = D.parse_artifacts(files)
    return a.select("path", "identifier", "title", "kind", "status", "superseded_by", F.array_join("supersedes", "|").alias("supersedes"), F.array_join("governs", "|").alias("governs"), F.size("requirements").cast("string").alias("n_requirements"))


@query(sql_rows([(0, "docs/adr/@.md", "Rules/REQ-1", "must"), (0, "docs/adr/@.md", "Rules/REQ-2", "should"), (1, "docs/x@.md", "Goals/REQ-1", "shall")], len(DESIGNS), ["path", "id", "level"]))
def design_requirements(spark, sf):
    files = orders(spark, sf).select(filled(pick([p for p, _ in DESIGNS], order_key())).alias("path"), filled(pick([t for _, t in DESIGNS], order_key())).alias("text"))
    return D.parse_artifacts(files).select("path", F.explode("requirements").alias("r")).select("path", "r.id", "r.level")


@query("""SELECT o_orderkey AS id, section, part || o_orderkey AS text FROM orders JOIN (VALUES (0, 'safety', 'hold '), (0, 'panics', 'never '), (1, 'errors', 'io ')) AS v(k, section, part) ON k = o_orderkey % 3""")
def doc_contracts(spark, sf):
    doc = pick(["Adds.\n# Safety\nhold @\n\n# Panics\nnever @", "# Errors\nio @\n", "no sections @"], order_key())
    return V.contract_sections(orders(spark, sf).select(c("o_orderkey").alias("id"), filled(doc).alias("text")))


ANSWERS = ['```json\n{"a": 1,}\n```', 'Here: {"b": [1, 2', "no json", '{"c": "x"} and more']
REPAIRED = ['{"a": 1}', '{"b": [1, 2]}', None, '{"c": "x"}']


@query(f"SELECT o_orderkey::VARCHAR AS id, {sql_pick(REPAIRED, 'o_orderkey')} AS answer, CASE WHEN o_orderkey % 4 = 2 THEN 2 ELSE 1 END::INTEGER AS tries FROM orders")
def model_answers(spark, sf):
    prompts = orders(spark, sf).select(c("o_orderkey").alias("id"), pick(ANSWERS, order_key()).alias("prompt"))
    return V.review(prompts, lambda prompt: prompt, attempts=2).select("id", "answer", "tries")


#: Of 65 bytes one item leaves a budget of 60, of 150 three, of 500 all five.
@query("""SELECT o_orderkey AS scope, CASE o_orderkey % 3 WHEN 0 THEN 'c,i,k,r' WHEN 1 THEN 'c,k' ELSE '' END AS kept, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 5 END::INTEGER AS dropped FROM orders""")
def scope_trim(spark, sf):
    size = F.when(order_key() % 3 == 0, 13).when(order_key() % 3 == 1, 30).otherwise(100).cast("long")
    item = lambda cls, name: F.struct(F.lit(cls).alias("class"), F.lit(name).alias("name"), size.alias("bytes"))
    items = F.array(item("boundary_target", "b"), item("boundary_relation", "r"), item("internal", "i"), item("constituent", "k"), item("cycle", "c"))
    t = V.trim_scope(orders(spark, sf).select(c("o_orderkey").alias("scope"), items.alias("items")), 60)
    return t.select("scope", F.array_join("kept", ",").alias("kept"), "dropped")


@query("""SELECT '{"record":"summary","total":' || count(*) || '}' AS value FROM part UNION ALL SELECT '{"record":"finding_cluster","cluster":"' || p_brand || '","occurrences":' || count(*) || '}' FROM part GROUP BY p_brand""")
def report_lines(spark, sf):
    p = B.t(spark, sf, "part")
    return sinks.report_lines(p.agg(F.count(F.lit(1)).alias("total")), p.groupBy(c("p_brand").alias("cluster")).agg(F.count(F.lit(1)).alias("occurrences")))


@query("""WITH a AS (SELECT DISTINCT 'f' || (o_orderkey % 90) AS path FROM orders) SELECT path, CASE WHEN n < 60 AND n % 7 <> 0 THEN 'text ' || n END AS text, CASE WHEN n >= 70 THEN 'unknown_path' WHEN n >= 60 THEN 'missing_content' WHEN n % 7 = 0 THEN 'wrong_content' END AS problem FROM (SELECT path, substr(path, 2)::INTEGER AS n FROM a)""")
def snapshot_reads(spark, sf):
    n = c("id")
    text = F.concat(F.lit("text "), n.cast("string"))
    files = spark.range(70).select(F.concat(F.lit("f"), n.cast("string")).alias("path"), F.sha2(text.cast("binary"), 256).alias("content"))
    blobs = spark.range(60).select(F.sha2(text.cast("binary"), 256).alias("content"), F.when(n % 7 == 0, "torn").otherwise(text).alias("text"))
    return seams.source_access(files, blobs, orders(spark, sf).select(F.concat(F.lit("f"), (order_key() % 90).cast("string")).alias("path")))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 2 THEN 'unknown_tool' WHEN o_orderkey % 5 = 0 THEN 'forbidden_argument' WHEN o_orderkey % 7 = 0 THEN 'forbidden_environment' WHEN o_orderkey % 11 = 0 THEN 'too_long' WHEN o_orderkey % 13 = 0 THEN 'network' END AS denial FROM orders""")
def tool_runs(spark, sf):
    policy = seams.ToolPolicy({"cargo": ("check", "metadata"), "tsc": ("--noEmit",)})
    k = order_key()
    tool = pick(["cargo", "tsc", "rm"], k)
    verb = F.when(k % 5 == 0, "run").when(k % 3 == 0, "check").otherwise("--noEmit")
    env = F.when(k % 7 == 0, F.array(F.lit("PATH"), F.lit("TOKEN"))).otherwise(F.array(F.lit("PATH")))
    return orders(spark, sf).select(k.alias("id"), seams.tool_denial(policy, tool, F.array(verb), env, F.when(k % 11 == 0, 600).otherwise(5), k % 13 == 0).alias("denial"))


@query("SELECT o_orderkey AS work_id, CASE WHEN o_custkey % 4 <> 0 THEN o_custkey * 7 + o_orderkey % 3 END AS fingerprint FROM orders")
def resolved_fingerprints(spark, sf):
    work = orders(spark, sf).select(c("o_orderkey").alias("work_id"), c("o_custkey").alias("target"), (order_key() % 3).alias("policy"))
    return seams.resolve_fingerprints(work, lambda asked: asked.filter("target % 4 != 0").withColumn("fingerprint", c("target") * 7 + c("policy"))).select("work_id", "fingerprint")


@query("SELECT o_orderkey AS request, 'e' || n AS evidence FROM orders, (SELECT unnest(range(0, 3)) AS n) WHERE o_orderkey % 4 <> 0 AND n < o_orderkey % 4")
def expanded_evidence(spark, sf):
    r = orders(spark, sf).select(order_key().alias("request"), F.when(order_key() % 4 == 0, "out_of_sequence").alias("denial"))
    add = lambda df: df.select("request", F.explode(F.sequence(F.lit(0), (c("request") % 4 - 1).cast("int"))).alias("n")).select("request", F.concat(F.lit("e"), c("n").cast("string")).alias("evidence"))
    return seams.expand_evidence(r, add)


@query("SELECT o_orderkey FROM orders WHERE o_totalprice <= 100000 OR o_orderkey % 2 = 0")
def pruned_records(spark, sf):
    return seams.prune(orders(spark, sf), lambda df: (df["o_totalprice"] > 100_000) & (df["o_orderkey"] % 2 != 0))[0].select("o_orderkey")

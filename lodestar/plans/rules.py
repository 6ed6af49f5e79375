"""Queries over classifications, policies, clusters, budgets and denials.

Their fixtures deal fixed example values to the rows of a table so that every branch is reached. Where a rule is a list of
cases, the SQL holds each example's result as worked out by hand from the rule, not the rule in other words.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar import bridge as B
from lodestar.functions import text as T
from lodestar.functions.ids import derived_id
from lodestar.operators import digests as H
from lodestar.operators import planning as P
from lodestar.operators import policies as A
from lodestar.operators import queue as Q
from lodestar.operators import records as E
from lodestar.operators import report as R
from lodestar.plans.snapshots import FRAME, sql_id
from lodestar.registry import query
from lodestar.sources import repository as S

c = F.col


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(lit, v)) + "]"
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def sql_pick(values, key: str) -> str:
    """The example of a row in SQL."""
    return f"{lit(list(values))}[({key}) % {len(values)} + 1]"


def pick(values, key):
    """The example of a row in Spark."""
    values = list(values)
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def sql_values(rows, *names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({', '.join(names)})"


def order_key():
    """Made when asked for: a column needs a session."""
    return c("o_orderkey")


#: path: class.
FILES = {
    "target/x.rs": "generated_input", "src/a.rs": "source", "lib/b.tsx": "source", "m.cpp": "source", "a/Cargo.lock": "lockfile", "package-lock.json": "lockfile", "w/pnpm-lock.yaml": "lockfile",
    "yarn.lock": "unsupported", "a.yml": "configuration", "Cargo.toml": "configuration", "README.md": "design_document", "docs/x.mdx": "design_document", "i.rst": "design_document", "vendor/a.rs": "source",
    "vendor/LICENSE": "vendor", "x/vendor/logo.png": "vendor", "a.docx": "binary", "f.woff2": "binary", "notes.txt": "unsupported", "a.ini": "unsupported", "x.rb": "unsupported", "Makefile": "unsupported",
    "src/A.RS": "unsupported", ".md": "unsupported", "a/target/x.go": "source",
}


@query(f"SELECT o_orderkey, class FROM orders JOIN {sql_values(FILES.items(), 'path', 'class')} ON path = {sql_pick(FILES, 'o_orderkey')}")
def file_classes(spark, sf):
    return B.t(spark, sf, "orders").select("o_orderkey", T.file_class(pick(FILES, order_key())).alias("class"))


#: path, is a test's, is a benchmark's.
TESTS = [
    ("src/lib.rs", False, False), ("tests/a.rs", True, False), ("src/test/A.java", True, False), ("__tests__/a.js", True, False), ("spec/a.ts", True, False), ("x/testing/a.go", True, False), ("benches/b.rs", True, True),
    ("bench/b.rs", True, True), ("a/benchmark/b.py", True, True), ("benchmarks/b.py", True, True), ("src/test.rs", True, False), ("src/tests.rs", True, False), ("conftest.py", True, False), ("a/b_test.go", True, False),
    ("b_tests.py", True, False), ("x_bench.rs", True, True), ("test_a.py", True, False), ("test_a.rs", False, False), ("app.test.ts", True, False), ("app.spec.tsx", True, False), ("app.bench.ts", True, True),
    ("FooTest.java", True, False), ("FooTests.cs", True, False), ("FooBenchmark.java", True, True), ("FooIT.java", True, False), ("FooIT.py", False, False), ("contest.py", False, False), ("mytests/a.rs", False, False),
    ("tests", True, False), ("attest.kt", False, False),
]


@query(f"SELECT o_orderkey, is_test, is_bench FROM orders JOIN {sql_values(TESTS, 'path', 'is_test', 'is_bench')} ON path = {sql_pick([t[0] for t in TESTS], 'o_orderkey')}")
def test_paths(spark, sf):
    path = pick([t[0] for t in TESTS], order_key())
    return B.t(spark, sf, "orders").select("o_orderkey", T.is_test_path(path).alias("is_test"), T.is_bench_path(path).alias("is_bench"))


#: file below a root, ecosystem (null: no marker).
MARKERS = [("Cargo.toml", "rust"), ("package.json", "typescript"), ("tsconfig.json", "typescript"), ("setup.cfg", "python"), ("requirements.txt", "python"), ("pom.xml", "java"), ("build.gradle.kts", "java"), ("meson.build", "c"), ("go.mod", "go"), ("readme.md", None)]
FOLDERS = ["", "a/", "a/b/", "node_modules/x/", "target/x/", ".git/x/", "x/build/", "1/2/3/4/5/6/7/8/", "1/2/3/4/5/6/7/8/9/"]


@query(f"""SELECT DISTINCT rtrim(f, '/') || '/' || (o_custkey % 50) AS root, eco AS ecosystem FROM (SELECT o_custkey, {sql_pick(FOLDERS[:6], 'o_orderkey')} AS f, {sql_pick([m[0] for m in MARKERS], 'o_custkey')} AS m FROM orders)
JOIN {sql_values(MARKERS, 'm', 'eco')} USING (m) WHERE eco IS NOT NULL AND f IN ('', 'a/', 'a/b/')""")
def ecosystem_roots(spark, sf):
    path = F.concat(F.regexp_replace(pick(FOLDERS[:6], order_key()), "/$", ""), F.lit("/"), (c("o_custkey") % 50).cast("string"), F.lit("/"), pick([m[0] for m in MARKERS], c("o_custkey")))
    return S.ecosystem_roots(B.t(spark, sf, "orders").select(path.alias("path"))).select("root", "ecosystem")


#: extension: adapter.
ADAPTERS = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "py": "python", "java": "java", "go": None, "md": None, "RS": None}


@query(f"SELECT o_orderkey, adapter FROM orders JOIN {sql_values(ADAPTERS.items(), 'e', 'adapter')} ON e = {sql_pick(ADAPTERS, 'o_orderkey')} WHERE adapter IS NOT NULL")
def adapters_of_files(spark, sf):
    files = B.t(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("src/f."), pick(ADAPTERS, order_key())).alias("path"))
    return S.implied_adapters(files, "o_orderkey")


@query(f"SELECT DISTINCT o_custkey % 5 AS inventory, adapter FROM orders JOIN {sql_values(ADAPTERS.items(), 'e', 'adapter')} ON e = {sql_pick(ADAPTERS, 'o_orderkey')} WHERE adapter IS NOT NULL AND NOT (adapter = 'rust' OR (adapter = 'java' AND o_custkey % 5 < 2))")
def missing_adapters(spark, sf):
    files = B.t(spark, sf, "orders").select((c("o_custkey") % 5).alias("inventory"), F.concat(F.lit("src/f."), pick(ADAPTERS, order_key())).alias("path"))
    present = spark.range(5).select(c("id").alias("inventory"), F.lit("rust").alias("adapter")).unionByName(spark.range(2).select(c("id").alias("inventory"), F.lit("java").alias("adapter")))
    return S.missing_adapters(files, present, "inventory")


# -- policies: the class, visibility and inventory of each order's target

KINDS = ["workspace", "package", "module", "type", "callable", "constant", "test", "file", "symbol", "macro"]
LANG = "CASE WHEN o_orderkey % 10 = 9 THEN 'rust' END"
PROFILE = f"""t AS (SELECT o_orderkey AS id, {sql_pick(['workspace', 'package', 'module', 'type', 'callable', 'constant', 'test', 'file', 'other', 'language_specific'], 'o_orderkey')} AS class,
 {sql_pick(A.VISIBILITIES, 'o_custkey')} AS visibility, CASE WHEN o_orderkey % 13 = 0 THEN 'failed' ELSE 'represented' END AS inventory FROM orders)"""


def _profiles(spark, sf):
    lang = F.when(order_key() % 10 == 9, "rust")
    inv = F.when(order_key() % 13 == 0, "failed").otherwise("represented")
    return B.t(spark, sf, "orders").select(order_key().alias("id"), A.target_class(pick(KINDS, order_key()), lang).alias("class"), pick(A.VISIBILITIES, c("o_custkey")).alias("visibility"), inv.alias("inventory"))


@query(f"WITH {PROFILE} SELECT * FROM t")
def target_profile(spark, sf):
    return _profiles(spark, sf)


EXECUTABLE = """CASE WHEN visibility = 'inherited' THEN 'pending' WHEN class NOT IN ('callable', 'type', 'module', 'constant', 'test') THEN 'not_applicable' WHEN visibility = 'not_applicable' THEN 'not_applicable' ELSE 'applicable' END"""
STATES = {
    "correctness": EXECUTABLE, "optimization": EXECUTABLE, "architecture": "CASE WHEN class IN ('workspace', 'package', 'module') THEN 'applicable' ELSE 'not_applicable' END",
    "documentation": """CASE WHEN class IN ('language_specific', 'other') OR visibility = 'inherited' THEN 'pending' WHEN class = 'test' THEN 'not_applicable' WHEN visibility = 'public' THEN 'applicable'
     WHEN visibility <> 'unknown' THEN 'not_applicable' WHEN class IN ('workspace', 'package', 'file') THEN 'applicable' ELSE 'pending' END""",
    "internal_documentation": """CASE WHEN class NOT IN ('module', 'type', 'callable', 'constant') THEN 'not_applicable' WHEN visibility IN ('restricted', 'private') THEN 'applicable' WHEN visibility IN ('unknown', 'inherited') THEN 'pending' ELSE 'not_applicable' END""",
    "conformance": """CASE WHEN class = 'test' THEN 'applicable' WHEN class IN ('constant', 'other', 'language_specific') OR visibility = 'not_applicable' THEN 'not_applicable' ELSE 'applicable' END""",
    "conformance_containers": """CASE WHEN class IN ('workspace', 'package', 'module') AND visibility <> 'not_applicable' THEN 'applicable' ELSE 'not_applicable' END""",
}


def _policy(name):
    def run(spark, sf):
        return A.applicable(_profiles(spark, sf), A.rule_table(spark, name), A.UNMATCHED[name])

    run.__name__ = f"applicability_{name}"
    query(f"WITH {PROFILE} SELECT id, CASE WHEN inventory <> 'represented' THEN 'pending' ELSE {STATES[name]} END AS state FROM t")(run)


for _name in STATES:
    _policy(_name)


#: kind, language, maintainability's class, testing's class, for targets that are no recognised test code.
OWN_KINDS = [
    ("workspace", None, "unknown", "workspace"), ("package", None, "unknown", "package"), ("module", None, "module", "module"), ("file", None, "unknown", "module"), ("type", None, "type", "member"), ("callable", None, "callable", "member"),
    ("constant", None, "unknown", "member"), ("test", None, "unknown", "test_code"), ("symbol", None, "unknown", "unknown"), ("fn_item", "rust", "callable", "member"), ("AsyncMethod", "ts", "callable", "member"),
    ("StructDef", "rust", "type", "member"), ("trait", "rust", "type", "member"), ("ModuleDecl", "ts", "module", "module"), ("namespace", "cpp", "module", "module"), ("PackageDecl", "java", "module", "unknown"),
    ("test_fn", "rust", "callable", "test_code"), ("benchGroup", "rust", "unknown", "test_code"), ("macro", "rust", "unknown", "unknown"),
]
KIND_OF = f"{sql_pick([k[0] for k in OWN_KINDS], 'o_orderkey')}"
REASON = """CASE m WHEN 'callable' THEN 'code that can be called: size and branching are reviewed' WHEN 'type' THEN 'a declared type: how its parts hold together is reviewed'
 WHEN 'module' THEN 'a declared module: its seams and imports are reviewed' ELSE 'of no class that is reviewed' END"""


def _own_kinds(spark, sf):
    return B.t(spark, sf, "orders").select(order_key().alias("id"), pick([k[0] for k in OWN_KINDS], order_key()).alias("kind"), pick([k[1] for k in OWN_KINDS], order_key()).alias("language"), c("o_custkey"))


@query(f"SELECT o_orderkey AS id, CASE WHEN m = 'unknown' THEN 'not_applicable' ELSE 'applicable' END AS state, {REASON} AS reason FROM orders JOIN {sql_values(OWN_KINDS, 'kind', 'language', 'm', 't')} ON kind = {KIND_OF}")
def applicability_maintainability(spark, sf):
    return A.maintainable(_own_kinds(spark, sf))


TESTING = f"tc AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 7 = 0 THEN 'test_code' WHEN o_custkey % 50 = 1 THEN 'project' ELSE t END AS class, CASE WHEN o_custkey % 3 = 0 THEN 'm1' END AS split_from FROM orders JOIN {sql_values(OWN_KINDS, 'kind', 'language', 'm', 't')} ON kind = {KIND_OF})"


def _testing(spark, sf):
    k = c("o_custkey")
    cls = F.when((k % 50 == 1) & (k % 7 != 0), "project").otherwise(A.testing_class("kind", "language", k % 7 == 0))
    return _own_kinds(spark, sf).select("id", cls.alias("class"), F.when(k % 3 == 0, "m1").alias("split_from"))


@query(f"WITH {TESTING} SELECT id, class FROM tc")
def testing_class(spark, sf):
    return _testing(spark, sf).select("id", "class")


@query(f"""WITH {TESTING} SELECT id, CASE WHEN class IN ('module', 'package', 'project') OR (class = 'member' AND split_from IS NOT NULL) THEN 'applicable' ELSE 'not_applicable' END AS state,
CASE class WHEN 'module' THEN 'unit' WHEN 'member' THEN 'unit' WHEN 'package' THEN 'library' WHEN 'project' THEN 'project' END AS level FROM tc""")
def applicability_testing(spark, sf):
    return A.testable(_testing(spark, sf))


def _plan_sql(name):
    return f"""WITH {PROFILE}, ev AS (SELECT l_orderkey AS id, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1)
SELECT {sql_id('work-item', f"'{name}-review'", "'s1'", "'c1'", 't.id::VARCHAR', f"'{name}'", "'1'")} AS unit, t.id, class, visibility, coalesce(n, 0) AS n_evidence FROM t LEFT JOIN ev ON t.id = ev.id WHERE inventory = 'represented' AND ({STATES[name]}) = 'applicable'"""


def _planned(name):
    def run(spark, sf):
        t = _profiles(spark, sf)
        evidence = B.t(spark, sf, "lineitem").select(c("l_orderkey").alias("target"), c("l_partkey").alias("evidence"))
        return A.plan(t, A.applicable(t, A.rule_table(spark, name), A.UNMATCHED[name]), name, "1", "s1", "c1", evidence)

    run.__name__ = f"plan_{name}"
    query(_plan_sql(name))(run)


for _name in ("documentation", "correctness", "optimization", "conformance"):
    _planned(_name)


@query(f"""WITH m AS (SELECT o_orderkey AS id, m, {sql_pick(A.VISIBILITIES, 'o_custkey')} AS visibility FROM orders JOIN {sql_values(OWN_KINDS, 'kind', 'language', 'm', 't')} ON kind = {KIND_OF})
SELECT {sql_id('work-item', "'maintainability-review'", "'s1'", "'c1'", 'id::VARCHAR', "'maintainability'", "'1'")} AS unit, id, m AS class, visibility, 0::BIGINT AS n_evidence FROM m WHERE m <> 'unknown'""")
def plan_maintainability(spark, sf):
    t = _own_kinds(spark, sf).withColumn("class", A.maintainability_class("kind", "language")).withColumn("visibility", pick(A.VISIBILITIES, c("o_custkey")))
    return A.plan(t, A.maintainable(t), "maintainability", "1", "s1", "c1")


@query(f"""WITH {TESTING}, u AS (SELECT * FROM tc WHERE class IN ('module', 'package', 'project') OR (class = 'member' AND split_from IS NOT NULL)),
sg AS (SELECT l_orderkey AS id, l_partkey AS signal, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey) AS rn FROM (SELECT DISTINCT l_orderkey, l_partkey, l_quantity FROM lineitem))
SELECT u.id, class, count(signal) AS signals, min(signal) AS least FROM u LEFT JOIN sg ON u.id = sg.id AND rn <= 3 GROUP BY ALL""")
def plan_testing(spark, sf):
    from pyspark.sql import Window

    t = _testing(spark, sf)
    units = t.join(A.testable(t).filter("state = 'applicable'"), "id", "left_semi")
    l = B.t(spark, sf, "lineitem").select(c("l_orderkey").alias("id"), c("l_partkey").alias("signal"), "l_quantity").distinct()
    top = l.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(c("l_quantity").desc(), "signal"))).filter("rn <= 3")
    return units.join(top, "id", "left").groupBy("id", "class").agg(F.count("signal").alias("signals"), F.min("signal").alias("least"))


# -- admission

DECIDED = "d AS (SELECT id, id LIKE '%7' AS direct, id LIKE '%3' OR id LIKE '%7' AS transitive, id LIKE '%5' OR id LIKE '%7' AS chosen FROM tg)"
DECISION = {
    "full": "CASE WHEN direct THEN 'admitted_directly_changed' WHEN transitive THEN 'admitted_transitively_impacted' ELSE 'admitted_full' END",
    "ci_lite": "CASE WHEN direct THEN 'admitted_directly_changed' WHEN transitive THEN 'admitted_transitively_impacted' ELSE 'filtered_unaffected_ci_lite' END",
    "targeted": "CASE WHEN chosen THEN 'admitted_targeted' ELSE 'filtered_not_in_targeted_set' END",
}


def _admitted(spark, sf, mode):
    tg = B.targets(spark, sf)
    like = lambda *ends: tg.filter(F.substring("id", -1, 1).isin(*ends)).select("id")
    return P.admission(tg, like("7"), like("3", "7"), mode, like("5", "7"))


def _admission(mode):
    def run(spark, sf):
        return _admitted(spark, sf, mode).select("id", "decision", "admitted")

    run.__name__ = f"admission_{mode}"
    query(f"WITH {B.SQL_TARGETS}, {DECIDED}, x AS (SELECT id, {DECISION[mode]} AS decision FROM d) SELECT id, decision, decision LIKE 'admitted%' AS admitted FROM x")(run)


for _mode in DECISION:
    _admission(_mode)


@query(f"WITH {B.SQL_TARGETS}, {DECIDED} SELECT count(*) AS evaluated, count(*) FILTER (transitive) AS admitted, count(*) FILTER (NOT transitive) AS filtered, count(*) FILTER (direct) AS direct, count(*) FILTER (transitive AND NOT direct) AS transitive FROM d")
def admission_stats(spark, sf):
    return P.admission_stats(_admitted(spark, sf, "ci_lite"))


@query(f"WITH {B.SQL_TARGETS}, {DECIDED} SELECT l_orderkey, l_linenumber, 'part:' || l_partkey AS target FROM lineitem WHERE 'part:' || l_partkey IN (SELECT id FROM d WHERE chosen)")
def admitted_units(spark, sf):
    units = B.t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("part:"), c("l_partkey").cast("string")).alias("target"))
    return P.admitted_units(units, _admitted(spark, sf, "targeted")).select("l_orderkey", "l_linenumber", "target")


# -- backlog and errors

#: title, description, dimension, category.
NOTES = [
    ("Missing TODO", "here", "x", "missing_todo"), ("Code without a todo", "", "x", "missing_todo"), ("todo", "has a comment", "x", "missing_todo"), ("todo alone", "later", "x", None), ("Scope gap", "in x", "x", "scope_gap"),
    ("Breaks an INVARIANT", "", "x", "scope_gap"), ("a stub", "", "x", "stub_or_unimplemented"), ("calls", "todo!() at once", "x", "stub_or_unimplemented"), ("unimplemented!(", "", "x", "stub_or_unimplemented"),
    ("placeholder", "value", "x", "stub_or_unimplemented"), ("returns", "a Mock value", "x", "stub_or_unimplemented"), ("incomplete", "", "x", "scope_gap"), ("unimplemented part", "", "x", "scope_gap"),
    ("is not yet implemented", "", "x", "scope_gap"), ("future work", "", "x", "scope_gap"), ("coverage gap", "", "x", "general_gap"), ("may panic", "", "failure_paths", "general_gap"), ("may panic", "", "x", None),
    ("unhandled error", "", "failure_paths", "general_gap"), ("failure path", "", "x", None), ("fine", "all good", "failure_paths", None), ("fixme", "", "x", None),
]
SEVERITY = ["critical", "high", "medium", "low", "note"]


def _notes(spark, sf):
    title, words, dim = (pick([n[i] for n in NOTES], order_key()) for i in range(3))
    return B.t(spark, sf, "orders").select("o_orderkey", R.backlog_class(title, words, F.array(dim)).alias("category"), pick(SEVERITY, c("o_custkey")).alias("severity"))


NOTED = f"n AS (SELECT o_orderkey, {sql_pick([n[3] for n in NOTES], 'o_orderkey')} AS category, o_custkey % 5 AS priority FROM orders)"


@query(f"WITH {NOTED} SELECT o_orderkey, category, priority::INTEGER AS priority FROM n WHERE category IS NOT NULL")
def backlog_items(spark, sf):
    return _notes(spark, sf).filter("category is not null").select("o_orderkey", "category", R.backlog_priority("severity").alias("priority"))


@query(f"WITH {NOTED} SELECT CASE category WHEN 'stub_or_unimplemented' THEN 0 WHEN 'scope_gap' THEN 1 WHEN 'missing_todo' THEN 2 ELSE 3 END AS position, category, count(*) AS items, count(*) FILTER (priority < 2) AS urgent FROM n WHERE category IS NOT NULL GROUP BY ALL")
def backlog(spark, sf):
    return R.backlog_groups(_notes(spark, sf))


#: message, category.
ERRORS = [
    ("got invalid candidates x", "Candidate Schema Mismatch"), ("a policy candidate contract violation", "Candidate Schema Mismatch"), ("invalid provider output: provider unavailable", "Invalid Provider Output"),
    ("provider unavailable now", "Provider Unavailable"), ("budget exceeded", "Budget Exceeded"), ("over token budget", "Budget Exceeded"), ("work stalled", "Work Stalled"), ("lease expired", "Work Stalled"),
    ("invalid policy assessment", "Policy Assessment Invalid"), ("Budget Exceeded", "Other Work Failure"), ("timeout", "Other Work Failure"), ("", "Other Work Failure"),
]


@query(f"""WITH {B.SQL_WORK}, {B.SQL_EVENTS}, f AS (SELECT work_id, {sql_pick([e[1] for e in ERRORS], 'work_id')} AS category FROM wk WHERE state = 'failed'),
e AS (SELECT work_id, count(*) AS n FROM ev WHERE kind IN ('retry_scheduled', 'failed') GROUP BY work_id) SELECT category, count(*) AS failures, coalesce(sum(n), 0)::BIGINT AS events FROM f LEFT JOIN e ON f.work_id = e.work_id GROUP BY category""")
def error_log(spark, sf):
    failed = B.work(spark, sf).filter("state = 'failed'").select("work_id", pick([e[0] for e in ERRORS], c("work_id")).alias("last_error"))
    return R.error_log(failed, B.events(spark, sf))


# -- clusters of seven policies

CLAIM = """cl AS (SELECT l_orderkey || '.' || l_linenumber AS id, 'Issue ' || (l_partkey % 5) AS title, CASE WHEN l_suppkey % 2 = 0 THEN 'What  it Does' ELSE 'what it does' END AS description, ['d' || (l_suppkey % 3), 'a', 'd' || (l_suppkey % 2)] AS dimensions,
 ['e' || (l_partkey % 4), 'e' || (l_linenumber % 2)] AS citations, 'k' || (l_partkey % 3) AS k1, 'q' || (l_suppkey % 4) AS k2, 'r' || (l_linenumber % 2) AS k3, 'f' || (l_partkey % 6) AS finding, CASE WHEN l_quantity < 10 THEN 'disputed' ELSE 'corroborated' END AS verification FROM lineitem)"""
EXTRA = {"documentation": 0, "correctness": 2, "testing": 2, "optimization": 2, "maintainability": 2, "conformance": 3, "architecture": 3}


def _claims(spark, sf, policy):
    n = lambda col, k: (c(col) % k).cast("string")
    tag = lambda t, col, k: F.concat(F.lit(t), n(col, k))
    extra = [tag("k", "l_partkey", 3), tag("q", "l_suppkey", 4), tag("r", "l_linenumber", 2)]
    return B.t(spark, sf, "lineitem").select(
        F.concat_ws(".", c("l_orderkey").cast("string"), c("l_linenumber").cast("string")).alias("id"), tag("Issue ", "l_partkey", 5).alias("title"),
        F.when(c("l_suppkey") % 2 == 0, "What  it Does").otherwise("what it does").alias("description"), F.array(tag("d", "l_suppkey", 3), F.lit("a"), tag("d", "l_suppkey", 2)).alias("dimensions"),
        F.array(tag("e", "l_partkey", 4), tag("e", "l_linenumber", 2)).alias("citations"), tag("f", "l_partkey", 6).alias("finding"), F.when(c("l_quantity") < 10, "disputed").otherwise("corroborated").alias("verification"),
        *[x.alias(name) for x, name in zip(extra, R.CLAIM_EXTRA[policy])],
    )


def _clusters(policy):
    def run(spark, sf):
        return R.policy_clusters(_claims(spark, sf, policy), policy)

    run.__name__ = f"clusters_{policy}"
    listed = lambda x: f"array_to_string(list_sort(list_distinct({x})), chr(31))"
    flat = (lambda x: f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))") if policy == "documentation" else (lambda x: x)
    parts = ["finding", "description", listed("dimensions")] if policy == "architecture" else [flat("title"), flat("description"), listed("dimensions"), listed("citations")]
    parts += ["k1", "k2", "k3"][: EXTRA[policy]]
    extra = ", CASE WHEN count(DISTINCT verification) > 1 THEN 'disputed' ELSE min(verification) END AS verification" if policy == "architecture" else ""
    query(f"WITH {CLAIM} SELECT {sql_id('cluster', *parts)} AS cluster, count(*) AS occurrences, min(id) AS representative{extra} FROM cl GROUP BY 1")(run)


for _name in EXTRA:
    _clusters(_name)


@query(f"""WITH {B.SQL_WORK}, {CLAIM}, r AS (SELECT wk.*, {sql_pick(['passed', 'candidate_findings', 'unable_to_verify'], 'work_id')} AS result FROM wk), k AS (SELECT count(*) AS n, count(DISTINCT (title, lower(regexp_replace(description, '\\s+', ' ', 'g')), list_sort(list_distinct(dimensions)), list_sort(list_distinct(citations)))) AS u FROM cl)
SELECT count(*) AS total, {', '.join(f"count(*) FILTER (state = '{s}') AS {s}" for s in Q.STATES)}, {', '.join(f"count(*) FILTER (state = 'succeeded' AND result = '{x}') AS {x}" for x in ('passed', 'candidate_findings', 'unable_to_verify'))}, (SELECT n FROM k) AS occurrences, (SELECT n - u FROM k) AS duplicates FROM r""")
def report_summary(spark, sf):
    w = B.work(spark, sf).withColumn("result", F.when(c("state") == "succeeded", pick(["passed", "candidate_findings", "unable_to_verify"], c("work_id"))))
    return R.summary(w, R.policy_clusters(_claims(spark, sf, "documentation"), "documentation"))


@query(f"""WITH {CLAIM}, p AS (SELECT id, 'pol' || (length(id) % 3) AS policy, {sql_pick(SEVERITY, 'length(id) + length(title)')} AS severity, dimensions FROM cl) SELECT id FROM p WHERE policy = 'pol1' AND severity = 'high' AND list_contains(dimensions, 'd1')""")
def report_retain(spark, sf):
    f = _claims(spark, sf, "documentation")
    f = f.select("id", F.concat(F.lit("pol"), (F.length("id") % 3).cast("string")).alias("policy"), pick(SEVERITY, F.length("id") + F.length("title")).alias("severity"), "dimensions")
    return R.retain(f, "pol1", "d1", "high").select("id")


MATCHED = """SELECT CASE o_orderkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'resolved' ELSE 'persistent' END AS category, {sev} AS severity, {adj} AS adjudication FROM orders"""
ADJ = ["unreviewed", "accepted", "rejected", "deferred"]


@query(f"""WITH m AS ({MATCHED.format(sev=sql_pick(SEVERITY, 'o_custkey'), adj=sql_pick(ADJ, 'o_orderkey'))}), n AS (SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) AS total, count(*) FILTER (adjudication = 'unreviewed') AS un FROM m WHERE category = 'new')
SELECT * FROM (SELECT 'max_new_critical' AS rule, 1::BIGINT AS "limit", critical AS found FROM n UNION ALL SELECT 'max_new_high', 1000000, high FROM n UNION ALL SELECT 'max_new_medium', 2, medium FROM n UNION ALL SELECT 'max_new_total', 3, total FROM n UNION ALL SELECT 'max_new_unadjudicated', 0, un FROM n) WHERE found > "limit" """)
def strict_gate_check(spark, sf):
    cat = F.when(order_key() % 3 == 0, "new").when(order_key() % 3 == 1, "resolved").otherwise("persistent")
    m = B.t(spark, sf, "orders").select(cat.alias("category"), pick(SEVERITY, c("o_custkey")).alias("severity"), pick(ADJ, order_key()).alias("adjudication"))
    return R.gate(m, 1, 1_000_000, 2, 3, unadjudicated=True)


# -- fingerprints and keys

FIELDS = {
    "snapshot": "'s1'", "target": "p_name", "policy": "p_brand", "target_hash": "sha256(p_name)", "implementation_hash": "sha256(p_type)", "documentation_hash": "sha256(p_brand)", "downstream_hash": "sha256('d')", "upstream_hash": "sha256('u')",
    "behavior_hash": "sha256('b')", "test_hash": "sha256('t')", "design_hash": "sha256('g')", "policy_version": "'v1'", "prompt_version": "'p1'", "workflow_hash": "sha256('w')", "actor_versions": "['a' || (p_size % 3), 'b']", "model_reuse_class": "'fast'",
    "evidence_builder_version": "'e1'", "extension_versions": "['x']", "toolchain_hash": "sha256('tool')",
}


def _fingerprints(spark, sf):
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    a = {"snapshot": F.lit("s1"), "target": c("p_name"), "policy": c("p_brand"), "target_hash": sha(c("p_name")), "implementation_hash": sha(c("p_type")), "documentation_hash": sha(c("p_brand"))}
    a |= {k: sha(F.lit(v)) for k, v in (("downstream_hash", "d"), ("upstream_hash", "u"), ("behavior_hash", "b"), ("test_hash", "t"), ("design_hash", "g"), ("workflow_hash", "w"), ("toolchain_hash", "tool"))}
    a |= {k: F.lit(v) for k, v in (("policy_version", "v1"), ("prompt_version", "p1"), ("model_reuse_class", "fast"), ("evidence_builder_version", "e1"))}
    a |= {"actor_versions": F.array(F.concat(F.lit("a"), (c("p_size") % 3).cast("string")), F.lit("b")), "extension_versions": F.array(F.lit("x"))}
    return B.t(spark, sf, "part").select("p_partkey", "p_size", *[v.alias(k) for k, v in a.items()])


def _fingerprint_sql():
    parts = ["encode('review_fingerprint:v1' || chr(0))"]
    for k, v in FIELDS.items():
        if k.endswith("_versions"):
            parts += [f"encode(array_to_string(list_transform({v}, lambda x: x || chr(0)), ''))", "'\\xFF'::BLOB"]
        else:
            parts.append(f"encode({v} || chr(0))" if k != "toolchain_hash" else f"encode({v})")
    return " || ".join(parts)


@query(f"SELECT p_partkey, sha256(sha256({_fingerprint_sql()})) AS fingerprint FROM part")
def composite_fingerprint(spark, sf):
    return _fingerprints(spark, sf).select("p_partkey", H.fingerprint().alias("fingerprint"))


CHANGES = [("target", 6, "identity"), ("implementation_hash", 4, "content"), ("design_hash", 9, "content"), ("actor_versions", 5, "environment"), ("toolchain_hash", 7, "environment")]


@query(" UNION ALL ".join(f"SELECT p_partkey, '{g}' AS grp, '{f}' AS field FROM part WHERE p_partkey % {n} = 0" for f, n, g in CHANGES))
def fingerprint_diff(spark, sf):
    names = [*H.IDENTITY, *H.CONTENT, *H.ENVIRONMENT]
    every = {f: n for f, n, _ in CHANGES}
    other = lambda f: F.when(c("p_partkey") % every[f] == 0, F.array(F.lit("z")) if f == "actor_versions" else F.lit("z")).otherwise(c(f)) if f in every else c(f)
    pairs = _fingerprints(spark, sf).select("p_partkey", F.struct(*names).alias("before"), F.struct(*[other(f).alias(f) for f in names]).alias("after"))
    return H.fingerprint_diff(pairs, "p_partkey")


@query(f"""WITH {B.SQL_WORK} SELECT work_id, {sql_id("work", "run::VARCHAR", "target::VARCHAR", "policy", "'1'")} AS work_key,
sha256({' || '.join(FRAME.format(p) for p in ("'logical-outcome-v1'", "'s1'", "run::VARCHAR", "work_id::VARCHAR", "policy"))} || from_hex('0000000000000004') || from_hex(printf('%08x', attempts)) || {FRAME.format("lower('AB' || (work_id % 7))")}) AS outcome_key FROM wk""")
def work_keys(spark, sf):
    s = lambda name: c(name).cast("string")
    key = H.outcome_key(F.lit("s1"), s("run"), s("work_id"), c("policy"), c("attempts"), F.concat(F.lit("AB"), (c("work_id") % 7).cast("string")))
    return B.work(spark, sf).select("work_id", derived_id("work", "run", "target", "policy", F.lit("1")).alias("work_key"), key.alias("outcome_key"))


# -- budgets and denials

PACK = "c AS (SELECT source, doc_id AS id, lang = 'en' AS required, CASE lang WHEN 'de' THEN 3 WHEN 'fr' THEN 2 ELSE 1 END AS priority, 'k' || (doc_id % 3) AS kind, octet_length(encode(text))::BIGINT AS bytes, ceil(octet_length(encode(text)) / 5.0)::BIGINT AS tokens, doc_id % 4 AS depth FROM documents)"
FITS = "f.used + o.bytes <= 60000 AND f.spent + o.tokens <= 9000 AND f.items < 32"
PACKED = f"""o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY NOT required, -priority, kind, id) AS rn FROM c WHERE depth <= 2{{more}}),
f AS (SELECT source, 0::BIGINT AS rn, 0::BIGINT AS used, 0::BIGINT AS spent, 0::BIGINT AS items, NULL::BIGINT AS id, false AS took FROM (SELECT DISTINCT source FROM o)
 UNION ALL SELECT o.source, o.rn, f.used + CASE WHEN {FITS} THEN o.bytes ELSE 0 END, f.spent + CASE WHEN {FITS} THEN o.tokens ELSE 0 END, f.items + CASE WHEN {FITS} THEN 1 ELSE 0 END, o.id, {FITS} FROM f JOIN o ON f.source = o.source AND o.rn = f.rn + 1)"""


def _candidates(spark, sf):
    size = F.octet_length("text").cast("long")
    return B.t(spark, sf, "documents").select(
        "source", c("doc_id").alias("id"), (c("lang") == "en").alias("required"), F.when(c("lang") == "de", 3).when(c("lang") == "fr", 2).otherwise(1).alias("priority"),
        F.concat(F.lit("k"), (c("doc_id") % 3).cast("string")).alias("kind"), size.alias("bytes"), F.ceil(size / 5.0).cast("long").alias("tokens"), (c("doc_id") % 4).alias("depth"), c("doc_id"), c("text"),
    )


@query(f"WITH RECURSIVE {PACK}, {PACKED.format(more='')} SELECT source, (items - 1)::INTEGER AS position, id FROM f WHERE took")
def packing(spark, sf):
    return P.greedy_pack(_candidates(spark, sf), "source", 60_000, 32, 9000, 2)


AVAIL = ["available", "available", "summarized", "partial", "unavailable"]
PACKAGE = f"""WITH RECURSIVE {PACK}, a AS (SELECT *, {sql_pick(AVAIL, 'id')} AS availability FROM c), {PACKED.format(more=" AND kind <> 'k2' AND id % 5 <> 4")},
pk AS (SELECT source, id, CASE WHEN availability = 'unavailable' THEN 'unavailable' WHEN kind = 'k2' THEN 'omitted_policy' WHEN id NOT IN (SELECT id FROM f WHERE took) THEN 'omitted_budget' WHEN availability = 'available' THEN 'included' ELSE availability END AS disposition FROM a)"""


def _package(spark, sf):
    return P.evidence_package(_candidates(spark, sf).withColumn("availability", pick(AVAIL, c("doc_id"))), "source", ["k0", "k1"], 60_000, 32, 9000, 2)


@query(PACKAGE + " SELECT * FROM pk")
def evidence_package(spark, sf):
    return _package(spark, sf).select("source", "id", "disposition")


@query(PACKAGE + " SELECT pk.source, pk.id, row_number() OVER (PARTITION BY pk.source ORDER BY pk.id) - 1 AS position, CASE WHEN disposition <> 'summarized' THEN sha256(text) END AS detail FROM pk JOIN documents ON pk.id = doc_id WHERE disposition IN ('included', 'summarized', 'partial')")
def context_frame(spark, sf):
    stored = B.t(spark, sf, "documents").select(c("doc_id").alias("id"), F.sha2(c("text").cast("binary"), 256).alias("detail"))
    return P.context_frame(_package(spark, sf), stored, "source").withColumn("position", c("position").cast("long"))


@query("SELECT doc_id AS id, sha256(text) AS hash, octet_length(encode(text))::BIGINT AS bytes, ceil(octet_length(encode(text)) / 4.0)::BIGINT AS tokens FROM documents WHERE text IS NOT NULL")
def evidence_catalog(spark, sf):
    return P.evidence_catalog(B.t(spark, sf, "documents").filter("text is not null").select(c("doc_id").alias("id"), c("text").alias("detail")))


REQ = """r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 31 = 0 THEN ' ' ELSE 'why' END AS rationale, CASE WHEN o_orderkey % 29 = 0 THEN [] ELSE ['t' || (o_custkey % 5), 't1'] END AS targets, ['k' || (o_custkey % 4)] AS kinds, (o_orderkey % 23) * 10 AS bytes, 1 + o_orderkey % 19 AS tokens, 1 + o_orderkey % 7 AS items, o_orderkey % 4 AS depth,
 CASE WHEN o_orderkey % 17 = 0 THEN 'p2' ELSE 'p1' END AS base, 'p1' AS active, o_custkey % 4 + CASE WHEN o_orderkey % 13 = 0 THEN 2 ELSE 1 END AS sequence, o_custkey % 4 AS approved, 3 AS max_requests, ['t0', 't1', 't2', 't3'] AS allowed_targets, ['k0', 'k1', 'k2'] AS allowed_kinds, 100 AS used_bytes, 10 AS used_tokens, 2 AS used_items, 250 AS max_bytes, 25 AS max_tokens, 7 AS max_items, 2 AS max_depth FROM orders)"""


@query(f"""WITH {REQ}, d AS (SELECT *, CASE WHEN trim(rationale) = '' OR len(targets) = 0 OR len(kinds) = 0 OR bytes = 0 OR tokens = 0 OR items = 0 THEN 'invalid_request' WHEN base <> active THEN 'wrong_package' WHEN sequence <> approved + 1 THEN 'out_of_sequence'
 WHEN approved >= max_requests THEN 'request_limit_exhausted' WHEN list_contains(targets, 't4') THEN 'target_outside_scope' WHEN list_contains(kinds, 'k3') THEN 'evidence_kind_outside_scope' WHEN bytes > 150 THEN 'byte_budget_exhausted' WHEN tokens > 15 THEN 'token_budget_exhausted'
 WHEN items > 5 THEN 'item_budget_exhausted' WHEN depth > 2 THEN 'relation_depth_exhausted' END AS denial FROM r) SELECT id, denial, CASE WHEN denial IS NULL THEN approved + 1 END AS next_approved, CASE WHEN denial IS NULL THEN 100 + bytes END AS next_bytes FROM d""")
def expansion_authorization(spark, sf):
    k, cu = order_key(), c("o_custkey")
    s = lambda t, x: F.concat(F.lit(t), x.cast("string"))
    listed = lambda *v: F.array(*map(F.lit, v))
    r = B.t(spark, sf, "orders").select(
        k.alias("id"), F.when(k % 31 == 0, " ").otherwise("why").alias("rationale"), F.when(k % 29 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(s("t", cu % 5), F.lit("t1"))).alias("targets"), F.array(s("k", cu % 4)).alias("kinds"),
        ((k % 23) * 10).alias("bytes"), (k % 19 + 1).alias("tokens"), (k % 7 + 1).alias("items"), (k % 4).alias("depth"), F.when(k % 17 == 0, "p2").otherwise("p1").alias("base"), F.lit("p1").alias("active"),
        (cu % 4 + F.when(k % 13 == 0, 2).otherwise(1)).alias("sequence"), (cu % 4).alias("approved"), F.lit(3).alias("max_requests"), listed("t0", "t1", "t2", "t3").alias("allowed_targets"), listed("k0", "k1", "k2").alias("allowed_kinds"),
        *[F.lit(v).cast("long").alias(n) for n, v in (("used_bytes", 100), ("used_tokens", 10), ("used_items", 2), ("max_bytes", 250), ("max_tokens", 25), ("max_items", 7), ("max_depth", 2))],
    )
    return P.expansion_usage(r).select("id", "denial", "next_approved", "next_bytes")


@query("""SELECT c_custkey AS provider, CASE WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 OR c_custkey % 5 = 0 OR c_custkey % 5 > 3 THEN 'invalid_policy' WHEN c_nationkey % 3 = 2 THEN 'classification_denied' WHEN c_nationkey % 2 = 0 AND c_custkey % 3 <> 0 THEN 'online_transmission_denied' END AS denied FROM customer""")
def provider_policy(spark, sf):
    k, n = c("c_custkey"), c("c_nationkey")
    one = lambda bad: F.when(bad, 0).otherwise(10)
    p = B.t(spark, sf, "customer").select(
        k.alias("provider"), one(k % 11 == 0).alias("max_requests"), F.lit(10).alias("max_input"), one(k % 13 == 0).alias("max_output"), F.lit(10).alias("max_evidence"), (k % 5).alias("max_concurrency"), F.lit(3).alias("capacity"),
        F.array(F.lit("public"), F.lit("internal")).alias("supported"), pick(["public", "internal", "secret"], n).alias("classification"), (n % 2 == 0).alias("online"), (k % 3 == 0).alias("authorized"),
    )
    return p.select("provider", P.provider_denial().alias("denied"))


#: policy of a work item, pipeline that owns it.
OWNED = [
    ("documentation-public-api@1", "documentation"), ("documentation-internal@1", "internal-documentation"), ("correctness-conservative@1", "correctness"), ("correctness-x@2", "correctness"), ("architecture-code-derived@1", "architecture"),
    ("optimization-conservative@1", "optimization"), ("maintainability-conservative@1", "maintainability"), ("conformance-design-aligned@1", "conformance"), ("testing-conservative@1", "testing"), ("documentation-public-api@2", None), ("other@1", None),
]


@query(f"WITH {B.SQL_WORK}, p AS (SELECT run, {sql_pick([o[1] for o in OWNED], 'work_id')} AS pipeline FROM wk) SELECT DISTINCT run, pipeline FROM p WHERE pipeline IS NOT NULL")
def pipelines_present(spark, sf):
    return R.pipelines_present(B.work(spark, sf).select("run", pick([o[0] for o in OWNED], c("work_id")).alias("policy")))


ASSIGNED = "wk2 AS (SELECT run, policy, adapter, count(*) AS items FROM wk GROUP BY ALL), pr AS (SELECT * FROM (VALUES (0, 'm0'), (1, 'm1'), (2, 'm2')) AS v(n, model))"


@query(f"""WITH {B.SQL_WORK}, {ASSIGNED} SELECT run, policy, adapter, CASE WHEN run % 2 = 0 THEN (SELECT model FROM pr ORDER BY sha256(run::VARCHAR || '/' || model) LIMIT 1) ELSE 'x' END IS NOT NULL AS assigned, items FROM wk2""")
def model_assignment(spark, sf):
    models = spark.createDataFrame([("m0",), ("m1",), ("m2",)], "model string")
    w = B.work(spark, sf).groupBy("run", "policy", "adapter").agg(F.count(F.lit(1)).alias("items"))
    a = P.assign_models(w.withColumn("pinned", c("run") % 2 == 0), models, ["policy", "adapter"])
    return a.select("run", "policy", "adapter", c("model").isNotNull().alias("assigned"), "items")


@query(f"""WITH {B.SQL_WORK}, {ASSIGNED}, g AS (SELECT run, count(DISTINCT (policy, adapter)) AS parts FROM wk2 GROUP BY run) SELECT run, CASE WHEN run % 2 = 0 THEN 1 ELSE parts END AS bound, run % 2 = 0 AS pinned FROM g""")
def model_identities(spark, sf):
    models = spark.createDataFrame([("m0",), ("m1",), ("m2",)], "model string")
    w = B.work(spark, sf).select("run", "policy", "adapter", (c("run") % 2 == 0).alias("pinned")).distinct()
    a = P.assign_models(w, models, ["policy", "adapter"])
    key = F.when(c("pinned"), c("model")).otherwise(F.concat_ws("/", "policy", "adapter"))
    return a.groupBy("run", "pinned").agg(F.count_distinct(key).alias("bound")).select("run", "bound", "pinned")


# -- cache prunes, one query a variant

PRUNED = {
    "expired": f"expires_at IS NOT NULL AND expires_at <= {B.NOW}", "targets": "target IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)",
    "target_policy": "(target, policy) IN (SELECT c_custkey, 'p' || (c_custkey % 7) FROM customer WHERE c_nationkey < 5)", "predicate": "hits = 0 AND bytes > 100", "clear": "true",
}


def _prune(how):
    def run(spark, sf):
        cu = B.t(spark, sf, "customer")
        chosen = {"targets": cu.filter("c_nationkey = 3"), "target_policy": cu.filter("c_nationkey < 5")}.get(how, cu)
        chosen = chosen.select(c("c_custkey").alias("target"), F.concat(F.lit("p"), (c("c_custkey") % 7).cast("string")).alias("policy"))
        return Q.cache_prune(B.cache(spark, sf), how, B.NOW, chosen, F.expr("hits = 0 and bytes > 100")).select("entry")

    run.__name__ = f"cache_prune_{how}"
    query(f"WITH {B.SQL_CACHE} SELECT entry FROM ca WHERE {PRUNED[how]}")(run)


for _how in PRUNED:
    _prune(_how)


# -- scalars

@query("""WITH d AS (SELECT doc_id, text, octet_length(encode(text)) AS n, chr(10) || '… ' || octet_length(encode(text)) || ' more bytes omitted to fit the evidence budget.' AS note FROM documents WHERE text IS NOT NULL),
x AS (SELECT *, 1000 - octet_length(encode(note)) AS room FROM d) SELECT doc_id, sha256(CASE WHEN n <= 1000 THEN text ELSE left(text, list_max(list_filter(range(0, least(length(text), 1000) + 1), lambda k: octet_length(encode(left(text, k))) <= room))) || note END) AS shown FROM x""")
def text_trim(spark, sf):
    return B.t(spark, sf, "documents").filter("text is not null").select("doc_id", F.sha2(T.trim_bytes("text", 1000).cast("binary"), 256).alias("shown"))


@query("""WITH n AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey % 1024 WHEN 1 THEN 1024 + o_orderkey WHEN 2 THEN 1048576 + o_orderkey * 1000 WHEN 3 THEN 1073741824 + o_orderkey * 1000000 ELSE 1023 END AS b FROM orders)
SELECT o_orderkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB (%d bytes)', b / 1024.0, b) WHEN b < 1073741824 THEN printf('%.1f MB (%d bytes)', b / 1048576.0, b) ELSE printf('%.2f GB (%d bytes)', b / 1073741824.0, b) END AS size FROM n""")
def human_bytes(spark, sf):
    k = order_key()
    b = F.when(k % 5 == 0, k % 1024).when(k % 5 == 1, k + 1024).when(k % 5 == 2, k * 1000 + 1048576).when(k % 5 == 3, k * 1_000_000 + 1073741824).otherwise(1023)
    return B.t(spark, sf, "orders").select("o_orderkey", T.human_bytes(b).alias("size"))


#: model's name, alias.
MODELS = [
    ("anthropic.claude-3-5-sonnet-20241022-v2:0", "claude-3-5-sonnet"), ("meta-llama/Llama-3.1-8B", "llama-3.1-8b"), ("amazon.nova-lite-v1:0", "nova-lite"), ("llama3.2:latest", "llama3.2"), ("ibm/granite 8b", "granite-8b"),
    ("mistral.mistral--large", "mistral-large"), ("gpt_4o", "gpt-4o"), ("google.x", "x"),
]


@query(f"SELECT o_orderkey, alias FROM orders JOIN {sql_values(MODELS, 'm', 'alias')} ON m = {sql_pick([m[0] for m in MODELS], 'o_orderkey')}")
def model_aliases(spark, sf):
    return B.t(spark, sf, "orders").select("o_orderkey", T.model_alias(pick([m[0] for m in MODELS], order_key())).alias("alias"))


#: text, text with A=1 and HOME_DIR=/h$x in place (null: an error).
ENVS = [
    ("a ${A} b", "a 1 b"), ("${B:-two}", "two"), ("${A:-two}", "1"), ("${B}", None), ("\\${A}", "${A}"), ("$A/$HOME_DIR", "1//h$x"), ("$AB", None), ("plain", "plain"), ("${ A }", "1"), ("${B:-}", ""), ("cost 5$", "cost 5$"), ("${A", None),
]


@query(f"SELECT o_orderkey, y AS out FROM orders JOIN {sql_values(ENVS, 'x', 'y')} ON x = {sql_pick([e[0] for e in ENVS], 'o_orderkey')}")
def env_substitution(spark, sf):
    return B.t(spark, sf, "orders").select("o_orderkey", T.substitute_env(pick([e[0] for e in ENVS], order_key()), {"A": "1", "HOME_DIR": "/h$x"}).alias("out"))


#: location, path, line, column, offset, length.
PLACES = [
    ("src/a.rs", "src/a.rs", None, None, None, None), ("a.rs:7", "a.rs", 7, None, None, None), ("a.rs:7:3", "a.rs", 7, 3, None, None), ("a.rs:10-20", "a.rs", 1, None, 10, 10), ("a.rs:20-10", "a.rs", 1, None, 20, 0), ("d\\b.rs:x:4", "d/b.rs", 1, 4, None, None),
    ("a.rs:x", "a.rs", None, None, None, None),
]


@query(f"SELECT o_orderkey, path, line::INTEGER AS line, col::INTEGER AS col, off::BIGINT AS off, len::BIGINT AS len FROM orders JOIN {sql_values(PLACES, 'loc', 'path', 'line', 'col', 'off', 'len')} ON loc = {sql_pick([p[0] for p in PLACES], 'o_orderkey')}")
def location_parse(spark, sf):
    l = B.t(spark, sf, "orders").select("o_orderkey", T.parse_location(pick([p[0] for p in PLACES], order_key())).alias("l"))
    return l.select("o_orderkey", "l.path", "l.line", c("l.column").alias("col"), c("l.offset").alias("off"), c("l.length").alias("len"))


@query("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_name || ':' || c_custkey || ':' || c_nationkey ELSE c_name || ':' || c_nationkey || '-' || (c_nationkey + c_custkey) END AS location, 'x' || c_custkey || chr(0) || c_mktsegment || chr(0) || c_nationkey AS cache_key FROM customer")
def location_and_cache_key(spark, sf):
    n, k = c("c_nationkey"), c("c_custkey")
    s = lambda x: x.cast("string")
    place = T.format_location(c("c_name"), n, n + k, F.when(n % 2 == 0, k), n)
    return B.t(spark, sf, "customer").select("c_custkey", place.alias("location"), F.concat_ws("\x00", F.concat(F.lit("x"), s(k)), "c_mktsegment", s(n)).alias("cache_key"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(html, '([\\*_`\[\]<>#|])', '\\\1', 'g'), '[\r\n]', ' ', 'g') AS escaped FROM pages""")
def markdown_escape(spark, sf):
    return B.t(spark, sf, "pages").select("page_id", T.escape_markdown("html").alias("escaped"))


# -- findings that reports hold, evaluation over all policies

VERSIONS = list(E.POLICY_NAMES)


@query(f"""WITH g AS (SELECT l_orderkey AS id, {sql_pick(VERSIONS, 'l_orderkey')} AS v, array_to_string(list_sort(list(DISTINCT 'part:' || l_partkey)), ',') AS targets, nullif(array_to_string(list_sort(list(DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN 'f' || l_suppkey || ':' || l_linenumber || ':1' WHEN l_linenumber % 3 = 0 THEN 'f' || l_suppkey || ':0-9' END) FILTER (l_linenumber % 2 = 0 OR l_linenumber % 3 = 0)), ', '), '') AS loc FROM lineitem GROUP BY 1)
SELECT id, n AS policy, targets, loc AS primary_location FROM g JOIN {sql_values(E.POLICY_NAMES.items(), 'v', 'n')} USING (v)""")
def finding_extraction(spark, sf):
    n = c("l_linenumber")
    path = F.when((n % 2 == 0) | (n % 3 == 0), F.concat(F.lit("f"), c("l_suppkey").cast("string")))
    cite = F.struct(path.alias("path"), F.lit(0).alias("start"), F.lit(9).alias("end"), F.when(n % 2 == 0, n).alias("line"), F.lit(1).alias("column"))
    # a cluster's citations and occurrences: those of one order here
    g = B.t(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("id")).agg(F.collect_list(cite).alias("citations"), F.collect_list(F.concat(F.lit("part:"), c("l_partkey").cast("string"))).alias("occurrences"))
    g = g.select("*", pick(VERSIONS, c("id")).alias("policy_version"), F.lit("t").alias("title"), F.lit("high").alias("severity"), F.lit(1).alias("confidence"), F.lit("d").alias("description"), F.array(F.lit("Dim")).alias("dimensions"))
    return E.findings_of(g).select("id", "policy", F.array_join("targets", ",").alias("targets"), "primary_location")


POL = [v for v in E.POLICY_NAMES.values()]
EVAL = f"""cu AS (SELECT {sql_pick(POL, 'o_custkey')} AS policy, o_custkey % 3 AS run, o_orderkey AS finding, 1 + o_orderkey % 3 AS occurrences FROM orders),
lt AS (SELECT o_custkey % 3 AS run, o_orderkey AS finding, {sql_pick(['accepted', 'rejected', 'deferred', 'accepted'], 'o_orderkey')} AS state, CASE WHEN o_orderkey % 2 = 1 THEN 'i' || (o_orderkey % 40) END AS issue FROM orders WHERE o_orderkey % 7 <> 0),
ci AS (SELECT DISTINCT policy, 'i' || n AS issue FROM (SELECT unnest({lit(POL)}) AS policy), (SELECT unnest(range(0, 30)) AS n)), su AS (SELECT policy, run, count(*) AS total, count(*) FILTER (finding % 10 = 0) AS unable FROM cu GROUP BY ALL),
jn AS (SELECT cu.*, lt.state, CASE WHEN state = 'accepted' AND ci.issue IS NOT NULL THEN lt.issue END AS hit FROM cu LEFT JOIN lt USING (run, finding) LEFT JOIN ci ON ci.policy = cu.policy AND ci.issue = lt.issue),
ag AS (SELECT policy, count(*) FILTER (state = 'accepted') AS accepted, count(*) FILTER (state = 'rejected') AS rejected, count(*) FILTER (state = 'deferred') AS deferred, count(*) FILTER (state IS NULL) AS unadjudicated, count(DISTINCT (run, hit)) FILTER (hit IS NOT NULL) AS matched, sum(occurrences)::BIGINT AS occ, count(*) AS n FROM jn GROUP BY policy),
sr AS (SELECT policy, count(DISTINCT run) AS runs, sum(total)::BIGINT AS total, sum(unable)::BIGINT AS unable FROM su GROUP BY policy)"""


@query(f"WITH {EVAL} SELECT policy, accepted, rejected, deferred, unadjudicated, matched, accepted * 10000 // nullif(accepted + rejected, 0) AS precision_bp, matched * 10000 // (30 * runs) AS recall_bp, (occ - n) * 10000 // occ AS duplicate_bp, unable * 10000 // total AS unable_bp FROM ag JOIN sr USING (policy)")
def evaluation_by_policy(spark, sf):
    o, k, cu = B.t(spark, sf, "orders"), order_key(), c("o_custkey")
    clusters = o.select(pick(POL, cu).alias("policy"), (cu % 3).alias("run"), k.alias("finding"), (k % 3 + 1).alias("occurrences"))
    latest = o.filter(k % 7 != 0).select((cu % 3).alias("run"), k.alias("finding"), pick(["accepted", "rejected", "deferred", "accepted"], k).alias("state"), F.when(k % 2 == 1, F.concat(F.lit("i"), (k % 40).cast("string"))).alias("expected_issue"))
    issues = spark.createDataFrame([(p, f"i{n}") for p in POL for n in range(30)], "policy string, issue string")
    summaries = clusters.groupBy("policy", "run").agg(F.count(F.lit(1)).alias("total"), F.count_if(c("finding") % 10 == 0).alias("unable"))
    return E.evaluate(clusters, latest, issues, summaries)

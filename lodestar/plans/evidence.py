"""Queries over fingerprints, digests, scopes, design documents and evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar import bridge as B
from lodestar.functions.ids import derived_id
from lodestar.operators import design as D
from lodestar.operators import forest as T
from lodestar.operators import graph as G
from lodestar.operators import report as R
from lodestar.operators import snapshot as S
from lodestar.plans.snapshots import sql_id
from lodestar.registry import query

c = F.col


@query(f"""WITH {B.SQL_FINDINGS}, g AS (SELECT policy, target, count(DISTINCT severity) AS n, count(*) AS findings FROM cf GROUP BY ALL) SELECT policy, target, CASE WHEN n > 1 THEN 'disputed' ELSE 'agreed' END AS verification, findings FROM g""")
def cluster_verification(spark, sf):
    g = B.findings(spark, sf, "current").groupBy("policy", "target").agg(F.count_distinct("severity").alias("n"), F.count(F.lit(1)).alias("findings"))
    return g.select("policy", "target", F.when(c("n") > 1, "disputed").otherwise("agreed").alias("verification"), "findings")


@query(f"""WITH {B.SQL_FINDINGS}, m AS (SELECT policy, list_sort(list(DISTINCT target)) AS ts FROM cf GROUP BY policy) SELECT policy, array_to_string(ts[1:10], ',') AS shown, greatest(len(ts) - 10, 0)::BIGINT AS omitted FROM m""")
def bounded_lists(spark, sf):
    # the first ten by rank and a count, so that no list grows with the data
    f = B.findings(spark, sf, "current").select("policy", "target").distinct()
    n = f.groupBy("policy").agg(F.count(F.lit(1)).alias("n"))
    top = f.withColumn("r", F.row_number().over(Window.partitionBy("policy").orderBy("target"))).filter("r <= 10").groupBy("policy").agg(F.concat_ws(",", F.array_sort(F.collect_list("target"))).alias("shown"))
    return top.join(n, "policy").select("policy", "shown", F.greatest(c("n") - 10, F.lit(0)).alias("omitted"))


@query("""WITH d AS (SELECT source, doc_id, n_chars FROM documents) SELECT source, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id, max(n_chars) AS n_chars FROM d GROUP BY source""")
def longest_source(spark, sf):
    return B.t(spark, sf, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct(c("n_chars"), (-c("doc_id")))).alias("doc_id"), F.max("n_chars").alias("n_chars"))


@query(f"""WITH {B.SQL_TARGETS} SELECT t.id, p.id AS package FROM tg t JOIN tg s ON t.parent = s.id JOIN tg p ON s.parent = p.id WHERE t.kind = 'callable' AND p.kind = 'package'""")
def package_of_target(spark, sf):
    tg = B.targets(spark, sf)
    up = G.ancestors(tg, tg.filter("kind = 'callable'").select(c("id").alias("node")))
    packages = tg.filter("kind = 'package'").select(c("id").alias("ancestor"))
    return up.join(packages, "ancestor").groupBy(c("node").alias("id")).agg(F.min_by("ancestor", "depth").alias("package"))


@query(f"""WITH {B.SQL_TARGETS} SELECT t.id AS member, s.id AS module FROM tg t JOIN tg s ON t.parent = s.id WHERE t.kind <> 'module' AND s.kind = 'module'""")
def nearest_module(spark, sf):
    tg = B.targets(spark, sf)
    up = G.ancestors(tg, tg.filter("kind in ('callable', 'record', 'field')").select(c("id").alias("node")))
    return up.join(tg.filter("kind = 'module'").select(c("id").alias("ancestor")), "ancestor").groupBy(c("node").alias("member")).agg(F.min_by("ancestor", "depth").alias("module"))


@query(f"""WITH RECURSIVE {B.SQL_TARGETS}, dn(root, node) AS (SELECT id, id FROM tg WHERE kind = 'package' UNION SELECT dn.root, tg.id FROM dn JOIN tg ON tg.parent = dn.node) SELECT root AS scope, count(*) AS members, count(*) FILTER (inventory = 'represented') AS succeeded, count(*) FILTER (inventory = 'failed') AS failed, count(*) FILTER (inventory = 'partial' OR inventory = 'unsupported') AS weak FROM dn JOIN tg ON dn.node = tg.id GROUP BY root""")
def scope_closure_health(spark, sf):
    tg = B.targets(spark, sf)
    counted = T.subtree_counts(T.intervals(tg.select("id", "parent")), tg.select("id", c("inventory").alias("mark")), tg.filter("kind = 'package'").select("id"))
    of = lambda *marks: F.sum(F.when(c("mark").isin(*marks), c("n")).otherwise(0))
    return counted.groupBy("scope").agg(F.sum("n").alias("members"), of("represented").alias("succeeded"), of("failed").alias("failed"), of("partial", "unsupported").alias("weak"))


@query(f"""WITH {B.SQL_RELATIONS}, sc AS (SELECT id FROM tg WHERE id LIKE 'supplier:1%' OR id LIKE 'part:1%') SELECT source, target, kind, source IN (SELECT id FROM sc) AS outgoing FROM rl WHERE (source IN (SELECT id FROM sc)) <> (target IN (SELECT id FROM sc))""")
def boundary_relations(spark, sf):
    scope = B.targets(spark, sf).filter("id like 'supplier:1%' or id like 'part:1%'").select(c("id"), F.lit(True).alias("in"))
    r = B.relations(spark, sf)
    r = r.join(scope.select(c("id").alias("source"), c("in").alias("a")), "source", "left").join(scope.select(c("id").alias("target"), c("in").alias("b")), "target", "left")
    return r.filter("coalesce(a, false) != coalesce(b, false)").select("source", "target", "kind", F.coalesce("a", F.lit(False)).alias("outgoing"))


CALLERS = f"""WITH {B.SQL_RELATIONS}, b AS (SELECT source, target FROM rl WHERE kind = 'rust:calls'), cu AS (SELECT source, CASE WHEN source LIKE '%5' THEN 'supplier:1' ELSE target END AS target FROM b)"""


@query(CALLERS + " SELECT coalesce(b.source, cu.source) AS source, coalesce(b.target, cu.target) AS target, CASE WHEN b.source IS NULL THEN 'added' WHEN cu.source IS NULL THEN 'removed' ELSE 'unchanged' END AS change FROM (SELECT DISTINCT * FROM b) b FULL OUTER JOIN (SELECT DISTINCT * FROM cu) cu ON b.source = cu.source AND b.target = cu.target")
def caller_diff(spark, sf):
    b = B.relations(spark, sf).filter("kind = 'rust:calls'").select("source", "target").distinct()
    now = b.select("source", F.when(c("source").endswith("5"), "supplier:1").otherwise(c("target")).alias("target")).distinct()
    key = lambda d: d.withColumn("k", F.concat_ws("|", "source", "target"))
    d = S.diff(key(b), key(now), "k", ["source"])
    return d.select(F.split("k", r"\|")[0].alias("source"), F.split("k", r"\|")[1].alias("target"), "change")


@query("""WITH r AS (SELECT p_partkey AS id, ['code', 'doc', 'test'] AS required, list_filter(['code', CASE WHEN p_size % 2 = 0 THEN 'doc' END, CASE WHEN p_size % 3 = 0 THEN 'test' END], lambda x: x IS NOT NULL) AS got FROM part) SELECT id, array_to_string(list_sort(list_filter(required, lambda x: NOT list_contains(got, x))), ',') AS missing, len(list_filter(required, lambda x: NOT list_contains(got, x))) = 0 AS complete FROM r""")
def unsatisfied_requirements(spark, sf):
    got = F.array_compact(F.array(F.lit("code"), F.when(c("p_size") % 2 == 0, "doc"), F.when(c("p_size") % 3 == 0, "test")))
    miss = F.array_sort(F.array_except(F.array(F.lit("code"), F.lit("doc"), F.lit("test")), got))
    return B.t(spark, sf, "part").select(c("p_partkey").alias("id"), F.concat_ws(",", miss).alias("missing"), (F.size(miss) == 0).alias("complete"))


def _artifacts(spark, sf):
    p = B.t(spark, sf, "part")
    ident = F.concat(F.when(c("p_partkey") % 2 == 0, "ADR ").otherwise("rfc_"), (c("p_partkey") % 900).cast("string"))
    return p.select(c("p_partkey").alias("id"), ident.alias("identifier"), F.when(c("p_size") % 5 == 0, (c("p_partkey") * 3) % 1500).alias("supersedes"), F.when(c("p_size") % 3 == 0, "accepted").otherwise("superseded").alias("status"))


ART = """ar AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'ADR ' ELSE 'rfc_' END || (p_partkey % 900) AS identifier, CASE WHEN p_size % 5 = 0 THEN (p_partkey * 3) % 1500 END AS supersedes, CASE WHEN p_size % 3 = 0 THEN 'accepted' ELSE 'superseded' END AS status FROM part)"""


@query(f"WITH {ART}, k AS (SELECT id, translate(lower(trim(identifier)), ' _', '--') AS key FROM ar) SELECT key, id FROM k WHERE key IN (SELECT key FROM k GROUP BY key HAVING count(*) > 1)")
def duplicate_identifiers(spark, sf):
    return D.duplicates(_artifacts(spark, sf))


@query(f"WITH RECURSIVE {ART}, ch(root, node, depth) AS (SELECT id, supersedes, 1 FROM ar WHERE supersedes IS NOT NULL UNION SELECT ch.root, ar.supersedes, depth + 1 FROM ch JOIN ar ON ch.node = ar.id WHERE ar.supersedes IS NOT NULL AND depth < 40) SELECT root, node, min(depth) AS depth FROM ch WHERE node <> root GROUP BY root, node")
def supersession_chain(spark, sf):
    return D.supersession_chain(_artifacts(spark, sf))


@query(f"""WITH RECURSIVE {ART}, k AS (SELECT count(*) AS k FROM ar), ch(root, node, depth) AS (SELECT id, id, 0 FROM ar UNION ALL SELECT ch.root, ar.supersedes, depth + 1 FROM ch JOIN ar ON ch.node = ar.id WHERE ar.supersedes IS NOT NULL AND depth <= (SELECT k FROM k)),
l AS (SELECT root, max(depth) AS steps, arg_max(node, depth) AS last FROM ch GROUP BY root)
SELECT root AS id, CASE WHEN steps <= k THEN last END AS last, CASE WHEN steps <= k THEN steps::BIGINT END AS steps, steps > k AS circle FROM l, k""")
def supersession_ends(spark, sf):
    return D.supersession_ends(_artifacts(spark, sf))


@query(f"""WITH RECURSIVE {ART}, ch(root, node, depth) AS (SELECT id, supersedes, 1 FROM ar WHERE supersedes IS NOT NULL UNION SELECT ch.root, ar.supersedes, depth + 1 FROM ch JOIN ar ON ch.node = ar.id WHERE ar.supersedes IS NOT NULL AND depth < 40)
SELECT 'broken' AS problem, id FROM ar WHERE supersedes IS NOT NULL AND supersedes NOT IN (SELECT id FROM ar) UNION ALL SELECT 'still_active', a.id FROM ar a JOIN ar b ON a.supersedes = b.id WHERE b.status = 'accepted' UNION ALL SELECT DISTINCT 'cycle', root FROM ch WHERE root = node""")
def supersession_health(spark, sf):
    return D.supersession_health(_artifacts(spark, sf))


@query("""WITH d AS (SELECT o_orderkey AS target, o_custkey % 20 AS artifact, 'dep' || (o_orderkey % 6) AS dep, o_orderkey % 3 = 0 AS iface, o_orderkey % 4 = 0 AS tested FROM orders)
SELECT target, artifact, CASE WHEN target % 10 = 0 AND (target % 20 = 0 OR '2024-01-01' >= '2025-01-01') THEN 'accepted' WHEN dep = 'dep' || (artifact % 6) THEN 'prohibited' WHEN iface AND NOT tested THEN 'untested' ELSE 'none' END AS outcome FROM d""")
def design_drift(spark, sf):
    o, k = B.t(spark, sf, "orders"), c("o_orderkey")
    d = o.select(k.alias("target"), (c("o_custkey") % 20).alias("artifact"), F.concat(F.lit("dep"), (k % 6).cast("string")).alias("added_dependency"), (k % 3 == 0).alias("interface_changed"), (k % 4 == 0).alias("tested"))
    rules = spark.range(20).select(c("id").alias("artifact"), F.concat(F.lit("dep"), (c("id") % 6).cast("string")).alias("forbidden"))
    accepted = d.filter("target % 10 = 0").select("target", "artifact", F.when(c("target") % 20 != 0, "2024-01-01").alias("review_by"))
    return D.drift(d, rules, accepted, "2025-01-01")


@query("""SELECT event_id, json_extract_string(props, '$.' || k) AS first_value, k AS first_key FROM (SELECT event_id, props, json_keys(props)[1] AS k FROM events WHERE json_valid(props)) WHERE k IS NOT NULL""")
def payload_fields(spark, sf):
    m = F.from_json("props", "map<string,string>")
    keys = F.json_object_keys("props")
    return B.t(spark, sf, "events").withColumn("k", F.element_at(keys, 1)).filter("k is not null").select("event_id", F.element_at(m, c("k")).alias("first_value"), c("k").alias("first_key"))


@query(f"""WITH {B.SQL_WORK}, r AS (SELECT DISTINCT run FROM wk), x AS (SELECT run, count(*) FILTER (policy <> 'p6' AND state IN ('pending', 'leased')) AS waiting FROM wk GROUP BY run) SELECT run, waiting = 0 AS may_admit, waiting FROM x""")
def deferred_admission(spark, sf):
    w = B.work(spark, sf).groupBy("run").agg(F.count_if((c("policy") != "p6") & c("state").isin("pending", "leased")).alias("waiting"))
    return w.select("run", (c("waiting") == 0).alias("may_admit"), "waiting")


@query(f"""WITH {B.SQL_TARGETS} SELECT CASE WHEN (SELECT count(*) FROM tg WHERE kind = 'workspace') > 1 THEN 'too_many' ELSE 'ok' END AS workspaces, (SELECT count(*) FROM tg WHERE parent IS NULL) AS roots""")
def workspace_check(spark, sf):
    tg = B.targets(spark, sf)
    return tg.agg(F.when(F.count_if(c("kind") == "workspace") > 1, "too_many").otherwise("ok").alias("workspaces"), F.count_if(c("parent").isNull()).alias("roots"))

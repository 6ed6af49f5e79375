"""Queries over targets, relations and findings: planning, impact, clusters, run comparison, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar import bridge as B
from lodestar.operators import documents as W
from lodestar.operators import graph as G
from lodestar.operators import planning as P
from lodestar.operators import report as R
from lodestar.operators import snapshot as S
from lodestar.operators.tables import cut
from lodestar.plans.snapshots import sql_id
from lodestar.registry import query

RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


@query(f"WITH {B.SQL_TARGETS} SELECT kind, inventory, count(*) AS targets FROM tg GROUP BY ALL")
def inventory_coverage(spark, sf):
    return B.targets(spark, sf).groupBy("kind", "inventory").agg(F.count(F.lit(1)).alias("targets"))


@query(f"WITH {B.SQL_RELATIONS} SELECT source, target, CASE WHEN kind LIKE '%calls' THEN 'calls' WHEN kind LIKE '%implements' THEN 'implements' WHEN kind LIKE '%contains' THEN 'contains' ELSE 'references' END AS relation FROM rl")
def dependency_graph(spark, sf):
    return G.dependency_edges(B.relations(spark, sf))


@query(f"""WITH {B.SQL_RELATIONS} SELECT 'unknown_target' AS rule, target AS id FROM rl WHERE target NOT IN (SELECT id FROM tg) UNION SELECT 'unknown_source', source FROM rl WHERE source NOT IN (SELECT id FROM tg)
UNION ALL SELECT 'missing_parent', id FROM tg WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM tg) UNION ALL SELECT 'duplicate_id', id FROM tg GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'blank_name', id FROM tg WHERE trim(name) = '' OR name IS NULL""")
def integrity_violations(spark, sf):
    return S.violations(B.targets(spark, sf), B.relations(spark, sf))


CALLS = "ce AS (SELECT DISTINCT target AS src, source AS dst FROM rl WHERE kind NOT LIKE '%contains')"


@query(f"""WITH RECURSIVE {B.SQL_TARGETS}, up(node, ancestor, depth) AS (SELECT id, parent, 1 FROM tg WHERE parent IS NOT NULL AND kind IN ('module', 'package') UNION ALL SELECT up.node, tg.parent, depth + 1 FROM up JOIN tg ON up.ancestor = tg.id WHERE tg.parent IS NOT NULL) SELECT * FROM up""")
def containment_ancestors(spark, sf):
    tg = B.targets(spark, sf)
    return G.ancestors(tg, tg.filter("kind in ('module', 'package')").select(F.col("id").alias("node")))


@query(f"""WITH RECURSIVE {B.SQL_RELATIONS}, e AS (SELECT DISTINCT source AS src, target AS dst FROM rl WHERE kind LIKE '%depends_on'), r(root, node) AS (SELECT src, dst FROM e UNION SELECT r.root, e.dst FROM r JOIN e ON r.node = e.src),
m AS (SELECT a.root, a.node FROM r a JOIN r b ON a.root = b.node AND a.node = b.root), c AS (SELECT root AS node, min(node) AS label, count(*) AS size FROM m GROUP BY root) SELECT node, label, size FROM c""")
def dependency_cycles(spark, sf):
    return G.cycles(B.relations(spark, sf).filter("kind like '%depends_on'").select(F.col("source").alias("src"), F.col("target").alias("dst")))


VIS = """vi(id, effective, up, n) AS (SELECT id, visibility, parent, 0 FROM tg UNION ALL SELECT vi.id, CASE WHEN tg.id IS NULL THEN 'unknown' ELSE tg.visibility END, tg.parent, n + 1 FROM vi LEFT JOIN tg ON vi.up = tg.id WHERE vi.effective = 'inherited' AND n < 1000),
ve AS (SELECT id, CASE WHEN arg_max(effective, n) = 'inherited' THEN 'unknown' ELSE arg_max(effective, n) END AS effective FROM vi GROUP BY id)"""


@query(f"WITH RECURSIVE {B.SQL_TARGETS}, {VIS} SELECT * FROM ve")
def effective_visibility(spark, sf):
    return P.inherited_visibility(B.targets(spark, sf))


#: Fixed values: (kind, visibility) to decision.
RULES = [("callable", "public", "applicable"), ("callable", "crate", "applicable"), ("record", "public", "applicable"), ("field", "public", "optional"), ("callable", "private", "not_applicable"), ("record", "private", "not_applicable"), ("module", "public", "applicable"), ("package", "inherited", "applicable")]


@query(f"""WITH {B.SQL_TARGETS}, ru(kind, visibility, decision) AS (VALUES {", ".join(map(str, RULES))}) SELECT tg.id, CASE WHEN inventory <> 'represented' THEN 'pending' ELSE coalesce(decision, 'pending') END AS decision FROM tg LEFT JOIN ru ON tg.kind = ru.kind AND tg.visibility = ru.visibility""")
def applicability(spark, sf):
    return P.applicability(B.targets(spark, sf), spark.createDataFrame(RULES, "kind string, visibility string, decision string"))


@query(f"""WITH {B.SQL_RELATIONS}, ch AS (SELECT id FROM tg WHERE id LIKE 'supplier:%5') SELECT id FROM tg WHERE id IN (SELECT id FROM ch) OR id IN (SELECT target FROM rl WHERE source IN (SELECT id FROM ch)) OR id IN (SELECT source FROM rl WHERE target IN (SELECT id FROM ch)) OR kind = 'workspace'""")
def one_hop_filter(spark, sf):
    tg = B.targets(spark, sf)
    return S.one_hop(tg, B.relations(spark, sf), tg.filter("id like 'supplier:%5'").select("id"))


@query(f"WITH {B.SQL_FINDINGS} SELECT {sql_id('cluster', 'policy', 'title', 'severity', 'description')} AS cluster, policy, title, severity, description, count(*) AS occurrences, min(id) AS representative FROM (SELECT id, policy, lower(trim(title)) AS title, severity, description FROM cf) GROUP BY ALL".replace("min(id) AS representative FROM (SELECT id, policy", "min(id) AS representative FROM (SELECT id, lower(policy) AS policy"))
def finding_clusters(spark, sf):
    return R.clusters(B.findings(spark, sf, "current"), ["policy", "title", "severity", "description"])


MATCH = """b AS (SELECT id AS baseline_id, arg_max(policy, (policy, target, title, severity)) AS bp, arg_max(target, (policy, target, title, severity)) AS bt, lower(trim(arg_max(title, (policy, target, title, severity)))) AS bc, arg_max(severity, (policy, target, title, severity)) AS bs FROM bf GROUP BY id),
c AS (SELECT id AS current_id, arg_max(policy, (policy, target, title, severity)) AS cp, arg_max(target, (policy, target, title, severity)) AS ct, lower(trim(arg_max(title, (policy, target, title, severity)))) AS cc, arg_max(severity, (policy, target, title, severity)) AS cs FROM cf GROUP BY id),
x AS (SELECT baseline_id, current_id, 'persistent' AS category, 'id' AS matched_by, coalesce(cs, bs) AS severity FROM b JOIN c ON baseline_id = current_id),
b2 AS (SELECT *, row_number() OVER (PARTITION BY bp, bt, bc ORDER BY baseline_id DESC) AS rn FROM b WHERE baseline_id NOT IN (SELECT baseline_id FROM x)),
c2 AS (SELECT *, row_number() OVER (PARTITION BY cp, ct, cc ORDER BY current_id) AS cn FROM c WHERE current_id NOT IN (SELECT current_id FROM x)),
mt AS (SELECT * FROM x UNION ALL SELECT baseline_id, current_id, CASE WHEN baseline_id IS NULL THEN 'new' WHEN current_id IS NULL THEN 'resolved' ELSE 'persistent' END, CASE WHEN baseline_id IS NOT NULL AND current_id IS NOT NULL THEN 'claim' END, coalesce(cs, bs) FROM b2 FULL OUTER JOIN c2 ON bp = cp AND bt = ct AND bc = cc AND rn = cn)"""


def _match(spark, sf):
    return R.match(B.findings(spark, sf, "baseline"), B.findings(spark, sf, "current"))


@query(f"WITH {B.SQL_FINDINGS}, {MATCH} SELECT * FROM mt")
def finding_diff(spark, sf):
    return _match(spark, sf)


@query(f"WITH {B.SQL_FINDINGS}, {MATCH} SELECT category, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("note", "low", "medium", "high", "critical")) + " FROM mt GROUP BY category")
def severity_breakdown(spark, sf):
    return _match(spark, sf).groupBy("category").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("note", "low", "medium", "high", "critical")])


@query(f"""WITH {B.SQL_FINDINGS}, {MATCH}, n AS (SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) AS total FROM mt WHERE category = 'new')
SELECT * FROM (SELECT 'max_new_critical' AS rule, 0::BIGINT AS "limit", critical AS found FROM n UNION ALL SELECT 'max_new_high', 5, high FROM n UNION ALL SELECT 'max_new_total', 1000000000, total FROM n) WHERE found > "limit" """)
def gate_check(spark, sf):
    return R.gate(_match(spark, sf), 0, 5, None, 1_000_000_000)


@query(f"""WITH {B.SQL_FINDINGS}, {MATCH}, n AS (SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high FROM mt WHERE category = 'new'),
v AS (SELECT 'max_new_critical: ' || critical || ' found, 0 allowed' AS line FROM n WHERE critical > 0 UNION ALL SELECT 'max_new_high: ' || high || ' found, 5 allowed' FROM n WHERE high > 5),
f AS (SELECT category, severity, {RANK} AS rank, baseline_id, current_id, matched_by FROM mt),
l(s, t, r, b, d, value) AS (SELECT 0, NULL, 0, NULL, NULL, '# Comparison' UNION ALL SELECT 1, NULL, 0, NULL, NULL, '' UNION ALL SELECT 2, line, 0, NULL, NULL, '> ' || line FROM v UNION ALL SELECT 2, 'none', 0, NULL, NULL, '> no threshold is violated' WHERE NOT EXISTS (FROM v)
 UNION ALL SELECT 3, NULL, 0, NULL, NULL, '' UNION ALL SELECT 4, NULL, 0, NULL, NULL, '## Counts' UNION ALL SELECT 5, NULL, 0, NULL, NULL, '' UNION ALL SELECT 6, NULL, 0, NULL, NULL, '| category | findings | critical | high | medium | low | note |'
 UNION ALL SELECT 7, NULL, 0, NULL, NULL, '| --- | --- | --- | --- | --- | --- | --- |'
 UNION ALL SELECT 8, category, 0, NULL, NULL, '| ' || concat_ws(' | ', category, count(*), count(*) FILTER (severity = 'critical'), count(*) FILTER (severity = 'high'), count(*) FILTER (severity = 'medium'), count(*) FILTER (severity = 'low'), count(*) FILTER (severity = 'note')) || ' |' FROM f GROUP BY category
 UNION ALL SELECT 9, NULL, 0, NULL, NULL, '' UNION ALL SELECT 10, NULL, 0, NULL, NULL, '## Findings' UNION ALL SELECT 11, NULL, 0, NULL, NULL, '' UNION ALL SELECT 12, NULL, 0, NULL, NULL, '| category | severity | baseline_id | current_id | matched_by |' UNION ALL SELECT 13, NULL, 0, NULL, NULL, '| --- | --- | --- | --- | --- |'
 UNION ALL SELECT 14, category, rank, baseline_id, current_id, '| ' || concat_ws(' | ', category, severity, coalesce(baseline_id, ''), coalesce(current_id, ''), coalesce(replace(matched_by, '_', '\\_'), '')) || ' |' FROM f)
SELECT row_number() OVER (ORDER BY s, t, r DESC, b NULLS FIRST, d NULLS FIRST) AS n, value FROM l""")
def differential_report(spark, sf):
    m = cut(_match(spark, sf))
    return W.document_lines(spark, W.differential_markdown(m, "Comparison", R.gate(m, 0, 5)))


@query(f"WITH {B.SQL_FINDINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {RANK} DESC, confidence DESC, id) AS rank FROM cf) SELECT id, target, severity, confidence, rank FROM r WHERE rank <= 20")
def signals_topk(spark, sf):
    return R.top_signals(B.findings(spark, sf, "current"), 20).select("id", "target", "severity", "confidence", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {B.SQL_FINDINGS} SELECT id, policy, severity FROM cf WHERE lower(policy) LIKE '%-r%' AND severity = 'high' AND lower(title || description || target) LIKE '%part:1%'")
def findings_query(spark, sf):
    f = B.findings(spark, sf, "current")
    return f.filter(F.lower("policy").contains("-r") & (F.col("severity") == "high") & F.lower(F.concat("title", "description", "target")).contains("part:1")).select("id", "policy", "severity")


@query(f"""WITH {B.SQL_FINDINGS} SELECT id, policy AS rule, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level,
 '{{"ruleId":"' || policy || '","level":"' || CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END || '","message":{{"text":"' || trim(title) || '"}}}}' AS result FROM cf""")
def sarif(spark, sf):
    return R.sarif_results(B.findings(spark, sf, "current"))


@query(f"""WITH {B.SQL_FINDINGS}, i AS (SELECT id, policy AS place, sha256(title || severity) AS hash FROM cf), r AS (SELECT DISTINCT policy AS place, sha256(title || severity) AS hash FROM bf WHERE severity <> 'note')
SELECT i.id, i.place, i.hash, CASE WHEN r.hash IS NOT NULL THEN 'skip' ELSE 'publish' END AS action FROM i LEFT JOIN r ON i.place = r.place AND i.hash = r.hash""")
def publication(spark, sf):
    h = F.sha2(F.concat("title", "severity"), 256).alias("hash")
    items = B.findings(spark, sf, "current").select("id", F.col("policy").alias("place"), h)
    done = B.findings(spark, sf, "baseline").filter("severity != 'note'").select(F.col("policy").alias("place"), h)
    return R.publish(items, done)


@query("""WITH s AS (SELECT l_orderkey AS path, l_linenumber AS id, l_linenumber * 10 AS s, l_linenumber * 10 + l_quantity::BIGINT AS e, l_linenumber = 1 AS is_file FROM lineitem),
p AS (SELECT o_orderkey AS point, o_orderkey AS path, o_orderkey % 60 AS st FROM orders) SELECT point, arg_min(id, (is_file, e - s, id)) FILTER (id IS NOT NULL) AS id FROM p LEFT JOIN s ON p.path = s.path AND s.s <= p.st AND s.e >= p.st + 1 GROUP BY point""")
def smallest_span(spark, sf):
    l = B.t(spark, sf, "lineitem")
    spans = l.select(F.col("l_linenumber").alias("id"), F.col("l_orderkey").alias("path"), (F.col("l_linenumber") * 10).alias("s"), (F.col("l_linenumber") * 10 + F.round("l_quantity").cast("long")).alias("e"), (F.col("l_linenumber") == 1).alias("is_file"))
    o = B.t(spark, sf, "orders")
    return P.smallest_span(o.select(F.col("o_orderkey").alias("point"), F.col("o_orderkey").alias("path"), (F.col("o_orderkey") % 60).alias("start"), (F.col("o_orderkey") % 60 + 1).alias("end")), spans)


@query(f"""WITH {B.SQL_RELATIONS}, ca AS (SELECT DISTINCT source AS src, target AS dst FROM rl WHERE kind LIKE 'rust:%' AND kind NOT LIKE '%has_type'), ts AS (SELECT id FROM tg WHERE id LIKE 'supplier:%1'), me AS (SELECT id FROM tg WHERE id LIKE 'supplier:%4' OR id LIKE 'supplier:%6'),
d AS (SELECT src AS test, dst AS member FROM ca WHERE src IN (SELECT id FROM ts) AND dst IN (SELECT id FROM me))
SELECT test, member, 'direct' AS link FROM d UNION ALL (SELECT DISTINCT a.src, b.dst, 'via_helper' FROM ca a JOIN ca b ON a.dst = b.src WHERE a.src IN (SELECT id FROM ts) AND b.dst IN (SELECT id FROM me) AND a.dst NOT IN (SELECT id FROM ts) AND a.dst NOT IN (SELECT id FROM me) AND (a.src, b.dst) NOT IN (SELECT (test, member) FROM d))""")
def test_links(spark, sf):
    tg = B.targets(spark, sf)
    calls = B.relations(spark, sf).filter("kind like 'rust:%' and kind not like '%has_type'").select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()
    return P.test_links(calls, tg.filter("id like 'supplier:%1'").select("id"), tg.filter("id like 'supplier:%4' or id like 'supplier:%6'").select("id"))


@query("""WITH m AS (SELECT 'supplier:' || (p_partkey % 10 + 1) AS module, 'part:' || p_partkey AS id, p_size::BIGINT AS bytes, p_size % 4 = 0 AS is_public, p_partkey % 5 AS signals FROM part), z AS (SELECT module, sum(bytes) * 100 > 11000 * 45 AS large FROM m GROUP BY module)
SELECT module, id AS unit FROM m JOIN z USING (module) WHERE large AND (is_public OR signals > 0) UNION ALL SELECT module, module FROM z WHERE NOT large""")
def oversized_split(spark, sf):
    p = B.t(spark, sf, "part").select(F.concat(F.lit("supplier:"), (F.col("p_partkey") % 10 + 1).cast("string")).alias("module"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_size").cast("long").alias("bytes"), (F.col("p_size") % 4 == 0).alias("is_public"), (F.col("p_partkey") % 5).alias("signals"))
    return P.split_oversized(p, 11_000)

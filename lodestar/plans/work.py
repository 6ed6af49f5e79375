"""Queries over plans and records: profiles, applicability by policy, run records, invalidation, scopes, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar import bridge as B
from lodestar.functions.ids import derived_id
from lodestar.operators import graph as G
from lodestar.operators import planning as P
from lodestar.operators import report as R
from lodestar.operators import snapshot as S
from lodestar.operators import validation as V
from lodestar.plans.reviews import VIS
from lodestar.plans.runs import LATEST
from lodestar.plans.snapshots import sql_id
from lodestar.registry import query

c = F.col


@query(f"""WITH RECURSIVE {B.SQL_TARGETS}, {VIS}, cf AS (SELECT 'part:' || l_partkey AS target, count(*) AS evidence FROM lineitem GROUP BY 1)
SELECT {sql_id("unit", "tg.id", "'documentation'", "'1'")} AS unit, tg.id, effective AS visibility, coalesce(evidence, 0) AS evidence FROM tg JOIN ve ON tg.id = ve.id LEFT JOIN cf ON tg.id = cf.target WHERE inventory = 'represented' AND kind IN ('callable', 'record', 'module') AND effective = 'public'""")
def review_plan(spark, sf):
    tg = B.targets(spark, sf).drop("visibility").join(P.inherited_visibility(B.targets(spark, sf)).withColumnRenamed("effective", "visibility"), "id")
    ev = B.t(spark, sf, "lineitem").groupBy(F.concat(F.lit("part:"), c("l_partkey").cast("string")).alias("id")).agg(F.count(F.lit(1)).alias("evidence"))
    units = tg.filter("inventory = 'represented' and kind in ('callable', 'record', 'module') and visibility = 'public'")
    return units.join(ev, "id", "left").select(derived_id("unit", "id", F.lit("documentation"), F.lit("1")).alias("unit"), "id", "visibility", F.coalesce("evidence", F.lit(0)).alias("evidence"))


@query(f"""WITH {B.SQL_WORK}, oc AS (SELECT DISTINCT l_orderkey AS work_id, l_partkey AS artifact FROM lineitem) SELECT wk.run, count(*) AS outcomes, count(DISTINCT artifact) AS artifacts, count(*) FILTER (p_partkey IS NULL) AS missing FROM wk JOIN oc ON wk.work_id = oc.work_id LEFT JOIN part ON artifact = p_partkey GROUP BY wk.run""")
def run_records(spark, sf):
    oc = B.t(spark, sf, "lineitem").select(c("l_orderkey").alias("work_id"), c("l_partkey").alias("artifact")).distinct()
    j = B.work(spark, sf).select("work_id", "run").join(oc, "work_id").join(B.t(spark, sf, "part").select("p_partkey"), c("artifact") == c("p_partkey"), "left")
    return j.groupBy("run").agg(F.count(F.lit(1)).alias("outcomes"), F.count_distinct("artifact").alias("artifacts"), F.count_if(c("p_partkey").isNull()).alias("missing"))


@query(f"""WITH {B.SQL_ADJUDICATIONS}, {LATEST} SELECT count(*) FILTER (state = 'accepted') AS accepted, count(*) FILTER (state = 'rejected') AS rejected, count(*) FILTER (state = 'deferred') AS deferred, count(DISTINCT (run, expected_issue)) FILTER (expected_issue IS NOT NULL) AS issues FROM lr""")
def adjudication_summary(spark, sf):
    a = R.latest(B.adjudications(spark, sf))
    return a.agg(*[F.count_if(c("state") == s).alias(s) for s in ("accepted", "rejected", "deferred")], F.count_distinct(F.when(c("expected_issue").isNotNull(), F.struct("run", "expected_issue"))).alias("issues"))


@query(f"""WITH {B.SQL_ADJUDICATIONS}, {LATEST}, a AS (SELECT run, count(*) FILTER (state = 'accepted') AS x, count(*) FILTER (state = 'rejected') AS y, count(DISTINCT expected_issue) AS m FROM lr GROUP BY run), r AS (SELECT run, CASE WHEN x + y <> 0 THEN x * 10000 // (x + y) END AS p, m * 10000 // 50 AS rc FROM a)
SELECT run, 'min_precision_bp' AS rule, p AS value FROM r WHERE p < 8000 OR p IS NULL UNION ALL SELECT run, 'min_recall_bp', rc FROM r WHERE rc < 5000 OR rc IS NULL UNION ALL SELECT run, 'max_recall_bp', rc FROM r WHERE rc > 9000""")
def threshold_check(spark, sf):
    return V.threshold_violations(R.rates(R.latest(B.adjudications(spark, sf)), 50), {"precision_bp": 8000, "recall_bp": 5000}, {"recall_bp": 9000}, ci=False)


@query("""WITH d AS (SELECT p_partkey AS id, p_size FROM part) SELECT id, unnest(list_filter([CASE WHEN p_size % 3 = 0 THEN 'missing_dimension' END, CASE WHEN p_size % 5 = 0 THEN 'repeated_dimension' END, CASE WHEN p_size % 2 = 0 AND p_size % 7 = 0 THEN 'passed_with_deficiency' END, CASE WHEN p_size % 11 = 0 THEN 'finding_without_citation' END], lambda x: x IS NOT NULL)) AS error FROM d""")
def assessment_validation(spark, sf):
    s = c("p_size")
    dim = lambda n, state: F.struct(F.lit(n).alias("name"), state.alias("state"))
    weak = F.when(s % 7 == 0, "deficient").otherwise("fine")
    given = F.array_compact(F.array(dim("clarity", weak), F.when(s % 3 != 0, dim("safety", F.lit("fine"))), F.when(s % 5 == 0, dim("clarity", weak))))
    cites = F.array(F.when(s % 11 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("e1"))))
    a = B.t(spark, sf, "part").select(c("p_partkey").alias("id"), F.when(s % 2 == 0, "passed").otherwise("suggestion").alias("result"), given.alias("given"), cites.alias("citations"))
    return V.assessment_errors(a, ["clarity", "safety"])


@query("""WITH t AS (SELECT 'part:' || p_partkey AS id, 'rust' AS adapter, p_name AS name, p_size AS size FROM part UNION ALL SELECT 'part:' || p_partkey, 'generic', CASE WHEN p_partkey % 10 = 0 THEN upper(p_name) || '!' ELSE p_name END, p_size FROM part WHERE p_partkey % 2 = 0)
SELECT id, string_agg(DISTINCT adapter, ',' ORDER BY adapter) AS owners, count(DISTINCT (name, size)) AS versions, count(DISTINCT (name, size)) > 1 AS conflict FROM t GROUP BY id""")
def adapter_merge(spark, sf):
    p, k = B.t(spark, sf, "part"), c("p_partkey")
    row = lambda adapter, name: [F.concat(F.lit("part:"), k.cast("string")).alias("id"), F.lit(adapter).alias("adapter"), name.alias("name"), c("p_size").alias("size")]
    both = p.select(*row("rust", c("p_name"))).unionByName(p.filter(k % 2 == 0).select(*row("generic", F.when(k % 10 == 0, F.concat(F.upper("p_name"), F.lit("!"))).otherwise(c("p_name")))))
    return V.merge_adapters(both, ["name", "size"])


@query(f"""WITH RECURSIVE {B.SQL_TARGETS}, ts(id) AS (SELECT id FROM tg WHERE kind = 'module' AND id LIKE '%3' UNION SELECT tg.id FROM tg JOIN ts ON tg.parent = ts.id) SELECT id FROM ts""")
def test_code(spark, sf):
    tg = B.targets(spark, sf)
    seeds = tg.filter("kind = 'module' and id like '%3'").select(c("id").alias("root"))
    return G.closure(tg.filter("parent is not null").select(c("parent").alias("src"), c("id").alias("dst")), seeds).select(c("node").alias("id")).distinct()


@query(f"""WITH {B.SQL_RELATIONS}, tc AS (SELECT id FROM tg WHERE id LIKE 'part:%9'), ow AS (SELECT DISTINCT parent AS module FROM tg WHERE kind IN ('callable', 'record', 'field')) SELECT DISTINCT source AS test, target AS module FROM rl WHERE kind = 'rust:has_type' AND source IN (SELECT id FROM tc) AND target IN (SELECT module FROM ow)""")
def importing_tests(spark, sf):
    tg = B.targets(spark, sf)
    owners = tg.filter("kind in ('callable', 'record', 'field')").select(c("parent").alias("target")).distinct()
    tests = tg.filter("id like 'part:%9'").select(c("id").alias("source"))
    r = B.relations(spark, sf).filter("kind = 'rust:has_type'").join(tests, "source", "left_semi").join(owners, "target", "left_semi")
    return r.select(c("source").alias("test"), c("target").alias("module")).distinct()


@query(f"""WITH {B.SQL_TARGETS}, w AS (SELECT id FROM tg WHERE kind = 'package'), m AS (SELECT s.id, s.parent, s.inventory FROM tg s WHERE s.kind = 'module') SELECT w.id AS scope, count(m.id) AS prerequisites, count(m.id) FILTER (m.inventory = 'represented') AS ready, count(m.id) = count(m.id) FILTER (m.inventory = 'represented') AS may_start FROM w LEFT JOIN m ON m.parent = w.id GROUP BY w.id""")
def prerequisites(spark, sf):
    tg = B.targets(spark, sf)
    m = tg.filter("kind = 'module'").select(c("id").alias("m"), c("parent"), c("inventory").alias("i"))
    j = tg.filter("kind = 'package'").select(c("id").alias("scope")).join(m, c("scope") == c("parent"), "left")
    return j.groupBy("scope").agg(F.count("m").alias("prerequisites"), F.count_if((c("i") == "represented") & c("m").isNotNull()).alias("ready")).withColumn("may_start", c("prerequisites") == c("ready"))


@query("""SELECT p_partkey AS id, regexp_matches(n, '_') OR regexp_matches(n, '[a-z][A-Z]|[A-Z][a-z]+[A-Z]') AS is_identifier FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'snake_case' WHEN 1 THEN 'camelCase' WHEN 2 THEN 'plain' ELSE 'Word' END AS n FROM part)""")
def code_identifiers(spark, sf):
    k = c("p_partkey")
    name = F.when(k % 4 == 0, "a::snake_case").when(k % 4 == 1, "b::camelCase").when(k % 4 == 2, "c::plain").otherwise("Word")
    return B.t(spark, sf, "part").select(k.alias("id"), V.code_identifier(name).alias("is_identifier"))


@query(f"""WITH RECURSIVE {B.SQL_RELATIONS}, ed AS (SELECT DISTINCT source, target, CASE WHEN kind LIKE '%calls' THEN 'calls' WHEN kind LIKE '%implements' THEN 'implements' ELSE 'references' END AS relation FROM rl WHERE kind NOT LIKE '%contains'), ch AS (SELECT id FROM tg WHERE id LIKE 'supplier:%17'),
rc(id) AS (SELECT id FROM ch UNION SELECT ed.source FROM rc JOIN ed ON ed.target = rc.id), a AS (SELECT id FROM rc WHERE id IN (SELECT id FROM tg)),
up(id) AS (SELECT parent FROM tg WHERE id IN (SELECT id FROM a) AND parent IS NOT NULL UNION SELECT tg.parent FROM up JOIN tg ON up.id = tg.id WHERE tg.parent IS NOT NULL), e AS (SELECT id FROM a UNION SELECT id FROM up WHERE id IN (SELECT id FROM tg))
SELECT id, 'changed' AS reason, id AS via FROM ch UNION ALL SELECT source, relation, target FROM ed WHERE target IN (SELECT id FROM a) AND source IN (SELECT id FROM tg)
UNION ALL SELECT parent, 'contains', id FROM tg WHERE id IN (SELECT id FROM e) AND parent IN (SELECT id FROM tg)
UNION ALL SELECT s.id, 'conservative', w.id FROM tg s JOIN tg w ON s.parent = w.parent WHERE w.inventory IN ('failed', 'unsupported') AND w.id IN (SELECT id FROM e) AND s.id NOT IN (SELECT id FROM e)""")
def invalidation(spark, sf):
    tg = B.targets(spark, sf)
    return G.invalidation(B.relations(spark, sf), tg, tg.filter("id like 'supplier:%17'").select("id"))


@query(f"""WITH {B.SQL_TARGETS}, ad AS (SELECT id, 'rust' AS adapter FROM tg UNION ALL SELECT id, 'generic' FROM tg WHERE kind = 'record') SELECT tg.id, CASE kind WHEN 'callable' THEN 'function' WHEN 'record' THEN 'type' ELSE kind END AS label, name, inventory, string_agg(adapter, ',' ORDER BY adapter) AS owners FROM tg JOIN ad ON tg.id = ad.id GROUP BY ALL""")
def target_listing(spark, sf):
    tg = B.targets(spark, sf)
    owners = tg.select("id", F.lit("rust").alias("adapter")).unionByName(tg.filter("kind = 'record'").select("id", F.lit("generic").alias("adapter"))).groupBy("id").agg(F.concat_ws(",", F.array_sort(F.collect_list("adapter"))).alias("owners"))
    label = F.when(c("kind") == "callable", "function").when(c("kind") == "record", "type").otherwise(c("kind"))
    return tg.join(owners, "id").select("id", label.alias("label"), "name", "inventory", "owners")


@query("""SELECT c_custkey AS run_id, CASE WHEN c_custkey % 4 = 0 THEN 'create' WHEN c_custkey % 9 = 0 THEN 'conflict' ELSE 'same' END AS action FROM customer""")
def create_run(spark, sf):
    from lodestar.operators import queue as Q

    k, cu = c("c_custkey"), B.t(spark, sf, "customer")
    had = cu.filter(k % 4 != 0).select(k.alias("work_id"), F.when(k % 9 == 0, "other").otherwise(c("c_mktsegment")).alias("payload"))
    got = Q.admit(had, cu.select(k.alias("work_id"), c("c_mktsegment").alias("payload")))
    return got.select(c("work_id").alias("run_id"), F.when(c("action") == "insert", "create").otherwise(c("action")).alias("action"))


@query("""WITH a AS (SELECT p_partkey AS id, 'docs/' || p_partkey || '.md' AS path, CASE WHEN p_partkey % 2 = 0 THEN 'ADR ' ELSE 'RFC_' END || p_partkey AS identifier FROM part), k AS (SELECT o_orderkey AS q, CASE o_orderkey % 4 WHEN 0 THEN 'docs/' || o_orderkey || '.md' WHEN 1 THEN 'rfc-' || o_orderkey WHEN 2 THEN o_orderkey::VARCHAR ELSE 'none' END AS key FROM orders)
SELECT DISTINCT key, id FROM k JOIN a ON (q % 4 IN (0, 2) AND a.id = q) OR (q % 4 = 1 AND a.id = q)""")
def design_lookup(spark, sf):
    from lodestar.operators import design as D

    p, o, pk, ok = B.t(spark, sf, "part"), B.t(spark, sf, "orders"), c("p_partkey"), c("o_orderkey")
    s = lambda x: x.cast("string")
    a = p.select(pk.alias("id"), F.concat(F.lit("docs/"), s(pk), F.lit(".md")).alias("path"), F.concat(F.when(pk % 2 == 0, "ADR ").otherwise("RFC_"), s(pk)).alias("identifier"))
    key = F.when(ok % 4 == 0, F.concat(F.lit("docs/"), s(ok), F.lit(".md"))).when(ok % 4 == 1, F.concat(F.lit("rfc-"), s(ok))).when(ok % 4 == 2, s(ok)).otherwise("none")
    return D.lookup(a, o.select(key.alias("key")).distinct())


@query("""WITH l AS (SELECT l_suppkey AS artifact, l_partkey AS target, CASE WHEN l_linenumber = 1 THEN 'governs' ELSE 'mentions' END AS kind FROM lineitem) SELECT DISTINCT artifact, target FROM l WHERE kind = 'governs'""")
def governed_targets(spark, sf):
    from lodestar.operators import design as D

    l = B.t(spark, sf, "lineitem").select(c("l_suppkey").alias("artifact"), c("l_partkey").alias("target"), F.when(c("l_linenumber") == 1, "governs").otherwise("mentions").alias("kind"))
    return D.governed(l, "artifact")

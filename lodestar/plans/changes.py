"""Queries that change records: leases with their events, adjudications, cache entries; and checks of damaged data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar import bridge as B
from lodestar.operators import graph as G
from lodestar.operators import queue as Q
from lodestar.operators import snapshot as S
from lodestar.registry import query

c = F.col


LEASED = f"""{B.SQL_WORK}, {B.SQL_EVENTS}, av AS (SELECT *, row_number() OVER (PARTITION BY adapter, policy ORDER BY work_id) AS rn FROM wk WHERE state = 'pending' OR (state = 'leased' AND lease_until <= {B.NOW})), tk AS (SELECT work_id, attempts + 1 AS attempts FROM av WHERE rn <= 3)"""


@query(f"WITH {LEASED} SELECT wk.work_id, CASE WHEN tk.work_id IS NOT NULL THEN 'leased' ELSE state END AS state, coalesce(tk.attempts, wk.attempts) AS attempts, CASE WHEN tk.work_id IS NOT NULL THEN {B.NOW} + 60000 ELSE lease_until END AS lease_until FROM wk LEFT JOIN tk ON tk.work_id = wk.work_id")
def leased_work(spark, sf):
    after, _ = Q.lease(B.work(spark, sf), B.events(spark, sf), B.NOW, 60_000, 3, ["adapter", "policy"])
    return after.select("work_id", "state", "attempts", "lease_until")


@query(f"WITH {LEASED} SELECT (SELECT max(sequence) FROM ev) + row_number() OVER (ORDER BY work_id) AS sequence, work_id, 'leased' AS kind, {B.NOW}::BIGINT AS at_millis FROM tk")
def lease_events(spark, sf):
    return Q.lease(B.work(spark, sf), B.events(spark, sf), B.NOW, 60_000, 3, ["adapter", "policy"])[1]


# two requests a finding: the first expects the latest revision (or none) but for every fourth, the second what the first would make
@query(f"""WITH {B.SQL_ADJUDICATIONS}, h AS (SELECT run, finding, max(revision) AS had FROM ad WHERE finding % 3 <> 0 GROUP BY ALL),
q AS (SELECT l.doc_id % 5 AS run, l.doc_id AS finding, had, CASE WHEN l.doc_id % 4 = 0 THEN 7 ELSE had END AS e1 FROM labels l LEFT JOIN h ON h.finding = l.doc_id),
r AS (SELECT *, e1 IS NOT DISTINCT FROM had AS ok1, coalesce(had, 0) + 1 AS next FROM q)
SELECT run, finding, 1 AS at, CASE WHEN ok1 THEN 'recorded' ELSE 'conflict' END AS result, CASE WHEN ok1 THEN next END AS revision FROM r
UNION ALL SELECT run, finding, 2, CASE WHEN ok1 THEN 'recorded' ELSE 'conflict' END, CASE WHEN ok1 THEN next + 1 END FROM r""")
def adjudication_records(spark, sf):
    history = B.adjudications(spark, sf).filter("finding % 3 != 0")
    latest = history.groupBy("finding").agg(F.max("revision").alias("had"))
    asked = B.t(spark, sf, "labels").select((c("doc_id") % 5).alias("run"), c("doc_id").alias("finding")).join(latest, "finding", "left")
    first = F.struct(F.lit(1).alias("at"), F.when(c("finding") % 4 == 0, F.lit(7).cast("long")).otherwise(c("had")).alias("expected"))
    second = F.struct(F.lit(2).alias("at"), (F.coalesce("had", F.lit(0).cast("long")) + 1).alias("expected"))
    return Q.record_adjudications(history, asked.select("run", "finding", F.explode(F.array(first, second)).alias("r")).select("run", "finding", "r.*"))


@query(f"""WITH {B.SQL_CACHE}, u AS (SELECT l_orderkey AS entry, count(*) AS n, max(epoch_ms(l_shipdate)) AS at FROM lineitem GROUP BY 1)
SELECT ca.entry, (hits + coalesce(n, 0))::BIGINT AS hits, greatest(cached_at, u.at) AS used_at FROM ca LEFT JOIN u ON u.entry = ca.entry""")
def cache_touch(spark, sf):
    uses = B.t(spark, sf, "lineitem").select(c("l_orderkey").alias("entry"), F.unix_millis(c("l_shipdate").cast("timestamp")).alias("at"))
    touched = Q.cache_touch(B.cache(spark, sf).withColumn("used_at", c("cached_at")), uses)
    return touched.select("entry", "hits", "used_at")


@query(f"""WITH {B.SQL_CACHE}, nw AS (SELECT target, policy, fingerprint, entry + 1 AS entry, cached_at + 1000 AS cached_at FROM ca WHERE entry % 2 = 0), b AS (SELECT target, policy, fingerprint, arg_max(entry, (cached_at, entry)) AS entry, arg_max(cached_at, (cached_at, entry)) AS cached_at FROM nw GROUP BY ALL)
SELECT target, policy, fingerprint, entry, cached_at FROM ca WHERE (target, policy, fingerprint) NOT IN (SELECT (target, policy, fingerprint) FROM b) UNION ALL SELECT target, policy, fingerprint, entry, cached_at FROM b""")
def cache_insert(spark, sf):
    cache = B.cache(spark, sf).select("target", "policy", "fingerprint", "entry", "cached_at")
    new = cache.filter("entry % 2 = 0").withColumn("entry", c("entry") + 1).withColumn("cached_at", c("cached_at") + 1000)
    return Q.cache_insert(cache, new, ["target", "policy", "fingerprint"])


DAMAGED = f"""{B.SQL_RELATIONS}, t0 AS (SELECT * FROM tg WHERE id NOT LIKE '%7'), td AS (SELECT id, CASE WHEN id LIKE '%9' THEN ' ' WHEN id LIKE '%8' THEN NULL ELSE name END AS name, parent FROM t0 UNION ALL SELECT id, name, parent FROM t0 WHERE id LIKE '%3')"""


@query(f"""WITH {DAMAGED} SELECT DISTINCT 'unknown_target' AS rule, target AS id FROM rl WHERE target NOT IN (SELECT id FROM td) UNION ALL SELECT DISTINCT 'unknown_source', source FROM rl WHERE source NOT IN (SELECT id FROM td)
UNION ALL SELECT 'missing_parent', id FROM td WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM td) UNION ALL SELECT 'duplicate_id', id FROM td GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'blank_name', id FROM td WHERE trim(name) = '' OR name IS NULL""")
def damaged_snapshot_violations(spark, sf):
    tg = B.targets(spark, sf).filter("id not like '%7'")
    name = F.when(c("id").endswith("9"), " ").when(c("id").endswith("8"), None).otherwise(c("name"))
    return S.violations(tg.withColumn("name", name).unionByName(tg.filter("id like '%3'")), B.relations(spark, sf))


@query(f"""WITH RECURSIVE {B.SQL_RELATIONS}, e AS (SELECT DISTINCT source AS src, target AS dst FROM rl WHERE kind NOT LIKE '%contains'), r(root, node) AS (SELECT src, dst FROM e WHERE src LIKE 'supplier:%' UNION SELECT r.root, e.dst FROM r JOIN e ON r.node = e.src),
m AS (SELECT DISTINCT a.root, a.node FROM r a JOIN r b ON a.root = b.node AND a.node = b.root), c AS (SELECT root AS node, min(node) AS label, count(*) AS size FROM m GROUP BY root) SELECT node, label, size FROM c""")
def relation_cycles(spark, sf):
    return G.cycles(B.relations(spark, sf).filter("kind not like '%contains'").select(c("source").alias("src"), c("target").alias("dst")))


@query("""SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS want FROM conversations WHERE (conv_id + turn) % 5 <> 2) WHERE turn <> want""")
def attempt_gaps(spark, sf):
    t = B.t(spark, sf, "conversations").filter((c("conv_id") + c("turn")) % 5 != 2).withColumn("want", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    return t.filter("turn != want").select("conv_id", "turn")

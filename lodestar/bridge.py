"""The driver's tables seen as audit records: files, targets, relations, events, work, findings, adjudications, cache.

Each view is a DataFrame here and a SQL text of the same rows for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path():
    ext = F.when(F.col("lang") == "en", ".rs").when(F.col("lang") == "de", ".py").when(F.col("lang") == "fr", ".md").otherwise(".toml")
    top = F.when(F.col("doc_id") % 13 == 0, "tests/").when(F.col("doc_id") % 17 == 0, "target/").when(F.col("doc_id") % 19 == 0, "vendor/").otherwise("")
    return F.concat(top, F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), ext)


SQL_PATH = """concat(CASE WHEN doc_id % 13 = 0 THEN 'tests/' WHEN doc_id % 17 = 0 THEN 'target/' WHEN doc_id % 19 = 0 THEN 'vendor/' ELSE '' END, source, '/', doc_id::VARCHAR,
 CASE lang WHEN 'en' THEN '.rs' WHEN 'de' THEN '.py' WHEN 'fr' THEN '.md' ELSE '.toml' END)"""


def files(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """path, content (hash, null for every 23rd), size, class of the baseline or the current snapshot."""
    from lodestar.functions.ids import content_hash
    from lodestar.functions.text import file_class

    d = t(spark, sf_dir, "documents")
    d = d.filter("doc_id % 7 != 0") if side == "baseline" else d.filter("doc_id % 11 != 0")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")) if side == "current" else F.col("text")
    d = d.select(_path().alias("path"), F.when(F.col("doc_id") % 23 != 0, content_hash(text)).alias("content"), F.char_length(text).cast("long").alias("size"))
    return d.withColumn("class", file_class("path"))


SQL_CLASS = """CASE WHEN path LIKE 'target/%' THEN 'generated_input' WHEN path LIKE '%.rs' OR path LIKE '%.py' THEN 'source' WHEN path LIKE '%.toml' THEN 'configuration' WHEN path LIKE '%.md' THEN 'design_document' ELSE 'unsupported' END"""
SQL_FILES = f"""fb AS (SELECT *, {SQL_CLASS} AS class FROM (SELECT {SQL_PATH} AS path, CASE WHEN doc_id % 23 <> 0 THEN sha256(text) END AS content, length(text) AS size FROM documents WHERE doc_id % 7 <> 0)),
fc AS (SELECT *, {SQL_CLASS} AS class FROM (SELECT {SQL_PATH} AS path, CASE WHEN doc_id % 23 <> 0 THEN sha256(CASE WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END) END AS content, length(text) + (CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) AS size FROM documents WHERE doc_id % 11 <> 0)),
sd AS (SELECT coalesce(b.path, c.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' WHEN b.content IS DISTINCT FROM c.content OR b.size <> c.size OR b.class <> c.class THEN 'modified' ELSE 'unchanged' END AS change FROM fb b FULL OUTER JOIN fc c ON b.path = c.path)"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, name, parent, visibility, inventory, adapter: a workspace of regions, nations, suppliers and parts."""
    vis = lambda k: F.when(F.col(k) % 4 == 0, "public").when(F.col(k) % 4 == 1, "private").when(F.col(k) % 4 == 2, "crate").otherwise("inherited")
    row = lambda i, kind, name, parent, v, inv: [F.concat(F.lit(i[0]), F.col(i[1]).cast("string")).alias("id"), kind.alias("kind"), F.col(name).alias("name"), parent.alias("parent"), v.alias("visibility"), inv.alias("inventory")]
    to = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    fine = F.lit("represented")
    r = t(spark, sf_dir, "region").select(*row(("region:", "r_regionkey"), F.lit("workspace"), "r_name", F.lit(None).cast("string"), F.lit("public"), fine))
    n = t(spark, sf_dir, "nation").select(*row(("nation:", "n_nationkey"), F.lit("package"), "n_name", to("region:", F.col("n_regionkey")), F.lit("inherited"), fine))
    s = t(spark, sf_dir, "supplier").select(*row(("supplier:", "s_suppkey"), F.lit("module"), "s_name", to("nation:", F.col("s_nationkey")), vis("s_suppkey"), F.when(F.col("s_acctbal") < 0, "failed").otherwise("represented")))
    kind = F.when(F.col("p_size") % 3 == 0, "callable").when(F.col("p_size") % 3 == 1, "record").otherwise("field")
    state = F.when(F.col("p_size") % 10 == 0, "partial").when(F.col("p_size") % 10 == 1, "unsupported").otherwise("represented")
    p = t(spark, sf_dir, "part").select(*row(("part:", "p_partkey"), kind, "p_name", to("supplier:", F.col("p_partkey") % 10 + 1), vis("p_size"), state))
    return r.unionByName(n).unionByName(s).unionByName(p)


SQL_TARGETS = """tg AS (
 SELECT 'region:' || r_regionkey AS id, 'workspace' AS kind, r_name AS name, NULL::VARCHAR AS parent, 'public' AS visibility, 'represented' AS inventory FROM region
 UNION ALL SELECT 'nation:' || n_nationkey, 'package', n_name, 'region:' || n_regionkey, 'inherited', 'represented' FROM nation
 UNION ALL SELECT 'supplier:' || s_suppkey, 'module', s_name, 'nation:' || s_nationkey, CASE s_suppkey % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'private' WHEN 2 THEN 'crate' ELSE 'inherited' END, CASE WHEN s_acctbal < 0 THEN 'failed' ELSE 'represented' END FROM supplier
 UNION ALL SELECT 'part:' || p_partkey, CASE p_size % 3 WHEN 0 THEN 'callable' WHEN 1 THEN 'record' ELSE 'field' END, p_name, 'supplier:' || (p_partkey % 10 + 1), CASE p_size % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'private' WHEN 2 THEN 'crate' ELSE 'inherited' END, CASE p_size % 10 WHEN 0 THEN 'partial' WHEN 1 THEN 'unsupported' ELSE 'represented' END FROM part)"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, kind: calls among suppliers, references of parts, containment."""
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    n = F.lit(97)
    sup = lambda c: F.concat(F.lit("supplier:"), c.cast("string"))
    calls = s.select(sup(F.col("k")).alias("source"), sup((F.col("k") * 3) % n + 1).alias("target"), F.when(F.col("k") % 3 == 0, "rust:implements").otherwise("rust:calls").alias("kind"))
    deps = s.filter("k % 4 != 0").select(sup(F.col("k")).alias("source"), sup((F.col("k") * 5) % n + 1).alias("target"), F.lit("rust:depends_on").alias("kind"))
    refs = t(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("source"), sup(F.col("p_partkey") % 50 + 1).alias("target"), F.lit("rust:has_type").alias("kind"))
    held = targets(spark, sf_dir).filter("parent is not null").select(F.col("parent").alias("source"), F.col("id").alias("target"), F.lit("core:contains").alias("kind"))
    return calls.unionByName(deps).unionByName(refs).unionByName(held).distinct()


SQL_RELATIONS = (
    SQL_TARGETS
    + """, rl AS (
 SELECT 'supplier:' || s_suppkey AS source, 'supplier:' || ((s_suppkey * 3) % 97 + 1) AS target, CASE WHEN s_suppkey % 3 = 0 THEN 'rust:implements' ELSE 'rust:calls' END AS kind FROM supplier
 UNION SELECT 'supplier:' || s_suppkey, 'supplier:' || ((s_suppkey * 5) % 97 + 1), 'rust:depends_on' FROM supplier WHERE s_suppkey % 4 <> 0
 UNION SELECT 'part:' || p_partkey, 'supplier:' || (p_partkey % 50 + 1), 'rust:has_type' FROM part
 UNION SELECT parent, id, 'core:contains' FROM tg WHERE parent IS NOT NULL)"""
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sequence, work_id, kind, at_millis: the queue's log."""
    kind = F.col("event_type")
    k = F.when(kind == "signup", "admitted").when(kind == "view", "leased").when(kind == "click", "heartbeat").when(kind == "purchase", "succeeded").when(F.col("event_id") % 2 == 0, "retry_scheduled").otherwise("failed")
    return t(spark, sf_dir, "events").select(F.col("event_id").alias("sequence"), F.col("user_id").alias("work_id"), k.alias("kind"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_millis"))


SQL_EVENTS = """ev AS (SELECT event_id AS sequence, user_id AS work_id, CASE event_type WHEN 'signup' THEN 'admitted' WHEN 'view' THEN 'leased' WHEN 'click' THEN 'heartbeat' WHEN 'purchase' THEN 'succeeded' ELSE CASE WHEN event_id % 2 = 0 THEN 'retry_scheduled' ELSE 'failed' END END AS kind, epoch_us(ts) // 1000 AS at_millis FROM events)"""

#: The clock of the batch queries.
NOW = 900_000_000_000


def work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """work_id, run, state, attempts, lease_until, coverage keys."""
    o = F.col("o_orderstatus")
    state = F.when(F.col("o_orderpriority").startswith("5"), "failed").when(o == "O", "pending").when(o == "P", "leased").otherwise(F.when(F.col("o_orderkey") % 10 == 0, "cancelled").otherwise("succeeded"))
    return t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("work_id"), (F.col("o_custkey") % 4).cast("long").alias("run"), state.alias("state"), (F.col("o_orderkey") % 5).cast("long").alias("attempts"),
        F.when(state == "leased", F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("lease_until"), F.substring("o_orderpriority", 1, 1).alias("adapter"),
        F.concat(F.lit("p"), (F.col("o_orderkey") % 7).cast("string")).alias("policy"), F.col("o_custkey").alias("target"),
    )


SQL_WORK = """wk0 AS (SELECT *, CASE WHEN starts_with(o_orderpriority, '5') THEN 'failed' WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'P' THEN 'leased' WHEN o_orderkey % 10 = 0 THEN 'cancelled' ELSE 'succeeded' END AS state FROM orders),
wk AS (SELECT o_orderkey AS work_id, (o_custkey % 4)::BIGINT AS run, state, (o_orderkey % 5)::BIGINT AS attempts, CASE WHEN state = 'leased' THEN epoch_ms(o_orderdate) END AS lease_until, substr(o_orderpriority, 1, 1) AS adapter, 'p' || (o_orderkey % 7) AS policy, o_custkey AS target FROM wk0)"""


def findings(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """id, policy, target, title, severity, confidence, description of one run: line items of even or odd orders."""
    q = F.col("l_quantity")
    sev = F.when(q >= 45, "critical").when(q >= 35, "high").when(q >= 20, "medium").when(q >= 8, "low").otherwise("note")
    l = t(spark, sf_dir, "lineitem")
    l = l.filter("l_orderkey % 3 != 0") if side == "baseline" else l.filter("l_orderkey % 5 != 0")
    shift = F.when(F.col("l_orderkey") % 7 == 0, F.lit("-b" if side == "baseline" else "-c")).otherwise(F.lit(""))
    return l.select(
        F.concat_ws("", F.concat(F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")), shift).alias("id"), F.concat(F.lit("policy-"), "l_returnflag").alias("policy"),
        F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target"), F.concat(F.lit(" Issue "), F.col("l_linestatus"), F.lit(" "), (F.col("l_suppkey") % 10).cast("string"), F.lit(" ")).alias("title"), sev.alias("severity"),
        F.round(F.col("l_discount") * 10000).cast("int").alias("confidence"), F.concat(F.lit("tax "), F.col("l_linenumber").cast("string")).alias("description"),
    )


def _sql_findings(name: str, mod: int, mark: str) -> str:
    return f"""{name} AS (SELECT l_orderkey || '.' || l_linenumber || CASE WHEN l_orderkey % 7 = 0 THEN '{mark}' ELSE '' END AS id, 'policy-' || l_returnflag AS policy, 'part:' || l_partkey AS target, ' Issue ' || l_linestatus || ' ' || (l_suppkey % 10) || ' ' AS title,
 CASE WHEN l_quantity >= 45 THEN 'critical' WHEN l_quantity >= 35 THEN 'high' WHEN l_quantity >= 20 THEN 'medium' WHEN l_quantity >= 8 THEN 'low' ELSE 'note' END AS severity, round(l_discount * 10000)::INTEGER AS confidence, 'tax ' || l_linenumber AS description FROM lineitem WHERE l_orderkey % {mod} <> 0)"""


SQL_FINDINGS = _sql_findings("bf", 3, "-b") + ", " + _sql_findings("cf", 5, "-c")


def adjudications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, finding, revision, state, expected_issue, reviewer: three revisions at most."""
    l = t(spark, sf_dir, "labels").withColumn("revision", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 3).cast("int") + 1)))
    state = F.when((F.col("quality") == 1) & (F.col("revision") % 2 == 1), "accepted").when(F.col("toxic") == 1, "deferred").otherwise("rejected")
    return l.select((F.col("doc_id") % 5).alias("run"), F.col("doc_id").alias("finding"), F.col("revision").cast("long").alias("revision"), state.alias("state"), F.when((state == "accepted") & (F.col("doc_id") % 4 != 0), F.col("doc_id") % 50).alias("expected_issue"))


SQL_ADJUDICATIONS = """ad0 AS (SELECT doc_id, quality, toxic, unnest(range(1, (doc_id % 3 + 2)::BIGINT)) AS revision FROM labels),
ad1 AS (SELECT *, CASE WHEN quality = 1 AND revision % 2 = 1 THEN 'accepted' WHEN toxic = 1 THEN 'deferred' ELSE 'rejected' END AS state FROM ad0),
ad AS (SELECT doc_id % 5 AS run, doc_id AS finding, revision::BIGINT AS revision, state, CASE WHEN state = 'accepted' AND doc_id % 4 <> 0 THEN doc_id % 50 END AS expected_issue FROM ad1)"""


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target, policy, fingerprint, cached_at, expires_at (null: never), hits, bytes."""
    o = t(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0")
    at = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return o.select(F.col("o_custkey").alias("target"), F.concat(F.lit("p"), (F.col("o_orderkey") % 7).cast("string")).alias("policy"), (F.col("o_orderkey") % 11).alias("fingerprint"), F.col("o_orderkey").alias("entry"), at.alias("cached_at"), F.when(F.col("o_orderkey") % 4 != 0, at + (F.col("o_orderkey") % 100) * 86_400_000).alias("expires_at"), (F.col("o_orderkey") % 6).alias("hits"), F.floor("o_totalprice").cast("long").alias("bytes"))


SQL_CACHE = """ca AS (SELECT o_custkey AS target, 'p' || (o_orderkey % 7) AS policy, o_orderkey % 11 AS fingerprint, o_orderkey AS entry, epoch_ms(o_orderdate) AS cached_at, CASE WHEN o_orderkey % 4 <> 0 THEN epoch_ms(o_orderdate) + (o_orderkey % 100) * 86400000 END AS expires_at, o_orderkey % 6 AS hits, floor(o_totalprice)::BIGINT AS bytes FROM orders WHERE o_orderkey % 3 = 0)"""

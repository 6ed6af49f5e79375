"""Queries over snapshots: classes, diffs, change sets, drift, identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar import bridge as B
from lodestar.functions import ids, text
from lodestar.operators import snapshot as S
from lodestar.registry import query

DIFF = ["content", "size", "class"]


def changes(spark, sf):
    return S.diff(B.files(spark, sf, "baseline"), B.files(spark, sf, "current"), "path", DIFF)


@query(f"WITH {B.SQL_FILES} SELECT class, count(*) AS files, sum(size)::BIGINT AS bytes FROM fc GROUP BY class")
def file_class_counts(spark, sf):
    return B.files(spark, sf, "current").groupBy("class").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query(f"WITH {B.SQL_FILES} SELECT path, change FROM sd")
def snapshot_diff(spark, sf):
    return changes(spark, sf)


@query(f"WITH {B.SQL_FILES} SELECT change, count(*) AS files FROM sd GROUP BY change")
def snapshot_diff_summary(spark, sf):
    return changes(spark, sf).groupBy("change").agg(F.count(F.lit(1)).alias("files"))


@query(f"WITH {B.SQL_FILES} SELECT path FROM sd WHERE change <> 'unchanged'")
def changed_paths(spark, sf):
    return S.changed_paths(changes(spark, sf))


@query(f"WITH {B.SQL_FILES} SELECT path FROM sd WHERE change IN ('added', 'modified')")
def directly_changed(spark, sf):
    return S.directly_changed(changes(spark, sf))


@query(f"WITH {B.SQL_FILES} SELECT b.path, CASE WHEN c.path IS NULL THEN 'missing' ELSE 'modified' END AS drift FROM fb b LEFT JOIN fc c ON b.path = c.path WHERE c.path IS NULL OR b.content IS NULL OR b.content IS DISTINCT FROM c.content")
def working_tree_drift(spark, sf):
    return S.drift(B.files(spark, sf, "baseline"), B.files(spark, sf, "current"))


FRAME = "from_hex(printf('%016x', octet_length(encode({0})))) || encode({0})"


def sql_id(namespace: str, *parts: str) -> str:
    return "sha256(" + " || ".join(FRAME.format(p) for p in ("'id-v1'", f"'{namespace}'", *parts)) + ")"


@query(f"SELECT p_partkey, {sql_id('target', 'p_name', 'p_brand')} AS target_id FROM part")
def id_derivation(spark, sf):
    return B.t(spark, sf, "part").select("p_partkey", ids.derived_id("target", "p_name", "p_brand").alias("target_id"))


@query("SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def content_store(spark, sf):
    d = B.t(spark, sf, "documents")
    return d.groupBy(ids.content_hash("text").alias("content_hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))


@query("""SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS claim FROM documents""")
def normalized_claims(spark, sf):
    return B.t(spark, sf, "documents").select("doc_id", text.normalize_claim("text").alias("claim"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, translate(lower(trim(p_type)), ' _', '--') AS identifier FROM part""")
def slugs_and_identifiers(spark, sf):
    return B.t(spark, sf, "part").select("p_partkey", text.slugify(F.concat("p_name", F.lit(" "), "p_type")).alias("slug"), text.normalize_identifier("p_type").alias("identifier"))


@query("""SELECT o_orderkey, concat(o_orderkey % 50, CASE o_orderkey % 5 WHEN 0 THEN 'd' WHEN 1 THEN 'h' WHEN 2 THEN 'm' WHEN 3 THEN 's' ELSE '' END) AS spec,
 (o_orderkey % 50) * CASE o_orderkey % 5 WHEN 1 THEN 3600 WHEN 2 THEN 60 WHEN 3 THEN 1 ELSE 86400 END AS seconds FROM orders""")
def durations(spark, sf):
    k = F.col("o_orderkey")
    unit = F.when(k % 5 == 0, "d").when(k % 5 == 1, "h").when(k % 5 == 2, "m").when(k % 5 == 3, "s").otherwise("")
    spec = F.concat((k % 50).cast("string"), unit)
    return B.t(spark, sf, "orders").select("o_orderkey", spec.alias("spec"), text.parse_duration_seconds(spec).alias("seconds"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""")
def html_escape(spark, sf):
    return B.t(spark, sf, "pages").select("page_id", text.escape_html("html").alias("escaped"))



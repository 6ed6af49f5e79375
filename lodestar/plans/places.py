"""Queries that resolve places of files to targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar import bridge as B
from lodestar.operators import spans as S
from lodestar.registry import query

# sixteen files of line items as spans (nested, equal, of no length; now and then one that is the whole file), orders as places of twenty files
SQL_PLACES = """s AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey % 16 AS path, CASE WHEN l_orderkey % 500 = 0 THEN 0 ELSE (l_partkey * 37 + l_linenumber * 11) % 20000 END AS s,
 CASE WHEN l_orderkey % 500 = 0 THEN 30000 ELSE (l_partkey * 37 + l_linenumber * 11) % 20000 + (l_quantity * l_quantity)::BIGINT - 1 END AS e, l_orderkey % 500 = 0 AS is_file FROM lineitem),
p AS (SELECT o_orderkey AS point, o_custkey % 20 AS path, (o_orderkey * 7) % 32000 AS st, (o_orderkey * 7) % 32000 + o_orderkey % 4 * 100 AS en FROM orders)"""


@query(f"""WITH {SQL_PLACES}, b AS (SELECT point, any_value(st) AS st, any_value(en) AS en, arg_min({{'id': id, 's': s, 'e': e, 'f': is_file}}, (is_file, e - s, id)) FILTER (id IS NOT NULL) AS b
 FROM p LEFT JOIN s ON p.path = s.path AND s.s <= p.st AND s.e >= p.en GROUP BY point)
SELECT point, b.id AS id, CASE WHEN b IS NULL THEN 'unmapped' WHEN b.f THEN 'file_fallback' WHEN b.s = st AND b.e = en THEN 'exact' ELSE 'containing_target' END AS quality FROM b""")
def diagnostic_targets(spark, sf):
    whole = F.col("l_orderkey") % 500 == 0
    start = (F.col("l_partkey") * 37 + F.col("l_linenumber") * 11) % 20000
    end = start + (F.col("l_quantity") * F.col("l_quantity")).cast("long") - 1
    spans = B.t(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_suppkey") % 16).alias("path"), F.when(whole, 0).otherwise(start).alias("s"), F.when(whole, 30000).otherwise(end).alias("e"), whole.alias("is_file"))
    at = (F.col("o_orderkey") * 7) % 32000
    points = B.t(spark, sf, "orders").select(F.col("o_orderkey").alias("point"), (F.col("o_custkey") % 20).alias("path"), at.alias("start"), (at + F.col("o_orderkey") % 4 * 100).alias("end"))
    return S.resolve_places(points, spans)


SQL_SPANS = """t AS (SELECT p_partkey AS id, 'src/f' || (p_partkey % 8) || '.rs' AS path, (p_partkey * 13) % 9000 AS s, (p_partkey * 13) % 9000 + p_size * 40 AS e, FALSE AS is_file FROM part
 UNION ALL SELECT -k, 'src/f' || k || '.rs', 0, 12000, TRUE FROM range(6) r(k)),
l AS (SELECT o_orderkey AS line, o_custkey % 10 AS f, (o_custkey * 17) % 9500 AS a, o_orderkey % 50 AS n, o_orderstatus AS flag FROM orders),
x AS (SELECT line, 0 AS span, 'src/f' || f || '.rs' AS path, a AS st, a + n AS en, TRUE AS is_primary, flag FROM l UNION ALL SELECT line, 1, 'src/f' || ((f + 1) % 10) || '.rs', a, a, FALSE, flag FROM l WHERE n > 25)"""


@query(f"""WITH {SQL_SPANS}, b AS (SELECT line, span, any_value(is_primary) AS is_primary, any_value(flag) AS flag, any_value(st) AS st, any_value(en) AS en, arg_min({{'id': id, 's': s, 'e': e, 'f': is_file}}, (is_file, e - s, id)) FILTER (id IS NOT NULL) AS b
 FROM x LEFT JOIN t ON x.path = t.path AND t.s <= x.st AND t.e >= x.en GROUP BY line, span)
SELECT line, span, is_primary, 'E' || flag AS code, b.id AS target, CASE WHEN b IS NULL THEN 'unmapped' WHEN b.f THEN 'file_fallback' WHEN b.s = st AND b.e = en THEN 'exact' ELSE 'containing_target' END AS quality FROM b""")
def compiler_evidence(spark, sf):
    """A compiler's line of each order: one span or two."""
    from lodestar.sources import evidence as E

    c = F.col
    part = B.t(spark, sf, "part").select(c("p_partkey").alias("id"), (c("p_partkey") % 8).alias("f"), ((c("p_partkey") * 13) % 9000).alias("s"), (c("p_size") * 40).alias("n"))
    part = part.select("id", F.concat(F.lit("src/f"), "f", F.lit(".rs")).alias("path"), "s", (c("s") + c("n")).alias("e"), F.lit(False).alias("is_file"))
    whole = spark.range(6).select((-c("id")).alias("id"), F.concat(F.lit("src/f"), "id", F.lit(".rs")).alias("path"), F.lit(0).cast("long").alias("s"), F.lit(12000).cast("long").alias("e"), F.lit(True).alias("is_file"))
    span = lambda f, a, b, first: F.struct(F.concat(F.lit("src/f"), f, F.lit(".rs")).alias("file_name"), a.alias("byte_start"), b.alias("byte_end"), F.lit(1).alias("line_start"), F.lit(first).alias("is_primary"))
    f, a, n = c("o_custkey") % 10, (c("o_custkey") * 17) % 9500, c("o_orderkey") % 50
    spans = F.array_compact(F.array(span(f, a, a + n, True), F.when(n > 25, span((f + 1) % 10, a, a, False))))
    message = F.struct(F.lit("text").alias("message"), F.lit("error").alias("level"), F.struct(F.concat(F.lit("E"), "o_orderstatus").alias("code")).alias("code"), spans.alias("spans"))
    lines = B.t(spark, sf, "orders").select(c("o_orderkey").alias("line"), F.to_json(F.struct(F.lit(E.MESSAGE).alias("reason"), message.alias("message"))).alias("value"))
    return E.compiler_evidence(lines, part.unionByName(whole)).select("line", "span", "is_primary", "code", "target", "quality")


@query("""SELECT doc_id AS report, source || '/' || doc_id || '.java' AS path, CASE WHEN n_chars % 5 = 0 THEN 1 ELSE n_chars % 100 END::INTEGER AS line, CASE WHEN doc_id % 3 = 0 THEN 'warning' ELSE lang END AS severity, left(text, 40) AS message FROM documents WHERE doc_id % 7 <> 0 AND text IS NOT NULL
UNION ALL SELECT doc_id, source || '/' || doc_id || '.java', 7, 'error', 'no message' FROM documents WHERE doc_id % 7 <> 0 AND text IS NOT NULL""")
def checkstyle_errors(spark, sf):
    """Reports that quote documents; every seventh is cut off and no XML."""
    from lodestar.functions.text import escape_html
    from lodestar.sources import evidence as E

    c = F.col
    line = F.when(c("n_chars") % 5 != 0, F.concat(F.lit(' line="'), c("n_chars") % 100, F.lit('"'))).otherwise("")
    severity = F.when(c("doc_id") % 3 != 0, F.concat(F.lit(' severity="'), "lang", F.lit('"'))).otherwise("")
    quoted = F.replace(F.replace(F.replace(escape_html(F.substring("text", 1, 40)), F.lit("\n"), F.lit("&#10;")), F.lit("\t"), F.lit("&#9;")), F.lit("\r"), F.lit("&#13;"))
    error = F.concat(F.lit("<error"), line, severity, F.lit(' message="'), quoted, F.lit('"/>'))
    xml = F.concat(F.lit('<checkstyle version="1"><file name="'), "source", F.lit("\\"), c("doc_id").cast("string"), F.lit('.java">'), error, F.lit('<error line="7" severity="error"/>'), F.when(c("doc_id") % 7 != 0, "</file></checkstyle>").otherwise(""))
    return E.checkstyle(B.t(spark, sf, "documents").select(c("doc_id").alias("report"), xml.alias("value"))).select("report", "path", "line", "severity", "message")


@query("""WITH r AS (SELECT event_id AS line, user_id, event_type, value FROM events), k AS (SELECT DISTINCT c_custkey AS id FROM customer)
SELECT line, CASE WHEN line % 5 <> 0 THEN user_id::VARCHAR END AS target, CASE event_type WHEN 'view' THEN 'passed' WHEN 'click' THEN 'failed' WHEN 'purchase' THEN 'ignored' ELSE event_type END AS status,
 CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'unknown_status' WHEN line % 11 = 0 THEN 'empty_summary' WHEN line % 5 <> 0 AND user_id NOT IN (SELECT id FROM k) THEN 'unknown_target' END AS rejected FROM r WHERE line % 13 <> 0
UNION ALL SELECT line, NULL, NULL, 'no_object' FROM r WHERE line % 13 = 0""")
def tool_result_evidence(spark, sf):
    """A result of each event; customers are the targets."""
    from lodestar.sources import evidence as E

    c = F.col
    kind = c("event_type")
    status = F.when(kind == "view", "passed").when(kind == "click", "failed").when(kind == "purchase", "ignored").otherwise(kind)
    value = F.to_json(F.struct(F.when(c("event_id") % 5 != 0, c("user_id").cast("string")).alias("target"), status.alias("status"), F.when(c("event_id") % 11 != 0, "ran").otherwise(" ").alias("summary")))
    lines = B.t(spark, sf, "events").select(c("event_id").alias("line"), F.when(c("event_id") % 13 != 0, value).otherwise("no json {").alias("value"))
    return E.tool_results(lines, B.t(spark, sf, "customer").select(c("c_custkey").cast("string").alias("id"))).select("line", "target", "status", "rejected")

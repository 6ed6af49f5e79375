"""Tool output as evidence of targets: compiler messages with all their spans, Checkstyle reports, captured results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.spans import resolve_places

#: What a compiler's message line is called, states of captured results.
MESSAGE = "compiler-message"
STATES = ("passed", "failed", "ignored")
_SPAN = "struct<file_name:string,byte_start:bigint,byte_end:bigint,line_start:bigint,is_primary:boolean,label:string>"
_RUSTC = f"reason string, message struct<message:string,level:string,code:struct<code:string>,spans:array<{_SPAN}>>"
_STYLE = "file array<struct<_name:string,error:array<struct<_line:int,_column:int,_severity:string,_message:string,_source:string>>>>"
_RESULT = "target string, status string, summary string, detail string"


def compiler_spans(lines: DataFrame) -> DataFrame:
    """line, span, path, start, end, at_line, is_primary, level, code, message of every span of the compiler's JSON messages. lines: line (number), value.

    Lines that are no JSON or no messages, and messages without spans, have no row.
    """
    m = lines.select("line", F.from_json("value", _RUSTC).alias("m")).filter(F.col("m.reason") == MESSAGE)
    each = m.select("line", F.col("m.message").alias("m"), F.posexplode("m.message.spans").alias("span", "s"))
    return each.select(
        "line", "span", F.regexp_replace(F.replace(F.col("s.file_name"), F.lit("\\"), F.lit("/")), "^\\./", "").alias("path"), F.col("s.byte_start").alias("start"), F.col("s.byte_end").alias("end"),
        F.col("s.line_start").cast("int").alias("at_line"), F.coalesce("s.is_primary", F.lit(False)).alias("is_primary"), F.col("m.level").alias("level"), F.col("m.code.code").alias("code"), F.col("m.message").alias("message"),
    )


def compiler_evidence(lines: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows of compiler_spans with the target that each span lies in and how well that is resolved. targets: id, path, s, e, is_file."""
    found = compiler_spans(lines)
    place = F.struct("line", "span")
    at = resolve_places(found.select(place.alias("point"), "path", "start", "end"), targets)
    at = at.select(F.col("point.line").alias("line"), F.col("point.span").alias("span"), F.col("id").alias("target"), "quality")
    return found.join(at, ["line", "span"])


def checkstyle(reports: DataFrame) -> DataFrame:
    """report, path, line, column, severity, message, rule of every error of Checkstyle's XML reports (report, value).

    Absent lines are 1, absent severities `warning`; an absent message says so. A report that is no XML has no row.
    """
    files = reports.select("report", F.explode(F.from_xml("value", _STYLE, {"mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false"})["file"]).alias("f"))
    each = files.select("report", F.col("f._name").alias("path"), F.explode("f.error").alias("e"))
    return each.select(
        "report", F.replace(F.col("path"), F.lit("\\"), F.lit("/")).alias("path"), F.coalesce("e._line", F.lit(1)).alias("line"), F.col("e._column").alias("column"), F.coalesce("e._severity", F.lit("warning")).alias("severity"),
        F.coalesce("e._message", F.lit("no message")).alias("message"), F.col("e._source").alias("rule"),
    )


def tool_results(lines: DataFrame, targets: DataFrame) -> DataFrame:
    """line, target, status, summary, detail, rejected (why, else null) of captured results, one JSON object a line. lines: line (number), value; targets: id.

    A result without a target is evidence of the whole run. Rejected: no_object, unknown_status, empty_summary, unknown_target, the first that holds.
    """
    j = lines.select("line", F.from_json("value", _RESULT).alias("r"), F.get_json_object("value", "$").alias("whole"))
    j = j.select("line", "r.*", (F.col("whole").isNull() | ~F.col("whole").startswith("{")).alias("none"))
    j = j.join(targets.select(F.col("id").alias("target"), F.lit(True).alias("known")).distinct(), "target", "left")
    why = (
        F.when(F.coalesce("none", F.lit(True)), "no_object").when(~F.coalesce(F.col("status").isin(*STATES), F.lit(False)), "unknown_status").when(F.trim(F.coalesce("summary", F.lit(""))) == "", "empty_summary")
        .when(F.col("target").isNotNull() & F.col("known").isNull(), "unknown_target")
    )
    return j.select("line", "target", "status", "summary", "detail", why.alias("rejected"))

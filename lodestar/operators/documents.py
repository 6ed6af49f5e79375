"""Reports as documents of any size: numbered parts, whose files in path order are the document.

A part is a few fixed lines, or the lines of a table, dealt by ranges of its order and sorted, so that its files follow each
other. Nothing is gathered on the driver; `getmerge` or `cat` in path order gives one file.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.ids import severity_rank
from lodestar.functions.text import escape_html, escape_markdown


@dataclass
class Part:
    """Fixed lines, then the lines (column value) of a table by its other columns in the given order."""

    head: list[str]
    rows: DataFrame | None = None
    order: list[Column] = field(default_factory=list)


def write_document(spark: SparkSession, parts: list[Part], path: str) -> None:
    """Write the parts below path, which must not exist. A value's line breaks are kept; each value ends in one more."""
    for k, part in enumerate(parts):
        spark.createDataFrame([(line,) for line in part.head], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/{k:03}-0")
        if part.rows is not None:
            part.rows.repartitionByRange(*part.order).sortWithinPartitions(*part.order).select("value").write.mode("errorifexists").text(f"{path}/{k:03}-1")


def document_lines(spark: SparkSession, parts: list[Part]) -> DataFrame:
    """n, value: the document's lines, numbered from 1 over all parts."""
    from lodestar.operators.ordered import numbered

    out, before = None, 0
    for part in parts:
        fixed = spark.createDataFrame([(before + k, line) for k, line in enumerate(part.head, 1)], "n long, value string")
        out, before = fixed if out is None else out.unionByName(fixed), before + len(part.head)
        if part.rows is not None:
            rows = numbered(part.rows, part.order, "n", before).select("n", "value")
            out, before = out.unionByName(rows), before + part.rows.count()
    return out


def _cells(columns: list[str], escape, before: str, between: str, after: str) -> Column:
    return F.concat(F.lit(before), F.concat_ws(between, *[F.coalesce(escape(F.col(c).cast("string")), F.lit("")) for c in columns]), F.lit(after))


def _as_line(c: Column) -> Column:
    return escape_markdown(c)


def markdown_table(frame: DataFrame, order: list[Column], title: str | None = None) -> Part:
    """All rows by all columns of a frame, or those not beginning with `_` (which may be there for the order)."""
    shown = [c for c in frame.columns if not c.startswith("_")]
    head = ([f"## {title}", ""] if title else []) + ["| " + " | ".join(shown) + " |", "|" + " --- |" * len(shown)]
    return Part(head, frame.withColumn("value", _cells(shown, _as_line, "| ", " | ", " |")), order)


def html_table(frame: DataFrame, order: list[Column], title: str | None = None) -> Part:
    shown = [c for c in frame.columns if not c.startswith("_")]
    head = ([f"<h2>{title}</h2>"] if title else []) + ["<table>", "<tr>" + "".join(f"<th>{c}</th>" for c in shown) + "</tr>"]
    return Part(head, frame.withColumn("value", _cells(shown, escape_html, "<tr><td>", "</td><td>", "</td></tr>")), order)


def _differences(matched: DataFrame) -> tuple[DataFrame, DataFrame, list[Column]]:
    """Counts by category and severity; findings, gravest first; the order of the latter."""
    counts = matched.groupBy("category").agg(F.count(F.lit(1)).alias("findings"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low", "note")])
    rank = F.coalesce(severity_rank("severity"), F.lit(-1))
    rows = matched.select("category", "severity", "baseline_id", "current_id", "matched_by", rank.alias("_rank"))
    return counts, rows, [F.col("category"), F.col("_rank").desc(), F.col("baseline_id").asc_nulls_first(), F.col("current_id").asc_nulls_first()]


def _verdict(violations: DataFrame | None) -> list[str]:
    """One line for each violated threshold; there are as many as thresholds at most."""
    if violations is None:
        return []
    broken = [f"{r['rule']}: {r['found']} found, {r['limit']} allowed" for r in violations.orderBy("rule").collect()]
    return broken or ["no threshold is violated"]


def differential_markdown(matched: DataFrame, title: str, violations: DataFrame | None = None) -> list[Part]:
    """The comparison of two runs (rows of report.match) in Markdown; violations: rows of report.gate."""
    counts, rows, order = _differences(matched)
    gate = [f"> {line}" for line in _verdict(violations)]
    return [Part([f"# {title}", "", *gate, *([""] if gate else [])]), markdown_table(counts, [F.col("category")], "Counts"), Part([""]), markdown_table(rows, order, "Findings")]


def differential_html(matched: DataFrame, title: str, violations: DataFrame | None = None) -> list[Part]:
    """The same as one HTML page without outside parts. The title is plain text."""
    import html

    counts, rows, order = _differences(matched)
    name = html.escape(title)
    style = "<style>body{font-family:sans-serif}td,th{border:1px solid #ccc;padding:2px 6px}</style>"
    gate = [f"<p>{html.escape(line)}</p>" for line in _verdict(violations)]
    begin = Part(["<!DOCTYPE html>", f'<html><head><meta charset="utf-8"><title>{name}</title>{style}</head><body>', f"<h1>{name}</h1>", *gate])
    return [begin, html_table(counts, [F.col("category")], "Counts"), Part(["</table>"]), html_table(rows, order, "Findings"), Part(["</table>", "</body></html>"])]


def sarif_document(results: DataFrame, tool: str = "lodestar") -> list[Part]:
    """One SARIF 2.1.0 log of all results (rows of report.sarif_results), by rule and id; its rules are those that results have. Repeated rows stand once."""
    least = lambda df, *by: df.agg(F.min(F.struct(*by)).alias("_least"))

    def listed(df: DataFrame, line: Column, *by: str) -> DataFrame:
        """Lines of a JSON list: all but the first begin with a comma. The first by order is one row, known before."""
        return df.join(F.broadcast(least(df, *by)), how="cross").withColumn("value", F.concat(F.when(F.struct(*by) == F.col("_least"), "").otherwise(","), line))

    rules = listed(results.select("rule").distinct(), F.to_json(F.struct(F.col("rule").alias("id"))), "rule")
    lines = listed(results.select("rule", "id", "result").distinct(), F.col("result"), "rule", "id", "result")
    begin = '{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name":' + json.dumps(tool) + ',"rules":['
    return [Part([begin], rules, [F.col("rule")]), Part(["]}},", '"results":['], lines, [F.col("rule"), F.col("id"), F.col("result")]), Part(["]}]}"])]

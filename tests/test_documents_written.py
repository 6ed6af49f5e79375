"""Reports as files: part files in path order are one document."""

import json
import xml.etree.ElementTree as ET
from pathlib import Path

from lodestar.operators import documents as W
from lodestar.operators import report as R
from lodestar.operators import sinks

FINDING = "id string, policy string, target string, title string, severity string, confidence int"


def whole(path):
    files = sorted(p for p in Path(path).rglob("part-*") if not p.name.endswith(".crc"))
    assert len(files) > 4
    return "".join(p.read_text() for p in files)


def test_documents_of_many_parts(spark, tmp_path):
    n = 5000
    severity = ["critical", "high", "medium", "low", "note", None]
    rows = [(f"f{k:05}", f"p{k % 3}", "t", f'<a href="x">& {k} |\n"', severity[k % 6], k) for k in range(n)]
    b = spark.createDataFrame(rows[: n // 2], FINDING)
    c = spark.createDataFrame(rows[n // 4 :] + rows[-1:], FINDING).repartition(7)
    m = R.match(b, c)
    gate = R.gate(m, 0, 5)

    W.write_document(spark, W.differential_html(m, "Runs <1 & 2>", gate), f"{tmp_path}/html")
    page = whole(f"{tmp_path}/html")
    tree = ET.fromstring(page.replace("<!DOCTYPE html>\n", "").replace('<meta charset="utf-8">', ""))
    tables = tree.findall("body/table")
    assert [len(t.findall("tr")) - 1 for t in tables] == [3, n] and tree.find("body/h1").text == "Runs <1 & 2>"
    shown = [[td.text or "" for td in tr.findall("td")] for tr in tables[1].findall("tr")[1:]]
    rank = {s: k for k, s in enumerate(severity)}
    assert shown == sorted(shown, key=lambda r: (r[0], rank[r[1] or None], r[2], r[3]))

    W.write_document(spark, W.differential_markdown(m, "Runs", gate), f"{tmp_path}/md")
    lines = whole(f"{tmp_path}/md").splitlines()
    assert lines[0] == "# Runs" and sum(line.startswith("> max_new") for line in lines) == 2
    assert [r["value"] for r in W.document_lines(spark, W.differential_markdown(m, "Runs", gate)).orderBy("n").collect()] == lines

    sinks.write_sarif(R.sarif_results(c), f"{tmp_path}/sarif")
    log = json.loads(whole(f"{tmp_path}/sarif"))
    run = log["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["p0", "p1", "p2"] and len(run["results"]) == len(rows[n // 4 :])
    assert {r["message"]["text"] for r in run["results"]} == {r[3].strip(" ") for r in rows[n // 4 :]}


def test_empty_reports_are_whole_documents(spark, tmp_path):
    none = spark.createDataFrame([], FINDING)
    W.write_document(spark, W.sarif_document(R.sarif_results(none)), f"{tmp_path}/s")
    text = "".join(p.read_text() for p in sorted(Path(f"{tmp_path}/s").rglob("part-*")))
    assert json.loads(text)["runs"][0]["results"] == []

"""Exports: tagged JSON lines, Markdown, HTML, SARIF documents, write-once bundles."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_lines(summary: DataFrame, clusters: DataFrame) -> DataFrame:
    """value: one JSON line tagged summary, one tagged finding_cluster for each cluster."""
    tag = lambda df, name: df.select(F.to_json(F.struct(F.lit(name).alias("record"), *df.columns)).alias("value"))
    return tag(summary, "summary").unionByName(tag(clusters, "finding_cluster"))


#: Rows of a page that the driver holds; documents.py writes reports of any size.
PAGE = 1000


def _page(frame: DataFrame, limit: int) -> tuple[list, int]:
    """The first rows of a frame in order, and how many are left out."""
    return frame.orderBy(*frame.columns).limit(limit).collect(), max(0, frame.count() - limit)


def markdown(title: str, frame: DataFrame, limit: int = PAGE) -> str:
    """A table of the first rows by all columns, and how many more there are: a page for people, one string on the driver."""
    cols = frame.columns
    rows, more = _page(frame, limit)
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(cols) + " |", "|" + " --- |" * len(cols), *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)]
    return "\n".join(lines + ([f"\n{more} more"] if more else [])) + "\n"


def html_page(title: str, frame: DataFrame, limit: int = PAGE) -> str:
    """As markdown, in HTML."""
    cols = frame.columns
    rows, more = _page(frame, limit)
    e = lambda v: html.escape(str("" if v is None else v))
    body = "".join("<tr>" + "".join(f"<td>{e(v)}</td>" for v in r) + "</tr>" for r in rows)
    return f"<!DOCTYPE html><title>{e(title)}</title><h1>{e(title)}</h1><table><tr>{''.join(f'<th>{e(c)}</th>' for c in cols)}</tr>{body}</table>" + (f"<p>{more} more</p>" if more else "")


def write_sarif(results: DataFrame, path: str) -> None:
    """One SARIF log as the files below path (see documents.py)."""
    from lodestar.operators.documents import sarif_document, write_document

    write_document(results.sparkSession, sarif_document(results), path)


def sarif_log(rules: list[str], results: list[str], tool: str = "lodestar") -> str:
    return json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": [{"id": r} for r in rules]}}, "results": [json.loads(r) for r in results]}]})


def finalize_bundle(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write each table as JSON lines and a manifest of counts and order-free content hashes; an existing bundle is refused (write once)."""
    out = None
    for name, df in sorted(tables.items()):
        df.write.mode("errorifexists").json(f"{path}/{name}")
        row = F.xxhash64(*df.columns) if df.columns else F.lit(0)
        m = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash"))
        out = m if out is None else out.unionByName(m)
    out.coalesce(1).write.mode("errorifexists").json(f"{path}/_manifest")
    return out


def read_bundle(spark, path: str, table: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/{table}")


def write_manifest(files: DataFrame, path: str, configuration: str, revision: str) -> dict[str, str]:
    """A snapshot's files (path, content, size, class) as JSON lines beside their identity, written once; the identity."""
    from lodestar.operators.snapshot import snapshot_ids

    tagged = files.select(F.lit("s").alias("_s"), F.lit(configuration).alias("_c"), F.lit(revision).alias("_r"), "*")
    ids = snapshot_ids(tagged, "_s", "_c", "_r").first()
    made = {"tree_id": ids["tree_id"], "snapshot_id": ids["snapshot_id"], "configuration": configuration, "revision": revision} if ids else {}
    files.write.mode("errorifexists").json(f"{path}/files")
    files.sparkSession.createDataFrame([(json.dumps(made, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/identity")
    return made


def load_manifest(spark, path: str) -> DataFrame:
    """The files of a manifest; an error if they are not those that its identity names."""
    from lodestar.operators.snapshot import snapshot_ids

    want = json.loads(spark.read.text(f"{path}/identity").first()["value"])
    files = spark.read.schema("path string, content string, size long, class string").json(f"{path}/files")
    tagged = files.select(F.lit("s").alias("_s"), F.lit(want.get("configuration")).alias("_c"), F.lit(want.get("revision")).alias("_r"), "*")
    ids = snapshot_ids(tagged, "_s", "_c", "_r").first()
    if (ids["snapshot_id"] if ids else None) != want.get("snapshot_id"):
        raise ValueError(f"the manifest at {path} does not hold the files of its identity")
    return files


def publish_inventory(tables: dict[str, DataFrame], path: str, name: str) -> str:
    """An adapter's tables as a new version below path, and then the one file that names it: readers see the old version or the new one, never part of one.

    A version is named by the hash of its tables, so that publishing the same again, or after a crash midway, changes nothing.
    """
    digests = []
    for table, df in sorted(tables.items()):
        row = F.xxhash64(*df.columns) if df.columns else F.lit(0)
        n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0))).first()
        digests.append(f"{table}:{n}:{total}")
    spark = next(iter(tables.values())).sparkSession
    version = spark.range(1).select(F.sha2(F.lit("|".join(digests)), 256).alias("v")).first()["v"][:16]
    for table, df in sorted(tables.items()):
        df.write.mode("overwrite").json(f"{path}/{name}/{version}/{table}")
    spark.createDataFrame([(version, digest) for digest in digests], "version string, digest string").coalesce(1).write.mode("overwrite").json(f"{path}/{name}/manifest-{version}")
    _switch(spark, f"{path}/{name}", version)
    return version


def _switch(spark, folder: str, version: str) -> None:
    """The pointer file: written beside, then renamed over the old one."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{folder}/current")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    staged = jvm.org.apache.hadoop.fs.Path(f"{folder}/current.{version}.staged")
    out = fs.create(staged, True)
    out.writeBytes(version)
    out.close()
    fs.delete(target, False)
    if not fs.rename(staged, target):
        raise OSError(f"cannot switch {folder} to {version}")


def read_inventory(spark, path: str, name: str, table: str, schema: str) -> DataFrame:
    """A table of the version that is published."""
    version = spark.read.text(f"{path}/{name}/current").first()["value"]
    return spark.read.schema(schema).json(f"{path}/{name}/{version}/{table}")


def compact(spark, path: str, bytes_a_file: int = 128 << 20) -> int:
    """Rewrite a Parquet table's files as few large ones, beside it and then in its place; how many files there are now."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    n = max(1, -(-fs.getContentSummary(at).getLength() // bytes_a_file))
    spark.read.parquet(path).coalesce(n).write.mode("overwrite").parquet(f"{path}.compacted")
    fs.delete(at, True)
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(f"{path}.compacted"), at):
        raise OSError(f"cannot put the compacted table in the place of {path}")
    return n

"""Snapshots: diffs of files and targets, drift of a working tree, change sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(baseline: DataFrame, current: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, change: added, removed, modified (any field differs; nulls are equal to each other), unchanged."""
    b = baseline.select(F.col(key).alias("bk"), F.struct(*fields).alias("b"))
    c = current.select(F.col(key).alias("ck"), F.struct(*fields).alias("c"))
    same = F.col("b").eqNullSafe(F.col("c"))
    change = F.when(F.col("bk").isNull(), "added").when(F.col("ck").isNull(), "removed").when(~same, "modified").otherwise("unchanged")
    return b.join(c, F.col("bk") == F.col("ck"), "full_outer").select(F.coalesce("bk", "ck").alias(key), change.alias("change"))


def changed_paths(changes: DataFrame, key: str = "path") -> DataFrame:
    return changes.filter("change in ('added', 'modified', 'removed')").select(key).distinct()


def directly_changed(changes: DataFrame, key: str = "path") -> DataFrame:
    return changes.filter("change in ('added', 'modified')").select(key).distinct()


def drift(manifest: DataFrame, scan: DataFrame) -> DataFrame:
    """path, drift of a working tree against a snapshot: missing, modified (also if nothing was stored to compare with); never added."""
    s = scan.select(F.col("path").alias("sp"), F.col("content").alias("sc"))
    state = F.when(F.col("sp").isNull(), "missing").when(F.col("content").isNull() | ~F.col("content").eqNullSafe(F.col("sc")), "modified")
    return manifest.join(s, F.col("path") == F.col("sp"), "left").select("path", state.alias("drift")).filter("drift is not null")


def one_hop(targets: DataFrame, relations: DataFrame, changed: DataFrame) -> DataFrame:
    """id: targets that changed, their neighbours either way, and workspaces."""
    out = relations.join(changed, F.col("source") == F.col("id"), "left_semi").select(F.col("target").alias("id"))
    into = relations.join(changed, F.col("target") == F.col("id"), "left_semi").select(F.col("source").alias("id"))
    every = changed.select("id").unionByName(out).unionByName(into).unionByName(targets.filter("kind = 'workspace'").select("id")).distinct()
    return targets.join(every, "id", "left_semi").select("id")


def violations(targets: DataFrame, relations: DataFrame) -> DataFrame:
    """rule, id: blank names, duplicate ids, relations to unknown targets, missing parents."""
    t = targets.select("id")
    row = lambda df, rule, c: df.select(F.lit(rule).alias("rule"), F.col(c).alias("id"))
    return (
        row(targets.filter("trim(name) = '' or name is null"), "blank_name", "id")
        .unionByName(row(targets.groupBy("id").count().filter("count > 1"), "duplicate_id", "id"))
        .unionByName(row(relations.join(t, F.col("source") == F.col("id"), "left_anti"), "unknown_source", "source").distinct())
        .unionByName(row(relations.join(t, F.col("target") == F.col("id"), "left_anti"), "unknown_target", "target").distinct())
        .unionByName(row(targets.filter("parent is not null").join(t.withColumnRenamed("id", "p"), F.col("parent") == F.col("p"), "left_anti"), "missing_parent", "id"))
    )


def line_starts(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line (from 1), start: the byte at which each line begins; one fold over a file's lines, no shuffle."""
    at = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
    step = lambda a, x: F.struct((a["at"] + F.octet_length(x) + 1).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))
    starts = F.aggregate(F.split(F.col(text), "\n"), at, step)["out"]
    return files.select(key, F.posexplode(starts).alias("pos", "start")).select(key, (F.col("pos") + 1).cast("long").alias("line"), "start")


def read_range(files: DataFrame, key: str, start: str, end: str, text: str = "text") -> DataFrame:
    """key, bytes of [start, end) of each file, problem: out_of_range if the range ends behind the file or before it begins."""
    raw = F.col(text).cast("binary")
    bad = (F.col(start) < 0) | (F.col(end) < F.col(start)) | (F.col(end) > F.octet_length(raw)) | raw.isNull()
    part = F.substring(raw, (F.col(start) + 1).cast("int"), (F.col(end) - F.col(start)).cast("int"))
    return files.select(key, F.when(~bad, part).alias("bytes"), F.when(F.coalesce(bad, F.lit(True)), "out_of_range").alias("problem"))


def target_changes(targets: DataFrame, changes: DataFrame) -> DataFrame:
    """id, change of the file that each target lies in; unchanged where it lies in none that changed. targets: id, path."""
    return targets.join(changes.select("path", "change"), "path", "left").select("id", F.coalesce("change", F.lit("unchanged")).alias("change"))


def snapshot_ids(files: DataFrame, snapshot: str, configuration: str, revision: str) -> DataFrame:
    """snapshot, tree_id, snapshot_id: the tree's identity is that of its files alone; the snapshot's covers configuration and revision too.

    files: the columns named by `snapshot`, `configuration` and `revision`, path, content, size, class.
    """
    from lodestar.functions.ids import derived_id, frame, set_hash

    item = F.concat(*[frame(c) for c in ("path", "content", "size", "class")])
    tree = files.groupBy(snapshot, configuration, revision).agg(set_hash(item).alias("tree_id"))
    return tree.select(snapshot, "tree_id", derived_id("snapshot", "tree_id", configuration, revision).alias("snapshot_id"))

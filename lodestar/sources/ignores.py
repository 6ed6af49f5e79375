"""Ignore rules as rows: which paths the .gitignore and override files of their folders leave out.

A rule meets a path by an equal key: a name or an extension of one of its components, or a way from the rule's folder.
Only rules with other wildcards are tried one by one, and only on paths below their folder. The plan is the same for any
number of rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are never looked into; layers of rules from weak to strong.
NEVER = (".git",)
DEFAULTS, IGNORE_FILES, EXTRA, OVERRIDES = 0, 1, 2, 3
_RULE = "folder string, layer int, line_no int, kind string, key string, below boolean, back boolean"


def _regex(glob: str) -> str:
    """Of a path relative to the rule's folder: ** spans folders, * and ? stay within one, [..] is a set."""
    out, k = "", 0
    while k < len(glob):
        end = glob.find("]", k + 2)
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif glob[k] == "[" and end > 0:
            inner = glob[k + 1 : end].replace("\\", "\\\\")
            out, k = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif glob[k] == "\\" and k + 1 < len(glob):
            out, k = out + re.escape(glob[k + 1]), k + 2
        else:
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[k], re.escape(glob[k])), k + 1
    return out


def parsed(line: str) -> tuple[str, str, bool, bool] | None:
    """(kind, key, for folders only, takes back) of a line; null for blanks and comments. kinds: name, ext, way (from the folder), name_like and way_like (a pattern)."""
    p = line.rstrip("\r\n")
    p = p if p.endswith("\\ ") else p.rstrip()
    if not p or p.startswith("#"):
        return None
    back = p.startswith("!")
    p = p[1:] if back else p
    below, p = p.endswith("/"), p.rstrip("/")
    anchored, p = "/" in p, p.lstrip("/")
    if p.startswith("**/") and "/" not in p[3:]:
        anchored, p = False, p[3:]
    if not p:
        return None
    wild = any(x in p for x in "*?[\\")
    if not wild:
        return ("way" if anchored else "name"), p, below, back
    if not anchored and p.startswith("*.") and not any(x in p[2:] for x in "*?[\\."):
        return "ext", p[2:], below, back
    return ("way_like" if anchored else "name_like"), f"^{_regex(p)}$", below, back


def rules_of(lines: DataFrame) -> DataFrame:
    """Rules of lines: folder ('' for the root), layer, line_no, line. Blanks and comments are left out."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(f, a, n, *rule[:2], rule[2], rule[3]) for f, a, n, line in pdf.itertuples(index=False) if (rule := parsed(line or ""))]
            yield pd.DataFrame(rows, columns=["folder", "layer", "line_no", "kind", "key", "below", "back"])

    return lines.select("folder", F.col("layer").cast("int").alias("layer"), F.col("line_no").cast("int").alias("line_no"), "line").mapInPandas(parse, _RULE)


def ignore_file_lines(files: DataFrame, name: str = ".gitignore", layer: int = IGNORE_FILES) -> DataFrame:
    """Lines (for rules_of) of all ignore files of a name, each below its own folder. files: path, text."""
    own = files.filter((F.col("path") == name) | F.col("path").endswith("/" + name))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    return own.select(folder.alias("folder"), F.lit(layer).alias("layer"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def with_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files with ignored: whether the last rule that fits a path at its deepest component ignores it.

    A rule fits the path itself or a folder above it. The deepest fitting component decides; of its rules the strongest layer, then the
    deepest folder, then the last line. Paths within NEVER are always ignored. files: path (once each) and more; no rules: none of the others is.
    """
    path = F.split("path", "/")
    at = files.select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(path)), lambda k: F.struct(F.array_join(F.slice(path, 1, k), "/").alias("way"), F.get(path, k - 1).alias("name"), (k < F.size(path)).alias("dir")))).alias("level", "c"))
    at = at.select("path", "level", "c.way", "c.name", "c.dir")
    # the folders above each component, the root among them
    up = at.select("path", "level", "way", "name", "dir", F.explode(F.expr("transform(sequence(0, level), k -> array_join(slice(split(way, '/'), 1, k), '/'))")).alias("folder"))
    rest = F.expr("if(folder = '', way, substring(way, length(folder) + 2))")
    ext = F.expr("if(instr(name, '.') > 0, substring_index(name, '.', -1), null)")
    keys = up.select("path", "level", "dir", "folder", F.explode(F.array(F.struct(F.lit("name").alias("kind"), F.col("name").alias("key")), F.struct(F.lit("ext").alias("kind"), ext.alias("key")), F.struct(F.lit("way").alias("kind"), rest.alias("key")))).alias("k"))
    equal = keys.select("path", "level", "dir", "folder", "k.kind", "k.key").join(rules.filter("kind in ('name', 'ext', 'way')"), ["folder", "kind", "key"])
    like = rules.filter("kind in ('name_like', 'way_like')").withColumnRenamed("key", "pattern")
    tried = up.withColumn("rest", rest).join(like, "folder").filter(F.expr("if(kind = 'name_like', name, rest) rlike pattern"))
    shape = ["path", "level", "dir", "folder", "layer", "line_no", "below", "back"]
    fits = equal.select(*shape).unionByName(tried.select(*shape)).filter(F.col("dir") | ~F.col("below"))
    last = fits.groupBy("path").agg(F.max_by(~F.col("back"), F.struct("level", "layer", F.length("folder").alias("depth"), "line_no")).alias("by_rule"))
    never = F.arrays_overlap(path, F.array(*map(F.lit, NEVER)))
    return files.join(last, "path", "left").withColumn("ignored", never | F.coalesce("by_rule", F.lit(False))).drop("by_rule")


def line_rows(spark: SparkSession, lines: list[tuple[str, int, str]]) -> DataFrame:
    """(folder, layer, line) of a caller's own lists, in their order, as rows for rules_of."""
    return spark.createDataFrame([(f, a, k, line) for k, (f, a, line) in enumerate(lines)], "folder string, layer int, line_no int, line string")

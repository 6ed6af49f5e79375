"""Capturing a tree and its facts: files, ignore rules, git deltas, inventories, syntax, manifests, diagnostics."""

from __future__ import annotations

import ast
import configparser
import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.ids import content_hash
from lodestar.functions.text import file_class, looks_binary
from lodestar.sources import ignores as I
from lodestar.sources.tree import ENCODING, Tree

#: Bytes; larger files become issues.
LIMIT = 16 << 20
#: Ecosystems with their marker files and the folders that they exclude below a root; folders without roots.
ECOSYSTEMS = {
    "rust": (["Cargo.toml"], ["target/"]), "typescript": (["package.json", "tsconfig.json"], ["node_modules/", "dist/", ".next/", "build/", "coverage/"]),
    "python": (["pyproject.toml", "setup.py", "setup.cfg", "requirements.txt"], ["__pycache__/", ".venv/", "venv/", ".pytest_cache/"]),
    "java": (["pom.xml", "build.gradle", "build.gradle.kts"], ["target/", "build/", ".gradle/"]), "c": (["CMakeLists.txt", "meson.build"], ["build/", "cmake-build-*/"]), "go": (["go.mod"], []),
}
NO_ROOTS = ("node_modules", "target", "build")
#: Adapters by extension.
ADAPTERS = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "py": "python", "java": "java"}


def capture(spark: SparkSession, root: str, limit: int = LIMIT) -> DataFrame:
    """path, size, class, content (hash), issue, detail of every file below root; links, submodules and what can't be read are rows with an issue and no content.

    Text that is not UTF-8 has both. Files in version control's own folder are left out.
    """
    spark.dataSource.register(Tree)
    f = spark.read.format("tree").option("path", root).option("limit", str(limit)).load()
    kind = F.when(F.col("issue").isin("symlink", "submodule"), "unsupported").otherwise(file_class("path"))
    kind = F.when(kind.isin("source", "unsupported") & F.coalesce(looks_binary("bytes"), F.lit(False)), "binary").otherwise(kind)
    f = f.select("path", "size", kind.alias("class"), content_hash("bytes").alias("content"), "issue", "detail", F.is_valid_utf8("bytes").alias("utf8"))
    odd = ~F.coalesce("utf8", F.lit(True)) & (F.col("class") != "binary")
    return f.select("path", "size", "class", "content", F.when(odd, ENCODING).otherwise(F.col("issue")).alias("issue"), F.when(odd, "text that is not UTF-8").otherwise(F.col("detail")).alias("detail"))


def ignore_regex(pattern: str, root: str = "") -> tuple[str, bool] | None:
    """(regular expression over paths, takes back) of one ignore line below `root`; null for blanks and comments. ** spans folders, * and ? stay within one."""
    p = pattern.strip()
    if not p or p.startswith("#"):
        return None
    back = p.startswith("!")
    p = p[1:] if back else p
    folder, p = p.endswith("/"), p.rstrip("/")
    anchored, p = "/" in p, p.lstrip("/")
    out, k = "", 0
    while k < len(p):
        if p.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif p.startswith("**", k):
            out, k = out + ".*", k + 2
        else:
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(p[k], re.escape(p[k])), k + 1
    below = re.escape(root.strip("/")) + "/" if root.strip("/") else ""
    return f"^{below}{'' if anchored else '(?:.*/)?'}{out}{'/.*' if folder else '(?:/.*)?'}$", back


def is_ignored(path: Column | str, patterns: list[tuple[str, str]]) -> Column:
    """Whether the last of (root, line) patterns that fits a path ignores it."""
    path = F.col(path) if isinstance(path, str) else path
    out = F.lit(False)
    for root, line in patterns:
        if rule := ignore_regex(line, root):
            out = F.when(path.rlike(rule[0]), not rule[1]).otherwise(out)
    return out


def ignore_filter(files: DataFrame, patterns: list[str], roots: list[tuple[str, str]] | None = None, override: list[str] | None = None) -> DataFrame:
    """files without those that are ignored: (root, line) defaults of discovered roots are weakest, then the .gitignore files among files that have a text, the patterns, the override file's.

    See ignores.with_ignored. files: path, and text if ignore files are to be read.
    """
    own = [*((r, I.DEFAULTS, p) for r, p in roots or []), *(("", I.EXTRA, p) for p in patterns), *(("", I.OVERRIDES, p) for p in override or [])]
    lines = I.line_rows(files.sparkSession, own)
    if "text" in files.columns:
        lines = lines.unionByName(I.ignore_file_lines(files))
    return I.with_ignored(files, I.rules_of(lines)).filter(~F.col("ignored")).drop("ignored")


def ecosystem_roots(files: DataFrame) -> DataFrame:
    """root, ecosystem of every folder with a marker file, eight levels deep at most, outside hidden, build and module folders."""
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    closed = F.exists(folders, lambda x: x.isin(*NO_ROOTS) | x.startswith("."))
    table = files.sparkSession.createDataFrame([(m, e) for e, (markers, _) in ECOSYSTEMS.items() for m in markers], "marker string, ecosystem string")
    near = files.filter((F.size(parts) <= 9) & ~closed).select(F.array_join(folders, "/").alias("root"), F.substring_index("path", "/", -1).alias("marker"))
    return near.join(F.broadcast(table), "marker").select("root", "ecosystem").distinct()  # a fixed table


def ecosystem_patterns(files: DataFrame) -> DataFrame:
    """pattern: the default exclusions of each root."""
    table = files.sparkSession.createDataFrame([(e, x) for e, (_, patterns) in ECOSYSTEMS.items() for x in patterns], "ecosystem string, exclude string")
    below = F.when(F.col("root") == "", "/").otherwise(F.concat(F.lit("/"), "root", F.lit("/")))
    return ecosystem_roots(files).join(F.broadcast(table), "ecosystem").select(F.concat(below, "exclude").alias("pattern")).distinct()  # a fixed table


def implied_adapters(files: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and adapter of each file whose extension, case kept, implies one."""
    from lodestar.functions.text import extension

    of = F.create_map(*[x for pair in ADAPTERS.items() for x in map(F.lit, pair)])
    return files.select(*keep, of[extension("path")].alias("adapter")).filter("adapter is not null")


def missing_adapters(files: DataFrame, present: DataFrame, group: str) -> DataFrame:
    """group, adapter: adapters that a group's files imply and that are not present there."""
    return implied_adapters(files, group).distinct().join(present.select(group, "adapter").distinct(), [group, "adapter"], "left_anti")


def git_delta(lines: DataFrame) -> DataFrame:
    """path, change from `diff --name-status` and `status --porcelain` lines (value): R is removed plus added, C and ?? are added.

    A porcelain line has two letters, a blank and a path, or `old -> new`; one without a tab is taken for such a line.
    """
    v = F.col("value")
    porcelain = v.rlike(r"^[ MTADRCU?]{2} [^\t]+$")
    letter = F.when(F.substring(v, 1, 1).isin("R", "C"), F.substring(v, 1, 1)).otherwise(F.when(F.substring(v, 1, 2).contains("D"), "D").when(F.substring(v, 1, 2).contains("A"), "A").otherwise("M"))
    rest = F.regexp_replace(F.substr(v, F.lit(4)), " -> ", "\t")
    v = F.when(porcelain & ~v.startswith("??"), F.concat(letter, F.lit("\t"), rest)).otherwise(v)
    parts = F.split(v, r"\t")
    kind = F.substring(F.trim(parts[0]), 1, 1)
    one = lambda p, c: F.struct(p.alias("path"), F.lit(c).alias("change"))
    found = (
        F.when(v.startswith("?? "), F.array(one(F.substr(v, F.lit(4)), "added"))).when(kind == "R", F.array(one(parts[1], "removed"), one(parts[2], "added"))).when(kind == "C", F.array(one(parts[2], "added"))).when(kind == "A", F.array(one(parts[1], "added")))
        .when(kind == "D", F.array(one(parts[1], "removed"))).when(kind.isin("M", "T"), F.array(one(parts[1], "modified")))
    )
    return lines.select(F.explode(found).alias("d")).select("d.*").distinct()


def inventory(lines: DataFrame) -> dict[str, DataFrame]:
    """Frames of tagged JSON lines (value): target, relation, evidence, partition, conflict and rejected."""
    fields = ("record", "id", "kind", "name", "parent", "visibility", "inventory", "source", "target", "detail", "state", "diagnostic", "left", "right")
    j = lines.select("value", F.json_tuple("value", *fields).alias(*fields))  # a line is parsed once for all its fields
    pick = lambda tag, *cols: j.filter(F.col("record") == tag).select(*cols)
    known = ["header", "partition", "target", "evidence", "relation", "conflict", "finish"]
    return {
        "target": pick("target", "id", "kind", "name", "parent", "visibility", "inventory"), "relation": pick("relation", "id", "source", "target", "kind"), "evidence": pick("evidence", "id", "target", "kind", "detail"),
        "partition": pick("partition", "name", "state", "diagnostic"), "conflict": pick("conflict", "id", "left", "right"), "rejected": j.filter(~F.coalesce(F.col("record").isin(*known), F.lit(False))).select("value"),
    }


FACT = "path string, fact string, name string, parent string, detail string, line int"


def _python_facts(path: str, text: str) -> list[tuple]:
    tree, out = ast.parse(text), []

    def walk(node: ast.AST, owner: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{owner}.{child.name}" if owner else child.name
                out.append((path, "class" if isinstance(child, ast.ClassDef) else "callable", name, owner, ast.get_docstring(child), child.lineno))
                for base in getattr(child, "bases", []):
                    out.append((path, "extends", name, owner, ast.unparse(base), child.lineno))
                walk(child, name)
            else:
                if isinstance(child, ast.Import):
                    out.extend((path, "import", a.name, owner, None, child.lineno) for a in child.names)
                elif isinstance(child, ast.ImportFrom):
                    out.append((path, "import", "." * child.level + (child.module or ""), owner, None, child.lineno))
                elif isinstance(child, ast.Call):
                    out.append((path, "call", ast.unparse(child.func), owner, None, child.lineno))
                walk(child, owner)

    out.append((path, "module", path, None, ast.get_docstring(tree), 1))
    walk(tree, None)
    return out


#: Per language: (fact, pattern whose first group is the name).
SPECS = {
    "rs": [("callable", r"\bfn\s+(\w+)"), ("record", r"\b(?:struct|enum|union)\s+(\w+)"), ("trait", r"\btrait\s+(\w+)"), ("implements", r"\bimpl(?:<[^>]*>)?\s+(\w+)\s+for\b"), ("module", r"\bmod\s+(\w+)"), ("import", r"\buse\s+([\w:]+)"), ("call", r"(?<!\bfn )\b(?!(?:if|while|match|for|in|return|else|let|fn)\b)(\w+)\s*\(")],
    "ts": [("callable", r"\bfunction\s+(\w+)"), ("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("alias", r"\btype\s+(\w+)\s*="), ("enum", r"\benum\s+(\w+)"), ("import", r"\bfrom\s+['\"]([^'\"]+)"), ("extends", r"\bextends\s+(\w+)")],
    "java": [("class", r"\b(?:class|record)\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("callable", r"\b(?:public|protected|private|static)\s[\w<>\[\], ]*?(\w+)\s*\("), ("import", r"^import\s+([\w.]+)"), ("extends", r"\bextends\s+(\w+)"), ("implements", r"\bimplements\s+(\w+)")],
    "go": [("callable", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("record", r"^type\s+(\w+)\s+struct"), ("interface", r"^type\s+(\w+)\s+interface"), ("import", r"^\s*\"([\w./-]+)\"")],
}


def _spec_facts(path: str, text: str, spec: list[tuple[str, str]]) -> list[tuple]:
    out, comment = [], None
    for n, line in enumerate(text.split("\n"), 1):
        s = line.strip()
        if m := re.match(r"(?:///?!?|\*+|/\*\*?|#)\s?(.*)", s):
            comment = m[1]
            continue
        seen = set()
        code = re.sub(r"//.*", "", re.sub(r'"(?:\\.|[^"\\])*"', '""', line))  # what stands in texts and remarks is no code; imports name texts
        for fact, pattern in spec:
            for m in re.finditer(pattern, line if fact == "import" else code):
                if (fact, m[1]) not in seen:
                    seen.add((fact, m[1]))
                    out.append((path, fact, m[1], None, comment if fact not in ("call", "import") else None, n))
        comment = None if s else comment
    return out


def syntax(files: DataFrame, specs: dict | None = None) -> DataFrame:
    """Facts of each (path, text): declarations with their documentation, imports, calls. A file that can't be parsed has one `failed` fact; the others go on."""
    specs = specs or SPECS

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out: list[tuple] = []
            for path, text in zip(pdf["path"], pdf["text"]):
                ext = path.rpartition(".")[2]
                try:
                    if ext == "py":
                        out += _python_facts(path, text or "")
                    else:
                        spec = specs.get({"tsx": "ts", "js": "ts"}.get(ext, ext))
                        out += _spec_facts(path, text or "", spec) if spec else [(path, "unsupported", path, None, ext, 1)]
                except (SyntaxError, ValueError, RecursionError) as e:
                    out.append((path, "failed", path, None, str(e)[:200], 1))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FACT.split(", ")])

    return files.select("path", "text").mapInPandas(parse, FACT)


#: Python manifests, the strongest of a folder first; Gradle's dependency lines.
PYTHON_MANIFESTS = ("pyproject.toml", "setup.cfg", "setup.py", "requirements.txt")
GRADLE = r"(?:implementation|api|compileOnly|runtimeOnly|testImplementation|testRuntimeOnly|annotationProcessor)\s*\(?\s*['\"]([^:'\"\s]+):([^:'\"\s]+)(?::([^'\"\s]+))?['\"]"


def _requirement(line: str) -> tuple[str | None, str | None]:
    """(name, first version) of a requirement such as `name[extra]>=1.2,<2`."""
    m = re.match(r"\s*([\w.-]+)\s*(?:\[[^\]]*\])?\s*(?:[=<>~!]=?=?\s*([\w.*]+))?", line)
    return (m[1], m[2]) if m else (None, None)


def manifests(files: DataFrame) -> DataFrame:
    """path, package, dependency, version of Cargo metadata, package.json, pyproject, setup.cfg, requirements, pom and Gradle files (path, text).

    Of a folder's Python manifests only the one that PYTHON_MANIFESTS names first counts. A file that can't be parsed has one row of nulls.
    """
    name, folder = F.substring_index("path", "/", -1), F.regexp_replace("path", "/?[^/]*$", "")
    rank = F.array_position(F.array(*map(F.lit, PYTHON_MANIFESTS)), name)
    first = files.filter(name.isin(*PYTHON_MANIFESTS)).groupBy(folder.alias("folder")).agg(F.min(rank).alias("first"))
    files = files.withColumn("folder", folder).join(first, "folder", "left").filter(~name.isin(*PYTHON_MANIFESTS) | (rank == F.col("first")))

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for path, text in zip(pdf["path"], pdf["text"]):
                name = path.rpartition("/")[2]
                try:
                    if name == "package.json":
                        d = json.loads(text)
                        out += [(path, d.get("name"), k, v) for part in ("dependencies", "devDependencies") for k, v in d.get(part, {}).items()]
                    elif name == "cargo-metadata.json":
                        for p in json.loads(text)["packages"]:
                            out += [(path, p["name"], x["name"], x.get("req")) for x in p.get("dependencies", [])]
                    elif name == "requirements.txt":
                        for line in text.split("\n"):
                            if m := re.match(r"\s*([\w.-]+)\s*(?:[=<>~!]=?\s*([\w.]+))?", line.partition("#")[0]):
                                out.append((path, None, m[1], m[2]))
                    elif name == "pyproject.toml":
                        d = tomllib.loads(text)
                        own = d.get("project", {}) or d.get("tool", {}).get("poetry", {})
                        for line in own.get("dependencies", []) if isinstance(own.get("dependencies", []), list) else []:
                            out.append((path, own.get("name"), *_requirement(line)))
                        if isinstance(own.get("dependencies"), dict):
                            out += [(path, own.get("name"), k, v if isinstance(v, str) else v.get("version")) for k, v in own["dependencies"].items() if k != "python"]
                    elif name == "setup.cfg":
                        d = configparser.ConfigParser()
                        d.read_string(text)
                        lines = d.get("options", "install_requires", fallback="").split("\n")
                        out += [(path, d.get("metadata", "name", fallback=None), *_requirement(line)) for line in lines if line.strip()]
                    elif name in ("build.gradle", "build.gradle.kts"):
                        out += [(path, None, f"{m[1]}:{m[2]}", m[3]) for m in re.finditer(GRADLE, text)]
                    elif name == "pom.xml":
                        own = re.search(r"<artifactId>([^<]+)", text)
                        for m in re.finditer(r"<dependency>.*?<artifactId>([^<]+)</artifactId>(?:.*?<version>([^<]+))?.*?</dependency>", text, re.S):
                            out.append((path, own and own[1], m[1], m[2]))
                except (ValueError, KeyError, TypeError, AttributeError, configparser.Error):
                    out.append((path, None, None, None))
            yield pd.DataFrame(out, columns=["path", "package", "dependency", "version"])

    return files.select("path", "text").mapInPandas(parse, "path string, package string, dependency string, version string")


def diagnostics(lines: DataFrame) -> DataFrame:
    """tool, path, line, code, message of javac, tsc and ruff text lines and rustc JSON lines (value)."""
    v = F.col("value")
    ts, jv, rf = r"^(.+?)\((\d+),(\d+)\): error (TS\d+): (.*)$", r"^(.+?\.java):(\d+): (error|warning): (.*)$", r"^(.+?):(\d+):(\d+): ([A-Z]+\d+) (.*)$"
    g = lambda p, k: F.regexp_extract(v, p, k)
    row = lambda tool, path, line, code, msg: F.struct(F.lit(tool).alias("tool"), path.alias("path"), line.cast("int").alias("line"), code.alias("code"), msg.alias("message"))
    js = lambda p: F.get_json_object(v, p)
    found = (
        F.when(v.startswith("{"), row("rustc", js("$.message.spans[0].file_name"), js("$.message.spans[0].line_start"), js("$.message.code.code"), js("$.message.message"))).when(v.rlike(ts), row("tsc", g(ts, 1), g(ts, 2), g(ts, 4), g(ts, 5)))
        .when(v.rlike(jv), row("javac", g(jv, 1), g(jv, 2), g(jv, 3), g(jv, 4))).when(v.rlike(rf), row("ruff", g(rf, 1), g(rf, 2), g(rf, 4), g(rf, 5)))
    )
    return lines.select(found.alias("d")).filter("d is not null and d.path is not null").select("d.*")


def relative_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """path, target: the first existing candidate of each relative import. imports: path, name; files: path."""
    tries = ["", ".ts", ".tsx", ".d.ts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"]
    parts = F.split(F.concat(F.regexp_replace("path", "[^/]*$", ""), "name"), "/")
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    base = F.aggregate(parts, F.expr("cast(array() as array<string>)"), lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", up(acc)).otherwise(F.array_append(acc, x)))
    i = imports.filter(F.col("name").startswith(".")).select("path", "name", F.array_join(base, "/").alias("base")).distinct()
    c = i.select("path", "name", F.posexplode(F.array(*[F.concat("base", F.lit(x)) for x in tries])).alias("order", "target"))
    return c.join(files.select(F.col("path").alias("target")), "target", "left_semi").groupBy("path", "name").agg(F.min_by("target", "order").alias("target")).select("path", "target")


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """path, text of Markdown files outside dot folders, target, node_modules and vendor."""
    base = root.rstrip("/")
    raw = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,markdown}").text(base).select(F.col("_metadata.file_path").alias("full"), F.col("value").alias("text"))
    path = F.regexp_replace("full", "^.*?" + re.escape(base.replace("file://", "")) + "/", "")
    return raw.select(path.alias("path"), "text").filter(~F.col("path").rlike(r"(^|/)(\.[^/]+|target|node_modules|vendor)/"))


def exported_relations(lines: DataFrame, targets: DataFrame) -> dict[str, DataFrame]:
    """relation (source, target, kind) and rejected (value, problem) of JSON lines; unknown ends and kinds are rejected. targets: id."""
    j = lines.select("value", *[F.get_json_object("value", f"$.{k}").alias(k) for k in ("source", "target", "kind")])
    t = targets.select("id").distinct()
    j = j.join(t.select(F.col("id").alias("source"), F.lit(True).alias("s")), "source", "left").join(t.select(F.col("id").alias("target"), F.lit(True).alias("d")), "target", "left")
    fine = F.coalesce(F.col("kind").isin("reference", "call", "type", "implementation"), F.lit(False))
    problem = F.when(F.col("kind").isNull(), "malformed").when(~fine, "unknown_kind").when(F.col("s").isNull(), "unknown_source").when(F.col("d").isNull(), "unknown_target")
    return {"relation": j.filter(problem.isNull()).select("source", "target", "kind"), "rejected": j.filter(problem.isNotNull()).select("value", problem.alias("problem"))}


def named_evidence(records: DataFrame, targets: DataFrame) -> DataFrame:
    """name, file, id: documentation or tool results matched to targets by name or qualified name; where several match, those in the record's file; an id only if exactly one is left.

    records: name, file; targets: id, name, path.
    """
    t = targets.select("id", F.col("name").alias("tn"), F.col("path").alias("tp"))
    r = records.select("name", "file").distinct()
    forms = r.select("name", "file", F.explode(F.array_distinct(F.array("name", F.substring_index("name", "::", -1)))).alias("tn"))
    j = forms.join(t, "tn", "left").withColumn("here", F.coalesce(F.col("tp") == F.col("file"), F.lit(False)))
    local, every = F.when(F.col("here"), F.col("id")), F.col("id")
    g = j.groupBy("name", "file").agg(*[f(x).alias(n + k) for k, x in (("_local", local), ("_every", every)) for n, f in (("n", F.count_distinct), ("id", F.min))])
    found = F.when(F.col("n_local") == 1, F.col("id_local")).when((F.col("n_local") == 0) & (F.col("n_every") == 1), F.col("id_every"))
    return g.select("name", "file", found.alias("id"))

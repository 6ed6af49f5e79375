"""Checks of models' answers and of plans: assessments, thresholds, contracts in comments, repair of JSON, adapters."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assessment_errors(assessments: DataFrame, dimensions: list[str]) -> DataFrame:
    """id, error: a dimension missing, given twice or unknown; passed with a deficient one; a finding without citation.

    assessments: id, result, given array<struct<name,state>>, citations array<array<string>>.
    """
    names = F.transform("given", lambda g: g["name"])
    want = F.array(*map(F.lit, dimensions))
    checks = [
        ("missing_dimension", F.size(F.array_except(want, names)) > 0), ("unknown_dimension", F.size(F.array_except(names, want)) > 0), ("repeated_dimension", F.size(names) != F.size(F.array_distinct(names))),
        ("passed_with_deficiency", (F.col("result") == "passed") & F.exists("given", lambda g: g["state"] == "deficient")), ("finding_without_citation", F.exists("citations", lambda c: F.size(c) == 0)),
    ]
    return assessments.select("id", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]))).alias("error"))


def code_identifier(c: Column) -> Column:
    """Mixed case or an underscore within the last part of a path of names."""
    last = F.substring_index(c, "::", -1)
    return last.rlike("_") | (last.rlike("[a-z][A-Z]|[A-Z][a-z]+[A-Z]"))


def contract_sections(comments: DataFrame) -> DataFrame:
    """id, section, text of the `# Safety`, `# Panics`, ... parts of doc comments (id, text)."""
    from pyspark.sql import Window

    lines = comments.select("id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    heading = F.regexp_extract("line", r"^#+\s+(\w+)\s*$", 1)
    w = Window.partitionBy("id").orderBy("n")
    lines = lines.withColumn("section", F.last(F.when(heading != "", F.lower(heading)), ignorenulls=True).over(w)).filter((heading == "") & F.col("section").isNotNull() & (F.trim("line") != ""))
    return lines.groupBy("id", "section").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("ls")).select("id", "section", F.concat_ws("\n", F.transform("ls", lambda x: x["line"])).alias("text"))


def repair_json(text: str | None) -> str | None:
    """The first JSON value in a model's answer: fences off, trailing commas out, open brackets closed; None if that is not enough."""
    s = re.sub(r"```(?:json)?", "", text or "").strip()
    at = min([k for k in (s.find("{"), s.find("[")) if k >= 0], default=-1)
    if at < 0:
        return None
    s, stack, quoted, end = s[at:], [], False, None
    k = 0
    while k < len(s):
        c = s[k]
        if quoted:
            k += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
            if not stack:
                end = k + 1
                break
        k += 1
    s = s[:end] if end else s + '"' * quoted + "".join(reversed(stack))
    s = re.sub(r",\s*([}\]])", r"\1", s)
    try:
        return json.dumps(json.loads(s), sort_keys=True)
    except ValueError:
        return None


def review(frames: DataFrame, reviewer: Callable[[str], str], attempts: int = 2) -> DataFrame:
    """id, answer, tries, error: a reviewer (any function of a prompt) on each row (id, prompt), its JSON repaired, tried again at most `attempts` times.

    A reviewer that fails on one row leaves an error there and goes on.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, prompt in zip(pdf["id"], pdf["prompt"]):
                answer = error = None
                for tries in range(1, attempts + 1):
                    try:
                        answer, error = repair_json(reviewer(prompt)), None
                    except Exception as e:  # one row's failure is that row's result
                        error = f"{type(e).__name__}: {e}"
                    if answer is not None:
                        break
                out.append((str(key), answer, tries, error if answer is None else None))
            yield pd.DataFrame(out, columns=["id", "answer", "tries", "error"])

    return frames.select("id", "prompt").mapInPandas(run, "id string, answer string, tries int, error string")


def run_adapters(adapters: dict[str, Callable[[], DataFrame]], spark) -> tuple[DataFrame | None, DataFrame]:
    """(union of the targets with their adapter, failed partitions): an adapter that fails on being set up costs only its own rows."""
    found, failed = None, []
    for name, make in sorted(adapters.items()):
        try:
            df = make().withColumn("adapter", F.lit(name))
            found = df if found is None else found.unionByName(df)
        except Exception as e:
            failed.append((name, str(e).split("\n")[0][:200]))
    return found, spark.createDataFrame(failed, "adapter string, diagnostic string")


def merge_adapters(targets: DataFrame, fields: list[str]) -> DataFrame:
    """id, owners, versions, conflict: equal duplicates of several adapters collapse, unequal ones conflict."""
    g = targets.groupBy("id").agg(F.array_sort(F.collect_set("adapter")).alias("owners"), F.count_distinct(F.struct(*fields)).alias("versions"))
    return g.select("id", F.concat_ws(",", "owners").alias("owners"), "versions", (F.col("versions") > 1).alias("conflict"))


def threshold_violations(rates: DataFrame, least: dict[str, int], most: dict[str, int], ci: bool) -> DataFrame:
    """run, rule, value: rates below their least or over their most; a null rate is a violation unless in CI mode."""
    rules = [F.when((F.col(k) < v) | (F.col(k).isNull() & F.lit(not ci)), F.struct(F.lit(f"min_{k}").alias("rule"), F.col(k).alias("value"))) for k, v in least.items()]
    rules += [F.when(F.col(k) > v, F.struct(F.lit(f"max_{k}").alias("rule"), F.col(k).alias("value"))) for k, v in most.items()]
    return rates.select("run", F.explode(F.array_compact(F.array(*rules))).alias("v")).select("run", "v.*")


def trim_scope(scopes: DataFrame, budget: int) -> DataFrame:
    """scope, kept (names), dropped: items leave from the last class (boundary targets, boundary relations, internal, constituents, cycles) until the rest fits.

    Which item leaves depends on those before it, so one scope is one row of a bounded array. scopes: scope, items array<struct<class,name,bytes>>.
    """
    order = ["boundary_target", "boundary_relation", "internal", "constituent", "cycle"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for scope, items in zip(pdf["scope"], pdf["items"]):
                left = sorted((dict(x) if isinstance(x, dict) else x.asDict() for x in items), key=lambda x: (-order.index(x["class"]), x["name"]))
                total = sum(x["bytes"] for x in left)
                n = len(left)
                while left and total > budget:
                    total -= left.pop()["bytes"]
                out.append((scope, sorted(x["name"] for x in left), n - len(left)))
            yield pd.DataFrame(out, columns=["scope", "kept", "dropped"])

    return scopes.select("scope", "items").mapInPandas(run, f"scope {dict(scopes.dtypes)['scope']}, kept array<string>, dropped int")

"""Where a caller plugs in functions of their own: readers, sinks, resolvers, expanders, predicates, tools.

Each is a plain function over DataFrames or columns, so that what is plugged in runs where the rows are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_access(snapshot: DataFrame, blobs: DataFrame, paths: DataFrame) -> DataFrame:
    """path, text, problem of the asked paths as the snapshot has them: unknown_path, missing_content, wrong_content. snapshot: path, content; blobs: content, text."""
    from lodestar.functions.ids import content_hash

    j = paths.select("path").distinct().join(snapshot.select("path", "content", F.lit(True).alias("there")), "path", "left").join(blobs.select("content", "text"), "content", "left")
    problem = F.when(F.col("there").isNull(), "unknown_path").when(F.col("text").isNull(), "missing_content").when(content_hash("text") != F.col("content"), "wrong_content")
    return j.select("path", F.when(problem.isNull(), F.col("text")).alias("text"), problem.alias("problem"))


def drain(rows: DataFrame, sink: Callable[[Iterator[dict]], int]) -> int:
    """Give every partition's rows to a sink (any function of an iterator of dicts, which says how many it took); how many were taken in all.

    A lost task runs again, so a sink must take a row twice without harm.
    """

    def take(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = sink(row for pdf in frames for row in pdf.to_dict("records"))
        yield pd.DataFrame({"n": [n]})

    return int(rows.mapInPandas(take, "n long").agg(F.sum("n")).first()[0] or 0)


def isolated(rows: DataFrame, adapter: Callable[[pd.DataFrame], pd.DataFrame], schema: str, group: str) -> DataFrame:
    """An adapter on each group of rows; a group on which it fails is one row of its key and `failed`, the others go on. schema: of the adapter's rows, which hold the group."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return adapter(pdf)[names].assign(failed=None)
        except Exception as e:  # one group's failure is that group's result
            return pd.DataFrame([{group: pdf[group].iloc[0], "failed": f"{type(e).__name__}: {e}"[:200]}]).reindex(columns=[*names, "failed"])

    return rows.groupBy(group).applyInPandas(run, f"{schema}, failed string")


def resolve_fingerprints(work: DataFrame, resolver: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work with fingerprint: the resolver gives (target, policy, fingerprint) for the distinct pairs that it is asked; null where it knows none."""
    known = resolver(work.select("target", "policy").distinct()).dropDuplicates(["target", "policy"])
    return work.join(known.select("target", "policy", "fingerprint"), ["target", "policy"], "left")


def expand_evidence(requests: DataFrame, expander: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """request, evidence: what the expander adds for the requests without a denial. requests: request, denial and what the expander reads; its rows: request, evidence."""
    open_ones = requests.filter("denial is null")
    return expander(open_ones).select("request", "evidence").distinct().join(open_ones.select("request").distinct(), "request", "left_semi")


def prune(records: DataFrame, predicate: Callable[[DataFrame], Column]) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes) by a predicate over the records' columns; null counts as stay."""
    gone = F.coalesce(predicate(records), F.lit(False))
    return records.filter(~gone), records.filter(gone)


@dataclass(frozen=True)
class ToolPolicy:
    """Which external tools may run, with which first arguments, in which environment, and how long."""

    allowed: dict[str, tuple[str, ...]]
    environment: tuple[str, ...] = ("PATH",)
    seconds: int = 60
    network: bool = False


def tool_denial(policy: ToolPolicy, tool: Column | str, arguments: Column | str, environment: Column | str, seconds: Column | str, network: Column | str) -> Column:
    """Why a tool's run is not allowed, or null: unknown_tool, forbidden_argument, forbidden_environment, too_long, network."""
    tool, arguments, environment, seconds, network = (F.col(x) if isinstance(x, str) else x for x in (tool, arguments, environment, seconds, network))
    first = F.get(arguments, F.lit(0))
    unknown, bad = ~tool.isin(*policy.allowed), F.lit(False)
    for name, verbs in policy.allowed.items():
        bad = bad | ((tool == name) & ~F.coalesce(first.isin(*verbs), F.lit(False)))
    stray = F.size(F.array_except(environment, F.array(*map(F.lit, policy.environment)))) > 0
    return (
        F.when(unknown, "unknown_tool").when(bad, "forbidden_argument").when(stray, "forbidden_environment").when(seconds > policy.seconds, "too_long").when(network & F.lit(not policy.network), "network")
    )

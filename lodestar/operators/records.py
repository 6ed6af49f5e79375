"""Assessments behind outcomes, the findings that seven kinds of reports hold, evaluation, binding of drafts, orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.ids import basis_points, content_hash
from lodestar.functions.text import format_location

#: The name under which a policy version's findings are reported.
POLICY_NAMES = {
    "documentation-internal@1": "internal-documentation", "documentation-public-api@1": "documentation", "correctness-conservative@1": "correctness", "architecture-code-derived@1": "architecture",
    "optimization-conservative@1": "optimization", "maintainability-conservative@1": "maintainability", "conformance-design-aligned@1": "conformance", "testing-conservative@1": "testing",
}


def assessments(work: DataFrame, outcomes: DataFrame, artifacts: DataFrame, kind: str) -> DataFrame:
    """work_id, target, reference, payload, problem of the outcomes of these work items.

    problem: unfinished_work (an outcome of work that has not succeeded), missing_artifact, wrong_kind, wrong_hash, or
    null. work: work_id, target, state; outcomes: work_id, reference; artifacts: reference, kind, payload.
    """
    j = outcomes.join(work.select("work_id", "target", "state"), "work_id").join(artifacts.select("reference", F.col("kind").alias("is_kind"), "payload"), "reference", "left")
    problem = (
        F.when(F.col("state") != "succeeded", "unfinished_work").when(F.col("is_kind").isNull(), "missing_artifact").when(F.col("is_kind") != kind, "wrong_kind")
        .when(content_hash("payload") != F.col("reference"), "wrong_hash")
    )
    return j.select("work_id", "target", "reference", "payload", problem.alias("problem"))


def findings_of(clusters: DataFrame) -> DataFrame:
    """id, policy, title, severity, confidence, targets, primary_location, description, dimensions: one common row for each report's cluster.

    clusters: id, policy_version, title, severity, confidence, description, dimensions, citations (list of structs path,
    start, end, line, column; a null path is no place), occurrences (targets). Targets and places are distinct and in
    order; places are joined by commas, null if there is none.
    """
    places = F.transform(F.filter("citations", lambda c: c["path"].isNotNull()), lambda c: format_location(c["path"], c["start"], c["end"], c["line"], c["column"]))
    names = F.create_map(*[x for pair in POLICY_NAMES.items() for x in map(F.lit, pair)])
    joined = F.array_join(F.array_sort(F.array_distinct(places)), ", ")
    return clusters.select(
        "id", F.coalesce(names[F.col("policy_version")], F.col("policy_version")).alias("policy"), "title", "severity", "confidence", F.array_sort(F.array_distinct("occurrences")).alias("targets"),
        F.when(F.size(places) > 0, joined).alias("primary_location"), "description", F.transform("dimensions", F.lower).alias("dimensions"),
    )


def evaluate(clusters: DataFrame, latest: DataFrame, issues: DataFrame, summaries: DataFrame) -> DataFrame:
    """policy, accepted, rejected, deferred, unadjudicated, matched, precision_bp, recall_bp, duplicate_bp, unable_bp over all runs of a policy.

    clusters: policy, run, finding, occurrences; latest (the adjudications that hold): run, finding, state,
    expected_issue; issues (the corpus): policy, issue; summaries: policy, run, total, unable. An accepted finding's issue
    counts once a run, and only if the corpus has it.
    """
    j = clusters.join(latest.select("run", "finding", "state", F.col("expected_issue").alias("issue")), ["run", "finding"], "left")
    j = j.join(issues.select("policy", "issue", F.lit(True).alias("known")).distinct(), ["policy", "issue"], "left")
    s = F.col("state")
    hit = F.when((s == "accepted") & F.col("known"), F.struct("run", "issue"))
    a = j.groupBy("policy").agg(*[F.count_if(s == x).alias(x) for x in ("accepted", "rejected", "deferred")], F.count_if(s.isNull()).alias("unadjudicated"), F.count_distinct(hit).alias("matched"), F.sum("occurrences").alias("occ"), F.count(F.lit(1)).alias("n"))
    runs = summaries.groupBy("policy").agg(F.count_distinct("run").alias("runs"), F.sum("total").alias("total"), F.sum("unable").alias("unable"))
    corpus = issues.distinct().groupBy("policy").agg(F.count(F.lit(1)).alias("issues"))
    e = a.join(runs, "policy").join(corpus, "policy", "left")
    return e.select(
        "policy", "accepted", "rejected", "deferred", "unadjudicated", "matched", basis_points("accepted", F.col("accepted") + F.col("rejected")).alias("precision_bp"),
        basis_points("matched", F.greatest(F.coalesce("issues", F.lit(0)) * F.col("runs"), F.lit(1))).alias("recall_bp"),
        basis_points(F.col("occ") - F.col("n"), F.col("occ")).alias("duplicate_bp"), basis_points("unable", F.col("total")).alias("unable_bp"),
    )


def bind(drafts: DataFrame, frames: DataFrame) -> DataFrame:
    """id, citations, unknown of drafts (id, work_id, evidence): the evidence of a draft that is in its work item's frame, and how much is not.

    frames: work_id, evidence. A draft with unknown evidence cannot be bound.
    """
    asked = drafts.select("id", "work_id", F.explode_outer(F.array_distinct("evidence")).alias("evidence"))
    known = frames.select("work_id", "evidence", F.lit(True).alias("in_frame")).distinct()
    j = asked.join(known, ["work_id", "evidence"], "left")
    fits = F.when(F.col("in_frame"), F.col("evidence"))
    return j.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(fits)), ",").alias("citations"), F.count_if(F.col("evidence").isNotNull() & F.col("in_frame").isNull()).alias("unknown"))


def canonical(df: DataFrame) -> DataFrame:
    """df in the order of id, for exports: ranges of ids, so that no task sorts everything."""
    return df.orderBy("id")


def assessment_order(df: DataFrame) -> DataFrame:
    """df by target, then work item."""
    return df.orderBy("target", "work_id")


def evidence_index(evidence: DataFrame, targets: DataFrame) -> DataFrame:
    """target, evidence, n (from 1, in order of evidence), unknown_target: each target's evidence once, one row each, so that no list grows with the data. evidence: target, evidence; targets: id."""
    known = targets.select(F.col("id").alias("target"), F.lit(True).alias("known")).distinct()
    n = F.row_number().over(Window.partitionBy("target").orderBy("evidence")).cast("long")
    return evidence.select("target", "evidence").distinct().join(known, "target", "left").select("target", "evidence", n.alias("n"), F.col("known").isNull().alias("unknown_target"))


def upstream_signals(clusters: DataFrame, occurrences: DataFrame) -> DataFrame:
    """target, signals: clusters that nobody rejected, counted for each target that they occur at. clusters: cluster, adjudication; occurrences: cluster, target."""
    live = clusters.filter("adjudication != 'rejected'").select("cluster")
    return occurrences.select("cluster", "target").distinct().join(live, "cluster", "left_semi").groupBy("target").agg(F.count(F.lit(1)).alias("signals"))


def put_evidence(existing: DataFrame, new: DataFrame) -> DataFrame:
    """hash, action of new records (detail as JSON text): the key is the hash of the canonical JSON, keys in order; insert, same, or collision where the hash has another content."""
    from lodestar.functions.ids import content_hash

    form = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.from_json("detail", "map<string,string>")))))
    n = new.select(content_hash(form).alias("hash"), form.alias("form")).distinct()
    j = n.join(existing.select("hash", F.col("form").alias("had")), "hash", "left")
    return j.select("hash", F.when(F.col("had").isNull(), "insert").when(F.col("had") == F.col("form"), "same").otherwise("collision").alias("action"))

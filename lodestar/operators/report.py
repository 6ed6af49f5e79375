"""Findings: clusters, two-phase matching of runs, gates, evaluation rates, backlog, publication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.ids import basis_points, derived_id, severity_rank
from lodestar.functions.text import normalize_claim
from lodestar.operators.ordered import ranked


def clusters(findings: DataFrame, keys: list[str], extra: list[str] | None = None) -> DataFrame:
    """cluster, occurrences, representative (least id) and the keys: findings of one canonical claim.

    The canonical claim is the keys' texts in lower case with blanks collapsed; policies differ in the keys they add.
    """
    keys = keys + (extra or [])
    canon = [normalize_claim(k).alias(k) for k in keys]
    f = findings.select("id", *canon).withColumn("cluster", derived_id("cluster", *keys))
    return f.groupBy("cluster", *keys).agg(F.count(F.lit(1)).alias("occurrences"), F.min("id").alias("representative"))


#: What a policy's canonical claim holds besides title, description, dimensions and citations.
CLAIM_EXTRA = {
    "documentation": (), "correctness": ("defect_kind", "failure_path"), "testing": ("subject", "recommended_level"), "optimization": ("finding_kind", "proposed_optimization"),
    "maintainability": ("finding_kind", "refactoring_pattern"), "conformance": ("declared_intent", "observed_implementation", "discrepancy"), "architecture": ("defect", "target", "scope"),
}


def policy_clusters(findings: DataFrame, policy: str) -> DataFrame:
    """cluster, occurrences, representative (least id): findings of one policy with the same canonical claim.

    findings: id, title, description, dimensions and citations (lists), and the policy's CLAIM_EXTRA; for architecture
    also verification, and the result's verification is disputed where occurrences differ in it. Documentation claims
    ignore case and blanks, the others take texts as they are. Lists count as sets in order.
    """
    claim = normalize_claim if policy == "documentation" else F.col
    listed = lambda name: F.array_join(F.array_sort(F.array_distinct(name)), "\x1f")
    parts = {"title": claim("title"), "description": claim("description"), "dimensions": listed("dimensions"), "citations": listed("citations")}
    if policy == "architecture":  # the claim's own id takes part, its title and citations do not
        parts = {"finding": F.col("finding"), "description": F.col("description"), "dimensions": listed("dimensions")}
    keyed = findings.withColumn("cluster", derived_id("cluster", *parts.values(), *CLAIM_EXTRA[policy]))
    agg = [F.count(F.lit(1)).alias("occurrences"), F.min("id").alias("representative")]
    if policy == "architecture":
        agg.append(F.when(F.count_distinct("verification") > 1, "disputed").otherwise(F.min("verification")).alias("verification"))
    return keyed.groupBy("cluster").agg(*agg)


#: Findings of one claim that one task ranks; with more in any claim, ranks are counted over ranges of all findings.
PER_CLAIM = 100_000


def _claim_ranks(df: DataFrame, claim: list[str], order, name: str, most: int) -> DataFrame:
    if most <= PER_CLAIM:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*claim).orderBy(order)))
    return ranked(df, claim, [order], name)


def match(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """baseline_id, current_id, category (persistent, new, resolved), matched_by (id, claim).

    First by id (the last of equal ids in a run stands for them); then one to one on (policy, target, normalised title):
    the latest baseline finding with the earliest current one. A claim's findings are told apart by rank, so that claims
    of any number of findings are joined on equal ranks, not in one task.
    """
    last = lambda df: df.groupBy("id").agg(F.max(F.struct("policy", "target", "title", "severity")).alias("f")).select("id", "f.*")
    claim = F.lower(F.trim("title"))
    b = last(baseline).select(F.col("id").alias("baseline_id"), F.col("policy").alias("bp"), F.col("target").alias("bt"), claim.alias("bc"), F.col("severity").alias("bs"))
    c = last(current).select(F.col("id").alias("current_id"), F.col("policy").alias("cp"), F.col("target").alias("ct"), claim.alias("cc"), F.col("severity").alias("cs"))
    exact = b.join(c, F.col("baseline_id") == F.col("current_id"))
    sizes = [df.groupBy("policy", "target", claim.alias("claim")).count() for df in (baseline, current)]
    most = sizes[0].unionByName(sizes[1]).agg(F.max("count")).first()[0] or 0
    b2 = _claim_ranks(b.join(exact.select("baseline_id"), "baseline_id", "left_anti"), ["bp", "bt", "bc"], F.col("baseline_id").desc(), "rn", most)
    c2 = _claim_ranks(c.join(exact.select("current_id"), "current_id", "left_anti"), ["cp", "ct", "cc"], F.col("current_id"), "cn", most)
    rest = b2.join(c2, (F.col("bp") == F.col("cp")) & (F.col("bt") == F.col("ct")) & (F.col("bc") == F.col("cc")) & (F.col("rn") == F.col("cn")), "full_outer")
    category = F.when(F.col("baseline_id").isNull(), "new").when(F.col("current_id").isNull(), "resolved").otherwise("persistent")
    by = F.when(F.col("baseline_id").isNotNull() & F.col("current_id").isNotNull(), "claim")
    shape = ["baseline_id", "current_id"]
    return exact.select(*shape, F.lit("persistent").alias("category"), F.lit("id").alias("matched_by"), F.coalesce("cs", "bs").alias("severity")).unionByName(rest.select(*shape, category.alias("category"), by.alias("matched_by"), F.coalesce("cs", "bs").alias("severity")))


def gate(matched: DataFrame, max_critical: int = 0, max_high: int = 0, max_medium: int | None = None, max_total: int | None = None, unadjudicated: bool = False) -> DataFrame:
    """rule, limit, found of each violated threshold on new findings; unadjudicated: new findings that nobody reviewed (adjudication) violate too."""
    new = matched.filter("category = 'new'")
    open_ones = F.count_if(F.col("adjudication") == "unreviewed") if unadjudicated else F.lit(0).cast("long")
    n = new.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium")], F.count(F.lit(1)).alias("total"), open_ones.alias("unadjudicated"))
    rules = [("critical", max_critical), ("high", max_high), ("medium", max_medium), ("total", max_total), ("unadjudicated", 0 if unadjudicated else None)]
    found = F.array(*[F.struct(F.lit(f"max_new_{r}").alias("rule"), F.lit(limit).cast("long").alias("limit"), F.col(r).alias("found")) for r, limit in rules if limit is not None])
    return n.select(F.explode(found).alias("v")).select("v.*").filter("found > limit")


def latest(adjudications: DataFrame) -> DataFrame:
    """The record of the highest revision for each (run, finding)."""
    return adjudications.groupBy("run", "finding").agg(F.max_by(F.struct("revision", "state", "expected_issue"), "revision").alias("r")).select("run", "finding", "r.*")


def rates(latest_records: DataFrame, expected: int) -> DataFrame:
    """run, accepted, rejected, deferred, matched_issues, precision_bp (null if nothing is judged), recall_bp."""
    a = latest_records.groupBy("run").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("accepted", "rejected", "deferred")], F.count_distinct("expected_issue").alias("matched_issues"))
    return a.withColumn("precision_bp", basis_points("accepted", F.col("accepted") + F.col("rejected"))).withColumn("recall_bp", basis_points("matched_issues", F.lit(max(expected, 1))))


def stability(members: DataFrame) -> DataFrame:
    """One row: pairs, common, all, stability_bp over all pairs of runs (sums before the division). members: run, key.

    |A and B| by a join on the key; |A or B| from sizes; null with fewer than two runs, 10000 if all runs are empty.
    """
    m = members.distinct()
    sizes = m.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    a = sizes.agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("total"))
    # over all pairs the sizes add up to (runs - 1) times the total; a key in k runs is common to k (k - 1) / 2 pairs
    common = m.groupBy("key").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.expr("k * (k - 1) div 2")), F.lit(0)).alias("common"))
    both = a.crossJoin(common)  # one row by one row
    union = F.expr("coalesce(total, 0) * (runs - 1) - common")
    bp = F.when(F.col("runs") < 2, F.lit(None).cast("long")).when(union == 0, 10000).otherwise(F.expr("common * 10000 div (total * (runs - 1) - common)"))
    return both.select(F.expr("runs * (runs - 1) div 2").alias("pairs"), F.col("common"), union.alias("union_size"), bp.alias("stability_bp"))


#: Categories of a backlog in their order, and priorities by severity.
BACKLOG = ("stub_or_unimplemented", "scope_gap", "missing_todo", "general_gap", "missing_tests")
PRIORITIES = ("critical", "high", "medium", "low", "note")


def backlog_class(title: Column, description: Column | None = None, dimensions: Column | None = None) -> Column:
    """First keyword rule that fits title and description; null if none does. dimensions: list of names."""
    s = F.lower(title) if description is None else F.concat(F.lower(title), F.lit(" "), F.lower(description))
    has = lambda *words: reduce(lambda a, b: a | b, [s.contains(w) for w in words])
    general = has("gap")
    if dimensions is not None:
        general = general | (F.array_contains(dimensions, "failure_paths") & has("unhandled", "panic"))
    return (
        F.when(has("todo") & has("missing", "without", "no todo", "comment"), "missing_todo").when(has("scope gap", "invariant"), "scope_gap")
        .when(has("stub", "todo!(", "unimplemented!(", "placeholder", "mock"), "stub_or_unimplemented").when(has("incomplete", "unimplemented", "not yet implemented", "future work"), "scope_gap")
        .when(general, "general_gap")
    )


def backlog_priority(severity: Column | str) -> Column:
    """0 for critical to 4 for note."""
    out = F.lit(None).cast("int")
    for k, s in enumerate(PRIORITIES):
        out = F.when((F.col(severity) if isinstance(severity, str) else severity) == s, k).otherwise(out)
    return out


def backlog_groups(items: DataFrame) -> DataFrame:
    """position (the category's place in BACKLOG), category, items, urgent (priority 0 or 1). items: category, severity."""
    place = F.array_position(F.array(*map(F.lit, BACKLOG)), F.col("category")).cast("int") - 1
    g = items.filter("category is not null").groupBy("category").agg(F.count(F.lit(1)).alias("items"), F.count_if(backlog_priority("severity") < 2).alias("urgent"))
    return g.select(place.alias("position"), "category", "items", "urgent")


def error_class(message: Column) -> Column:
    """What a work item failed of; the words' case counts."""
    has = lambda *words: reduce(lambda a, b: a | b, [message.contains(w) for w in words])
    return (
        F.when(has("invalid candidates", "policy candidate contract violation"), "Candidate Schema Mismatch").when(has("invalid provider output"), "Invalid Provider Output")
        .when(has("provider unavailable"), "Provider Unavailable").when(has("budget exceeded", "token budget"), "Budget Exceeded").when(has("stalled", "lease expired"), "Work Stalled")
        .when(has("invalid policy assessment"), "Policy Assessment Invalid").otherwise("Other Work Failure")
    )


def error_log(failed: DataFrame, events: DataFrame) -> DataFrame:
    """category, failures, events: failed work items by what they failed of, with their retries and failures in the log. failed: work_id, last_error; events: work_id, kind."""
    log = events.filter("kind in ('retry_scheduled', 'failed')").groupBy("work_id").agg(F.count(F.lit(1)).alias("n"))
    j = failed.select("work_id", error_class(F.coalesce("last_error", F.lit(""))).alias("category")).join(log, "work_id", "left")
    return j.groupBy("category").agg(F.count(F.lit(1)).alias("failures"), F.coalesce(F.sum("n"), F.lit(0)).alias("events"))


def summary(work: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: total, a count for every state of work and result of succeeded work, occurrences, duplicates. work: state, result; clusters: occurrences."""
    states, results = ("pending", "leased", "succeeded", "failed", "cancelled"), ("passed", "candidate_findings", "unable_to_verify")
    w = work.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in states], *[F.count_if(F.col("result") == r).alias(r) for r in results])
    k = clusters.agg(F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"), F.count(F.lit(1)).alias("clusters"))
    return w.crossJoin(k).withColumn("duplicates", F.col("occurrences") - F.col("clusters")).drop("clusters")  # one row by one row


def retain(findings: DataFrame, policy: str | None = None, dimension: str | None = None, severity: str | None = None) -> DataFrame:
    """findings of one policy, dimension and severity, as far as they are given; a dimension needs a policy."""
    if dimension is not None and policy is None:
        raise ValueError("a dimension belongs to one policy")
    keep = F.lit(True)
    keep = keep if policy is None else keep & (F.col("policy") == policy)
    keep = keep if dimension is None else keep & F.array_contains("dimensions", dimension)
    return findings.filter(keep if severity is None else keep & (F.col("severity") == severity))


#: Pipelines in their order, and the two whose policy must match exactly.
PIPELINES = ("documentation", "internal-documentation", "correctness", "architecture", "optimization", "maintainability", "conformance", "testing")
EXACT = {"documentation": "documentation-public-api@1", "internal-documentation": "documentation-internal@1"}


def pipelines_present(work: DataFrame) -> DataFrame:
    """run, pipeline: the pipelines that own a policy of a run's work. work: run, policy."""
    owner = F.lit(None).cast("string")
    for name in reversed(PIPELINES):
        owns = F.col("policy") == EXACT[name] if name in EXACT else F.col("policy").startswith(name)
        owner = F.when(owns, name).otherwise(owner)
    return work.select("run", owner.alias("pipeline")).filter("pipeline is not null").distinct()


def publish(items: DataFrame, receipts: DataFrame, force: bool = False) -> DataFrame:
    """id, hash, action: skip what was published to the same place with the same content before, unless forced."""
    seen = receipts.select(F.col("place").alias("rp"), F.col("hash").alias("rh")).distinct().withColumn("seen", F.lit(True))
    i = items.join(seen, (F.col("place") == F.col("rp")) & (F.col("hash") == F.col("rh")), "left")
    return i.select("id", "place", "hash", F.when(F.col("seen").isNotNull() & F.lit(not force), "skip").otherwise("publish").alias("action"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """id, rule, level, result (JSON text) of each finding."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    body = F.to_json(F.struct(F.col("policy").alias("ruleId"), level.alias("level"), F.struct(F.trim("title").alias("text")).alias("message")))
    return findings.select("id", F.col("policy").alias("rule"), level.alias("level"), body.alias("result"))


def top_signals(findings: DataFrame, k: int) -> DataFrame:
    """The k gravest findings of each target: severity, confidence, then id."""
    w = Window.partitionBy("target").orderBy(severity_rank("severity").desc(), F.col("confidence").desc(), "id")
    return findings.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

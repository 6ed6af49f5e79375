"""Which targets a policy reviews: target classes, rule tables by (class, visibility), reasons.

A rule table is a small DataFrame of fixed size; a target without a rule is pending, except where a policy says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Portable kinds with a class of their own, kinds of declarations and of containers, visibilities.
CLASSES = ("workspace", "package", "module", "type", "callable", "constant", "test", "file")
DECLARED = ("callable", "type", "module", "constant", "test")
CONTAINERS = ("workspace", "package", "file", "language_specific", "other")
ALL_CLASSES = CLASSES + ("language_specific", "other")
VISIBILITIES = ("public", "restricted", "private", "inherited", "unknown", "not_applicable")
#: Marks in the names of a language's own kinds.
CALLABLE_MARKS = ("func", "method", "fn", "callable")
TYPE_MARKS = ("class", "struct", "interface", "enum", "trait", "type")


def _has(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def target_class(kind: Column | str, language: Column | str) -> Column:
    """The class of a portable kind; language_specific where a language is given."""
    kind, language = (F.col(x) if isinstance(x, str) else x for x in (kind, language))
    return F.when(language.isNotNull(), "language_specific").when(kind.isin(*CLASSES), kind).otherwise("other")


def maintainability_class(kind: Column | str, language: Column | str) -> Column:
    kind, language = (F.col(x) if isinstance(x, str) else x for x in (kind, language))
    low = F.lower(kind)
    own = F.when(_has(low, CALLABLE_MARKS), "callable").when(_has(low, TYPE_MARKS), "type").when(_has(low, ("module", "package", "namespace")), "module").otherwise("unknown")
    return F.when(language.isNotNull(), own).when(kind.isin("callable", "type", "module"), kind).otherwise("unknown")


def testing_class(kind: Column | str, language: Column | str, is_test_code: Column) -> Column:
    """module, member, package, workspace, test_code or unknown; recognised test code comes first."""
    kind, language = (F.col(x) if isinstance(x, str) else x for x in (kind, language))
    low = F.lower(kind)
    own = F.when(_has(low, ("test", "bench")), "test_code").when(_has(low, ("module", "namespace")), "module").when(_has(low, CALLABLE_MARKS + TYPE_MARKS), "member").otherwise("unknown")
    portable = F.when(kind.isin("file", "module"), "module").when(kind.isin("callable", "type", "constant"), "member").when(kind.isin("package", "workspace"), kind).when(kind == "test", "test_code").otherwise("unknown")
    return F.when(is_test_code, "test_code").when(language.isNotNull(), own).otherwise(portable)


def _rules(policy: str) -> list[tuple[str, str, str]]:
    """(class, visibility, state) of a policy."""
    yes, no = "applicable", "not_applicable"
    open_to = ("public", "restricted", "private", "unknown")
    if policy in ("correctness", "optimization"):
        found = [(k, v, yes) for k in DECLARED for v in open_to] + [(k, "not_applicable", no) for k in DECLARED]
        return found + [(k, v, no) for k in CONTAINERS for v in (*open_to, "not_applicable")]
    if policy == "architecture":
        return [(k, v, yes if k in ("workspace", "package", "module") else no) for k in ALL_CLASSES for v in VISIBILITIES]
    if policy == "documentation":
        reviewed = tuple(k for k in CLASSES if k != "test")
        found = [(k, v, yes if v == "public" else no) for k in reviewed for v in ("public", "restricted", "private", "not_applicable")]
        return found + [(k, "unknown", yes) for k in ("workspace", "package", "file")] + [("test", v, no) for v in (*open_to, "not_applicable")]
    if policy == "internal_documentation":
        declared = ("module", "type", "callable", "constant")
        return [(k, v, yes if k in declared and v in ("restricted", "private") else no) for k in ALL_CLASSES for v in VISIBILITIES if not (k in declared and v in ("unknown", "inherited"))]
    if policy == "conformance":
        reviewed = ("workspace", "package", "module", "type", "callable", "file")
        found = [(k, v, yes) for k in reviewed for v in VISIBILITIES if v != "not_applicable"]
        return found + [("test", v, yes) for v in VISIBILITIES] + [(k, v, no) for k in ("constant", "other") for v in VISIBILITIES]
    if policy == "conformance_containers":
        return [(k, v, yes) for k in ("workspace", "package", "module") for v in VISIBILITIES if v != "not_applicable"]
    raise ValueError(f"no rule table for {policy}")


#: Policies with a rule table, and the state where none of its rules fits.
UNMATCHED = {
    "documentation": "pending", "internal_documentation": "pending", "correctness": "pending", "optimization": "pending",
    "architecture": "pending", "conformance": "not_applicable", "conformance_containers": "not_applicable",
}


def rule_table(spark: SparkSession, policy: str) -> DataFrame:
    """class, visibility, state."""
    return checked_rules(spark.createDataFrame(_rules(policy), "class string, visibility string, state string"))


def checked_rules(rules: DataFrame) -> DataFrame:
    """rules, unless one is pending or stands twice: then an error. A rule table is small."""
    pending, twice = rules.filter("state = 'pending'"), rules.groupBy("class", "visibility").count().filter("count > 1")
    if not pending.isEmpty() or not twice.isEmpty():
        raise ValueError("applicability rules must be terminal, one for a class and visibility")
    return rules


def applicable(targets: DataFrame, rules: DataFrame, unmatched: str = "pending") -> DataFrame:
    """id, state for targets (id, class, visibility, inventory): pending unless represented, then the rule's state, else `unmatched`."""
    j = targets.join(F.broadcast(rules), ["class", "visibility"], "left")  # rules are bounded by classes x visibilities
    return j.select("id", F.when(F.col("inventory") != "represented", "pending").otherwise(F.coalesce("state", F.lit(unmatched))).alias("state"))


def maintainable(targets: DataFrame) -> DataFrame:
    """id, state, reason for targets (id, kind, language)."""
    k = maintainability_class("kind", "language")
    reason = (
        F.when(k == "callable", "code that can be called: size and branching are reviewed").when(k == "type", "a declared type: how its parts hold together is reviewed")
        .when(k == "module", "a declared module: its seams and imports are reviewed").otherwise("of no class that is reviewed")
    )
    return targets.select("id", F.when(k == "unknown", "not_applicable").otherwise("applicable").alias("state"), reason.alias("reason"))


def testable(targets: DataFrame) -> DataFrame:
    """id, state, level for targets (id, class of testing_class or project, split_from): members only when split from an oversized module."""
    k = F.col("class")
    yes = k.isin("module", "package", "project") | ((k == "member") & F.col("split_from").isNotNull())
    level = F.when(k.isin("module", "member"), "unit").when(k == "package", "library").when(k == "project", "project")
    return targets.select("id", F.when(yes, "applicable").otherwise("not_applicable").alias("state"), level.alias("level"))


def plan(targets: DataFrame, states: DataFrame, policy: str, version: str, snapshot: str, configuration: str, evidence: DataFrame | None = None) -> DataFrame:
    """One unit for every applicable target: unit (id), id, class, visibility, n_evidence. evidence: target, evidence."""
    from lodestar.functions.ids import derived_id

    units = targets.join(states.filter("state = 'applicable'").select("id"), "id", "left_semi")
    n = F.lit(0).cast("long")
    if evidence is not None:
        known = evidence.distinct().groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n"))
        units, n = units.join(known, "id", "left"), F.coalesce("n", F.lit(0))
    unit = derived_id("work-item", F.lit(f"{policy}-review"), F.lit(snapshot), F.lit(configuration), "id", F.lit(policy), F.lit(version))
    return units.select(unit.alias("unit"), "id", "class", "visibility", n.alias("n_evidence"))


def one_workspace(targets: DataFrame, name: str = "workspace") -> DataFrame:
    """targets (id, kind, name, parent) with exactly one workspace: one is made if none is there, and what has no parent is put under it. More than one is an error."""
    spaces = targets.filter("kind = 'workspace'").select("id").limit(2).collect()
    if len(spaces) > 1:
        raise ValueError("more than one workspace target")
    root = spaces[0]["id"] if spaces else "workspace:synthesized"
    if not spaces:
        shape = {f.name: f.dataType for f in targets.schema}
        made = {"id": F.lit(root), "kind": F.lit("workspace"), "name": F.lit(name)}
        targets = targets.unionByName(targets.sparkSession.range(1).select(*[made.get(k, F.lit(None)).cast(t).alias(k) for k, t in shape.items()]))
    return targets.withColumn("parent", F.when((F.col("id") != root) & F.col("parent").isNull(), F.lit(root)).otherwise(F.col("parent")))


def architecture_plan(targets: DataFrame, relations: DataFrame, states: DataFrame) -> DataFrame:
    """id, class, members, inside, boundary, waits_for of every applicable container.

    relations: source, target, kind, each once. members: targets at or below it; inside and boundary: relations with both ends or one end among them; waits_for: the
    modules of a package, the packages of a workspace (its modules if it has none).
    """
    from lodestar.operators.graph import closure

    units = targets.join(states.filter("state = 'applicable'").select("id"), "id", "left_semi")
    down = closure(targets.filter("parent is not null").select(F.col("parent").alias("src"), F.col("id").alias("dst")), units.select(F.col("id").alias("root"))).select("root", "node")
    size = down.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    ends = relations.select("source", "target", "kind", F.explode(F.array("source", "target")).alias("node"))
    touched = ends.join(down, "node").groupBy("root", "source", "target", "kind").agg(F.count(F.lit(1)).alias("ends")).groupBy("root").agg(F.count_if(F.col("ends") == 2).alias("inside"), F.count_if(F.col("ends") == 1).alias("boundary"))
    kinds = targets.select(F.col("id").alias("node"), F.col("class").alias("k"))
    below = down.filter("root != node").join(kinds, "node").groupBy("root").agg(F.count_if(F.col("k") == "module").alias("modules"), F.count_if(F.col("k") == "package").alias("packages"))
    j = units.select("id", "class").join(size.withColumnRenamed("root", "id"), "id", "left").join(touched.withColumnRenamed("root", "id"), "id", "left").join(below.withColumnRenamed("root", "id"), "id", "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    waits = F.when(F.col("class") == "package", F.coalesce("modules", F.lit(0))).when(F.col("class") == "workspace", F.when(F.coalesce("packages", F.lit(0)) > 0, F.col("packages")).otherwise(F.coalesce("modules", F.lit(0)))).otherwise(F.lit(0))
    return j.select("id", "class", zero("members"), zero("inside"), zero("boundary"), waits.alias("waits_for"))

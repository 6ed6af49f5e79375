"""Planning: applicability rules, admission, budgeted packing, testing scope, span containment, name resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.tables import cut, cut_counted
from lodestar.operators.spans import resolve_places


def applicability(targets: DataFrame, rules: DataFrame, visibility: str = "visibility") -> DataFrame:
    """id, decision: the rule for (kind, visibility); pending without one, or if the target is not represented."""
    r = rules.select(F.col("kind").alias("rk"), F.col("visibility").alias("rv"), F.col("decision"))
    joined = targets.join(F.broadcast(r), (F.col("kind") == F.col("rk")) & (F.col(visibility) == F.col("rv")), "left")  # rules are a fixed table
    return joined.select("id", F.when(F.col("inventory") != "represented", "pending").otherwise(F.coalesce("decision", F.lit("pending"))).alias("decision"))


def inherited_visibility(targets: DataFrame) -> DataFrame:
    """id, effective: the visibility of the nearest ancestor that does not inherit; unknown where there is none, or the chain is a circle.

    Every round doubles how far a target looks up, so rounds grow with the logarithm of the depth; targets that no
    round settles any more lie on or below a circle.
    """
    now = targets.select("id", F.when(F.col("visibility") != "inherited", F.col("visibility")).alias("effective"), F.col("parent").alias("up"))
    now = cut(now.withColumn("effective", F.when(F.col("effective").isNull() & F.col("up").isNull(), "unknown").otherwise(F.col("effective"))))
    open_before = now.filter("effective is null").count()
    while open_before:
        above = now.select(F.col("id").alias("pid"), F.col("effective").alias("pe"), F.col("up").alias("pp"))
        waiting = now.filter("effective is null").join(above, F.col("up") == F.col("pid"), "left")
        waiting = waiting.select("id", F.when(F.col("pid").isNull(), "unknown").otherwise(F.col("pe")).alias("effective"), F.col("pp").alias("up"))
        now = cut(now.filter("effective is not null").unionByName(waiting))
        left = now.filter("effective is null").count()
        if left == open_before:
            break
        open_before = left
    return now.select("id", F.coalesce("effective", F.lit("unknown")).alias("effective"))


def admission(targets: DataFrame, direct: DataFrame, transitive: DataFrame, mode: str, chosen: DataFrame | None = None) -> DataFrame:
    """id, decision, reason, admitted. full admits all, ci_lite what changed or is impacted, targeted the chosen targets alone. All tables: id."""
    marks = {"di": direct, "ti": transitive, "ci": chosen if chosen is not None else direct.limit(0)}
    j = targets
    for mark, ids in marks.items():
        j = j.join(ids.select(F.col("id").alias(mark)).distinct(), F.col("id") == F.col(mark), "left")
    touched = F.when(F.col("di").isNotNull(), "admitted_directly_changed").when(F.col("ti").isNotNull(), "admitted_transitively_impacted")
    decision = {
        "full": F.coalesce(touched, F.lit("admitted_full")), "ci_lite": F.coalesce(touched, F.lit("filtered_unaffected_ci_lite")),
        "targeted": F.when(F.col("ci").isNotNull(), "admitted_targeted").otherwise("filtered_not_in_targeted_set"),
    }[mode]
    reason = F.when(decision == "admitted_directly_changed", "direct").when(decision == "admitted_transitively_impacted", "transitive").otherwise("none")
    return j.select("id", decision.alias("decision"), reason.alias("reason"), decision.startswith("admitted").alias("admitted"))


def admission_stats(decided: DataFrame) -> DataFrame:
    """One row: evaluated, admitted, filtered, direct, transitive."""
    r = F.col("reason")
    return decided.agg(F.count(F.lit(1)).alias("evaluated"), F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("filtered"), F.count_if(r == "direct").alias("direct"), F.count_if(r == "transitive").alias("transitive"))


def admitted_units(units: DataFrame, decided: DataFrame) -> DataFrame:
    """The units (with target) of any pipeline's plan whose target is admitted."""
    return units.join(decided.filter("admitted").select(F.col("id").alias("target")), "target", "left_semi")


#: How many tokens a byte is taken for.
BYTES_A_TOKEN = 4
#: Candidates of a group that a round of packing walks over.
HEAD = 256


def greedy_pack(candidates: DataFrame, group: str, max_bytes: int, max_items: int, max_tokens: int | None = None, max_depth: int | None = None) -> DataFrame:
    """group, position, id: per group in order of (required first, priority falling, kind, id) each candidate that still fits is taken; one that does not is skipped and the walk goes on.

    candidates: group, id, required, priority, bytes and, if limits ask for them, kind, tokens, depth. What does not fit
    now never will, as room only shrinks: so a round walks over the next HEAD candidates of each group (that many leave a
    task, however many it holds), and the next round goes on behind them with what still fits. No list is longer than
    HEAD, whatever the group's size, and groups of no more than that need one round.
    """
    has = lambda name, other: F.col(name) if name in candidates.columns else other
    order = F.struct((~F.col("required")).alias("r"), (-F.col("priority")).alias("p"), has("kind", F.lit("")).alias("k"), F.col("id").alias("id"))
    left = candidates.select(F.col(group).alias("g"), order.alias("o"), F.col("bytes").cast("long").alias("bytes"), has("tokens", F.lit(0)).cast("long").alias("tokens"), has("depth", F.lit(0)).alias("depth"))
    left = left.filter(F.col("depth") <= max_depth if max_depth is not None else F.lit(True)).drop("depth")
    room = max_tokens if max_tokens is not None else (1 << 62)
    id_type = dict(candidates.dtypes)["id"]
    left = left.filter((F.col("bytes") <= max_bytes) & (F.col("tokens") <= room) & F.lit(max_items > 0))
    zero = F.lit(0).cast("long")
    state = None
    empty = F.expr(f"cast(array() as array<struct<position:int,id:{id_type}>>)")

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["used"] + x["bytes"] <= max_bytes) & (acc["spent"] + x["tokens"] <= room) & (acc["n"] < max_items)
        took = F.array_append(acc["taken"], F.struct(acc["n"].cast("int").alias("position"), x["o"]["id"].alias("id")))
        return F.struct(
            F.when(fits, acc["used"] + x["bytes"]).otherwise(acc["used"]).alias("used"), F.when(fits, acc["spent"] + x["tokens"]).otherwise(acc["spent"]).alias("spent"),
            F.when(fits, acc["n"] + 1).otherwise(acc["n"]).alias("n"), F.when(fits, took).otherwise(acc["taken"]).alias("taken"),
        )

    taken = None
    while True:
        head = left.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("o"))).filter(F.col("rn") <= HEAD)
        head = head.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("o", "bytes", "tokens"))).alias("next"))
        head = head.select("g", "next", zero.alias("used"), zero.alias("spent"), zero.alias("n")) if state is None else head.join(state.drop("last"), "g")
        walked = F.aggregate("next", F.struct("used", "spent", "n", empty.alias("taken")), step)
        more = (F.size("next") == HEAD) & (F.col("w.n") < max_items)
        moved, going = cut_counted(head.select("g", "next", walked.alias("w")).select("g", "w", F.element_at("next", -1)["o"].alias("last"), more.alias("more")), "more")
        got = moved.select("g", F.explode("w.taken").alias("t")).select("g", "t.position", "t.id")
        taken = got if taken is None else taken.unionByName(got)
        if not going:
            break
        state = moved.filter("more").select("g", "w.used", "w.spent", "w.n", "last")
        left = left.join(state, "g").filter((F.col("bytes") <= max_bytes - F.col("used")) & (F.col("tokens") <= room - F.col("spent")) & (F.col("o") > F.col("last")))
        left = cut(left.select("g", "o", "bytes", "tokens"))
    return taken.select(F.col("g").alias(group), "position", "id")


def evidence_package(candidates: DataFrame, group: str, allowed: list[str], max_bytes: int, max_items: int, max_tokens: int, max_depth: int) -> DataFrame:
    """group, id, disposition of every candidate: included, summarized, partial, omitted_policy, omitted_budget, unavailable.

    candidates: group, id, kind, required, priority, bytes, tokens, depth, availability (available, summarized, partial, unavailable).
    """
    there = F.col("availability") != "unavailable"
    permitted = candidates.filter(there & F.col("kind").isin(*allowed))
    packed = greedy_pack(permitted, group, max_bytes, max_items, max_tokens, max_depth).select(group, "id", F.lit(True).alias("in"))
    how = F.when(F.col("availability") == "available", "included").otherwise(F.col("availability"))
    state = F.when(~there, "unavailable").when(~F.col("kind").isin(*allowed), "omitted_policy").when(F.col("in"), how).otherwise("omitted_budget")
    return candidates.join(packed, [group, "id"], "left").select(group, "id", "kind", state.alias("disposition"))


def context_frame(package: DataFrame, stored: DataFrame, group: str) -> DataFrame:
    """group, id, position, detail: what a package gives to a review, in order of id; summaries lose their detail. stored: id, detail."""
    shown = package.filter("disposition in ('included', 'summarized', 'partial')").join(stored, "id", "left")
    detail = F.when(F.col("disposition") == "summarized", F.lit(None).cast("string")).otherwise(F.col("detail"))
    return shown.select(group, "id", (F.row_number().over(Window.partitionBy(group).orderBy("id")) - 1).alias("position"), detail.alias("detail"))


def evidence_catalog(records: DataFrame) -> DataFrame:
    """id, hash, bytes, tokens: one row for each evidence record; an id with two contents is an error, equal repeats collapse. records: id, detail."""
    from lodestar.functions.ids import content_hash

    rows = records.select("id", content_hash("detail").alias("hash"), F.octet_length("detail").cast("long").alias("bytes")).distinct()
    found = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("hash"), F.min("bytes").alias("bytes"))
    tokens = F.ceil(F.col("bytes") / BYTES_A_TOKEN).cast("long")
    return found.select("id", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two contents for evidence "), F.col("id").cast("string")))).otherwise(F.col("hash")).alias("hash"), "bytes", tokens.alias("tokens"))


#: Why a request for more evidence is denied, in the order of the tests.
DENIALS = (
    "invalid_request", "wrong_package", "out_of_sequence", "request_limit_exhausted", "target_outside_scope", "evidence_kind_outside_scope",
    "byte_budget_exhausted", "token_budget_exhausted", "item_budget_exhausted", "relation_depth_exhausted",
)


def expansion_denial() -> Column:
    """The first denial of a row, or null.

    Columns: rationale, targets, kinds, bytes, tokens, items, depth of the request; base, active (package ids); sequence,
    approved, max_requests; allowed_targets, allowed_kinds; used_* and max_* of bytes, tokens, items; max_depth.
    """
    c = F.col
    sizes = (c("bytes") == 0) | (c("tokens") == 0) | (c("items") == 0)
    tests = [
        (F.trim("rationale") == "") | (F.size("targets") == 0) | (F.size("kinds") == 0) | sizes, c("base") != c("active"), c("sequence") != c("approved") + 1, c("approved") >= c("max_requests"),
        F.size(F.array_except("targets", "allowed_targets")) > 0, F.size(F.array_except("kinds", "allowed_kinds")) > 0,
        *[c(x) > F.greatest(c(f"max_{x}") - c(f"used_{x}"), F.lit(0)) for x in ("bytes", "tokens", "items")], c("depth") > c("max_depth"),
    ]
    out = F.lit(None).cast("string")
    for name, test in reversed(list(zip(DENIALS, tests))):
        out = F.when(test, name).otherwise(out)
    return out


def expansion_usage(requests: DataFrame) -> DataFrame:
    """requests with denial and, where there is none, the usage that follows it: next_approved, next_bytes, next_tokens, next_items."""
    r = requests.withColumn("denial", expansion_denial())
    after = lambda old, more: F.when(F.col("denial").isNull(), F.col(old) + more)
    return r.withColumn("next_approved", after("approved", F.lit(1))).withColumns({f"next_{x}": after(f"used_{x}", F.col(x)) for x in ("bytes", "tokens", "items")})


def provider_denial() -> Column:
    """Why a provider may not be used, or null. Columns: max_requests, max_input, max_output, max_evidence, max_concurrency, capacity, supported, classification, online, authorized."""
    c = F.col
    bounded = (c("max_requests") == 0) | (c("max_input") == 0) | (c("max_output") == 0) | (c("max_evidence") == 0)
    return (
        F.when(bounded, "invalid_policy").when((c("max_concurrency") == 0) | (c("max_concurrency") > c("capacity")), "invalid_policy")
        .when(~F.array_contains("supported", c("classification")), "classification_denied").when(c("online") & ~c("authorized"), "online_transmission_denied")
    )


def assign_models(work: DataFrame, models: DataFrame, partition: list[str]) -> DataFrame:
    """work with model: a pinned run has one model for all its work, others one for each partition; the same ones whenever it is asked.

    The model of least hash with the run (and the partition) is taken. models: model, a small table; work: run, pinned and the partition's columns.
    """
    keys = work.select("run", "pinned", F.when(F.col("pinned"), F.col("run").cast("string")).otherwise(F.concat_ws("/", F.col("run").cast("string"), *partition)).alias("_part")).distinct()
    names = F.lit([r["model"] for r in models.distinct().orderBy("model").collect()])  # the configured models, a handful
    best = F.array_sort(F.transform(names, lambda m: F.struct(F.sha2(F.concat(F.col("_part"), F.lit("/"), m), 256).alias("h"), m.alias("m"))))[0]["m"]
    chosen = keys.select("_part", best.alias("model")).distinct()
    part = F.when(F.col("pinned"), F.col("run").cast("string")).otherwise(F.concat_ws("/", F.col("run").cast("string"), *partition))
    return work.withColumn("_part", part).join(chosen, "_part").drop("_part")


def smallest_span(points: DataFrame, spans: DataFrame) -> DataFrame:
    """point, id: the smallest span of the same path that holds [start, end); whole files only if nothing else does; null if none.

    points: point, path, start, end; spans: id, path, s, e, is_file.
    """
    return resolve_places(points, spans).select("point", "id")


def unique_names(names: DataFrame, uses: DataFrame) -> DataFrame:
    """user, id: each use of a name that exactly one target has, other than by itself. names: id, name; uses: user, name."""
    one = names.groupBy("name").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id")).filter("n = 1")
    return uses.join(one, "name").filter("user != id").select("user", "id").distinct()


def test_links(calls: DataFrame, tests: DataFrame, members: DataFrame) -> DataFrame:
    """test, member, link: direct calls, and calls through one helper that is neither; an indirect link is dropped if the test calls the member directly. calls: src, dst."""
    t, m = tests.select(F.col("id").alias("test")), members.select(F.col("id").alias("member"))
    direct = calls.join(t, F.col("src") == F.col("test")).join(m, F.col("dst") == F.col("member")).select("test", "member").distinct()
    helper = calls.join(t, F.col("src") == F.col("test")).select("test", F.col("dst").alias("helper"))
    helper = helper.join(t.withColumnRenamed("test", "helper"), "helper", "left_anti").join(m.withColumnRenamed("member", "helper"), "helper", "left_anti")
    two = helper.join(calls, F.col("helper") == F.col("src")).join(m, F.col("dst") == F.col("member")).select("test", "member").distinct().join(direct, ["test", "member"], "left_anti")
    return direct.withColumn("link", F.lit("direct")).unionByName(two.withColumn("link", F.lit("via_helper")))


def split_oversized(members: DataFrame, budget: int, share: int = 45) -> DataFrame:
    """module, unit: a module whose members' bytes exceed share percent of the budget is dealt to its public or signalled members, else stays one unit. members: module, id, bytes, is_public, signals."""
    size = members.groupBy("module").agg((F.sum("bytes") * 100 > budget * share).alias("large"))
    j = members.join(size, "module")
    parts = j.filter("large and (is_public or signals > 0)").select("module", F.col("id").alias("unit"))
    return parts.unionByName(j.filter("not large").select("module", F.col("module").alias("unit")).distinct())


def latest_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")

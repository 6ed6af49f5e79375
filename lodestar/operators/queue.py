"""The work queue as tables: state folded from the event log, leases, outcomes, cache, prunes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ("pending", "leased", "succeeded", "failed", "cancelled")


def status(work: DataFrame, now: int) -> DataFrame:
    """One row: count of each state, and stalled (leased with the lease over at now, equality included)."""
    return work.agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES], F.count_if((F.col("state") == "leased") & (F.col("lease_until") <= now)).alias("stalled"))


def coverage(work: DataFrame, keys: list[str]) -> DataFrame:
    return work.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in STATES])


def coverage_cube(work: DataFrame, keys: list[str]) -> DataFrame:
    """coverage() over every subset of the keys; the level says which are summed over."""
    return work.cube(*keys).agg(F.grouping_id(*keys).cast("long").alias("level"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "succeeded").alias("succeeded"))


def telemetry(events: DataFrame) -> DataFrame:
    """One row: events, retries, first and last success, the last success's work item, throughput per 1000 seconds."""
    ok = F.col("kind") == "succeeded"
    e = events.agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("kind") == "retry_scheduled").alias("retries"), F.count_if(ok).alias("succeeded"), F.min(F.when(ok, F.col("at_millis"))).alias("first_success"),
        F.max(F.when(ok, F.col("at_millis"))).alias("last_success"), F.max_by("work_id", F.when(ok, F.struct("at_millis", "sequence"))).alias("last_work"),
    )
    return e.withColumn("per_1000_s", F.when(F.col("last_success") > F.col("first_success"), F.expr("(succeeded - 1) * 1000000 div (last_success - first_success)")))


def fold(events: DataFrame) -> DataFrame:
    """work_id, state, attempts, retries, last_sequence: what the log says of each item; heartbeats don't change the state."""
    state = F.when(F.col("kind") == "leased", "leased").when(F.col("kind").isin("admitted", "retry_scheduled", "released"), "pending").when(F.col("kind").isin("succeeded", "failed", "cancelled"), F.col("kind"))
    e = events.withColumn("s", state)
    return e.groupBy("work_id").agg(F.max_by("s", F.when(F.col("s").isNotNull(), F.col("sequence"))).alias("state"), F.count_if(F.col("kind") == "leased").alias("attempts"), F.count_if(F.col("kind") == "retry_scheduled").alias("retries"), F.max("sequence").alias("last_sequence"))


def available(work: DataFrame, now: int) -> DataFrame:
    """Items that may be leased: pending, or leased with the lease over (equality included)."""
    return work.filter((F.col("state") == "pending") | ((F.col("state") == "leased") & (F.col("lease_until") <= now)))


def lease_next(work: DataFrame, now: int, lease: int, n: int, keys: list[str]) -> DataFrame:
    """The first n available items by id for each partition of keys, as leased with one more attempt."""
    w = Window.partitionBy(*keys).orderBy("work_id")
    return available(work, now).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).select("work_id", *keys, (F.col("attempts") + 1).alias("attempts"), F.lit(now + lease).alias("lease_until"))


def heartbeat(work: DataFrame, now: int, lease: int) -> DataFrame:
    """Leased items with a lease that is not over before now (equality allowed), extended."""
    return work.filter((F.col("state") == "leased") & (F.col("lease_until") >= now)).select("work_id", F.lit(now + lease).alias("lease_until"))


def fail_attempt(work: DataFrame, max_attempts: int) -> DataFrame:
    """Leased items after a failed attempt: pending again below the limit, else failed."""
    again = F.col("attempts") < max_attempts
    return work.filter("state = 'leased'").select("work_id", F.when(again, "pending").otherwise("failed").alias("state"), F.when(again, "retry_scheduled").otherwise("failed").alias("event"))


def release(work: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """work_id, state, attempts, event of leased items (of `chosen` work_ids, else all) that are given back: pending, attempts kept, logged as a retry."""
    held = work.filter("state = 'leased'")
    held = held if chosen is None else held.join(chosen.select("work_id").distinct(), "work_id", "left_semi")
    return held.select("work_id", F.lit("pending").alias("state"), "attempts", F.lit("retry_scheduled").alias("event"))


def heartbeat_millis(lease: Column | str) -> Column:
    """A third of the lease, 25 ms at least and 10 s at most."""
    return F.least(F.greatest(F.floor((F.col(lease) if isinstance(lease, str) else lease) / 3), F.lit(25)), F.lit(10_000)).cast("long")


def worker_step(leased: DataFrame, admissions: DataFrame, checkpoints: DataFrame, outcomes: DataFrame) -> DataFrame:
    """work_id, action, generation of each leased item: succeeded (an outcome is there), orphaned (no admission), foreign (another owner's), resume (a checkpoint of this generation is there), run.

    leased: work_id, owner, retries; admissions: work_id, owner; checkpoints: work_id, generation; outcomes: work_id.
    """
    a = admissions.select("work_id", F.col("owner").alias("admitted"))
    k = checkpoints.select("work_id", F.col("generation").alias("retries"), F.lit(True).alias("kept")).distinct()
    o = outcomes.select("work_id", F.lit(True).alias("done")).distinct()
    j = leased.join(o, "work_id", "left").join(a, "work_id", "left").join(k, ["work_id", "retries"], "left")
    action = F.when(F.col("done"), "succeeded").when(F.col("admitted").isNull(), "orphaned").when(F.col("admitted") != F.col("owner"), "foreign").when(F.col("kept"), "resume").otherwise("run")
    return j.select("work_id", action.alias("action"), F.col("retries").alias("generation"))


def append_events(log: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """new with its sequence: numbers that follow the log's last one without a gap, in the given order.

    Rows are dealt by ranges of the order; a range begins where the counts of those before it end.
    """
    from lodestar.operators.ordered import numbered

    return numbered(new, [F.col(c) for c in order], "sequence", log.agg(F.max("sequence")).first()[0] or 0)


def compare_and_swap(records: DataFrame, updates: DataFrame) -> DataFrame:
    """key, result, revision, data of each key with updates (key, expected, data, at): null expected creates.

    Of several updates of one key the earliest counts, the others conflict with it. result: inserted, existing (equal
    data), updated, conflict; revision and data are those that hold afterwards.
    """
    first = updates.groupBy("key").agg(F.min_by(F.struct("expected", "data"), "at").alias("u"), F.count(F.lit(1)).alias("n"))
    j = first.join(records.select("key", F.col("revision").alias("had"), F.col("data").alias("old")), "key", "left")
    want, data = F.col("u.expected"), F.col("u.data")
    result = (
        F.when(F.col("had").isNull() & want.isNull(), "inserted").when(F.col("had").isNotNull() & want.isNull() & (F.col("old") == data), "existing").when(F.col("had") == want, "updated").otherwise("conflict")
    )
    took = result.isin("inserted", "updated")
    revision = F.when(result == "inserted", 0).when(result == "updated", F.col("had") + 1).otherwise(F.col("had"))
    return j.select("key", result.alias("result"), revision.cast("long").alias("revision"), F.when(took, data).otherwise(F.col("old")).alias("data"), (F.col("n") - 1).alias("later_conflicts"))


def store_artifacts(existing: DataFrame, new: DataFrame, kinds: list[str]) -> DataFrame:
    """reference (content hash), kind, action of each new payload: insert, same, collision (another kind under the hash), invalid_kind. new: kind, payload."""
    from lodestar.functions.ids import content_hash

    n = new.select(content_hash("payload").alias("reference"), "kind").distinct()
    j = n.join(existing.select("reference", F.col("kind").alias("had")).distinct(), "reference", "left")
    action = F.when(~F.col("kind").isin(*kinds), "invalid_kind").when(F.col("had").isNull(), "insert").when(F.col("had") == F.col("kind"), "same").otherwise("collision")
    return j.select("reference", "kind", action.alias("action"))


def terminal_runs(runs: DataFrame, adjudications: DataFrame, cutoff: int) -> DataFrame:
    """run, keep_row of runs to prune: finalized or cancelled and not updated after the cutoff; the row itself stays where the run is adjudicated."""
    old = runs.filter(F.col("state").isin("finalized", "cancelled") & (F.col("updated") <= cutoff))
    judged = adjudications.select("run", F.lit(True).alias("judged")).distinct()
    return old.join(judged, "run", "left").select("run", F.coalesce("judged", F.lit(False)).alias("keep_row"))


def cache_prune(cache: DataFrame, how: str, now: int = 0, targets: DataFrame | None = None, predicate: Column | None = None) -> DataFrame:
    """Entries that a prune takes away. how: expired, targets (target), target_policy (target, policy), predicate (any column), clear."""
    if how == "expired":
        return cache.filter(F.col("expires_at") <= now)
    if how in ("targets", "target_policy"):
        keys = ["target"] if how == "targets" else ["target", "policy"]
        return cache.join(targets.select(*keys).distinct(), keys, "left_semi")
    return cache.filter(predicate) if how == "predicate" else cache


def clean(work: DataFrame, runs: DataFrame, artifacts: DataFrame, outcomes: DataFrame, cache: DataFrame, adjudications: DataFrame, now: int, cutoff: int) -> dict[str, DataFrame]:
    """What a clean-up takes away, by table: runs, work, outcomes, cache, artifacts. Nothing is deleted here, so it is the dry run too.

    Artifacts go that neither the outcomes nor the cache entries that stay refer to.
    """
    gone_runs = terminal_runs(runs, adjudications, cutoff)
    gone_work = work.join(gone_runs.select("run"), "run", "left_semi")
    gone_outcomes = outcomes.join(gone_work.select("work_id").distinct(), "work_id", "left_semi")
    gone_cache = cache_prune(cache, "expired", now)
    kept_outcomes = outcomes.join(gone_work.select("work_id").distinct(), "work_id", "left_anti")
    kept_cache = cache.join(gone_cache.select("entry").distinct(), "entry", "left_anti")
    return {
        "runs": gone_runs.filter(~F.col("keep_row")).select("run"), "work": gone_work, "outcomes": gone_outcomes, "cache": gone_cache,
        "artifacts": unreferenced(artifacts, kept_outcomes, kept_cache),
    }


def progress(work: DataFrame, events: DataFrame) -> DataFrame:
    """One row: succeeded, pending, per_1000_s and eta_seconds (null without two successes at different times)."""
    t = telemetry(events).select("first_success", "last_success")
    w = work.agg(F.count_if(F.col("state") == "succeeded").alias("succeeded"), F.count_if(F.col("state") == "pending").alias("pending"))
    j = w.crossJoin(t)  # one row by one row
    rate = (F.col("succeeded") - 1) / ((F.col("last_success") - F.col("first_success")) / 1000.0)
    known = (F.col("last_success") > F.col("first_success")) & (F.col("succeeded") > 1)
    return j.select("succeeded", "pending", F.when(known, F.floor(rate * 1000)).alias("per_1000_s"), F.when(known & (F.col("pending") > 0), F.round(F.col("pending") / rate)).cast("long").alias("eta_seconds"))


def stalled(work: DataFrame, now: int) -> DataFrame:
    """work_id, lease_until of leased items whose lease is over, in order of id."""
    return work.filter((F.col("state") == "leased") & (F.col("lease_until") <= now)).select("work_id", "lease_until").orderBy("work_id")


#: The legal edges of the four lifecycles.
LIFECYCLES = {
    "execution": [
        ("pending", "admitted"), ("failed", "admitted"), ("admitted", "leased"), ("admitted", "cancelled"), ("leased", "admitted"), ("leased", "succeeded"), ("leased", "failed"),
        ("leased", "cancelled"),
    ],
    "assessment": [("pending", "passed"), ("pending", "candidate_finding"), ("pending", "unable_to_verify")],
    "verification": [("not_requested", "pending"), ("pending", "corroborated"), ("pending", "disputed"), ("pending", "unable_to_verify")],
    "adjudication": [("unreviewed", "accepted"), ("unreviewed", "rejected"), ("unreviewed", "deferred")],
}


def legal_moves(moves: DataFrame) -> DataFrame:
    """id, legal of moves (id, lifecycle, before, after) by LIFECYCLES."""
    edges = moves.sparkSession.createDataFrame([(n, a, b) for n, found in LIFECYCLES.items() for a, b in found], "lifecycle string, before string, after string")
    return moves.join(F.broadcast(edges.withColumn("ok", F.lit(True))), ["lifecycle", "before", "after"], "left").select("id", F.coalesce("ok", F.lit(False)).alias("legal"))  # a fixed table


def resume(work: DataFrame, now: int) -> DataFrame:
    return work.filter((F.col("state") == "leased") & (F.col("lease_until") <= now)).select("work_id", F.lit("pending").alias("state"), "attempts")


def retry_failed(work: DataFrame) -> DataFrame:
    return work.filter("state = 'failed'").select("work_id", F.lit("pending").alias("state"), F.lit(0).cast("long").alias("attempts"))


def cancel(work: DataFrame) -> DataFrame:
    return work.filter("state in ('pending', 'leased')").select("work_id", F.lit("cancelled").alias("state"))


def finalizable(work: DataFrame) -> DataFrame:
    """run, open_items, may_finalize: a run is finalized once nothing is pending or leased."""
    return work.groupBy("run").agg(F.count_if(F.col("state").isin("pending", "leased")).alias("open_items")).withColumn("may_finalize", F.col("open_items") == 0)


def admit(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """work_id, action: insert, same (idempotent) or conflict (same id, other payload)."""
    e = existing.select(F.col("work_id").alias("eid"), F.col("payload").alias("ep"))
    action = F.when(F.col("eid").isNull(), "insert").when(F.col("payload").eqNullSafe(F.col("ep")), "same").otherwise("conflict")
    return wanted.join(e, F.col("work_id") == F.col("eid"), "left").select("work_id", action.alias("action"))


def first_writer(outcomes: DataFrame) -> DataFrame:
    """The outcome of least sequence for each key."""
    return outcomes.groupBy("key").agg(F.min_by(F.struct("sequence", "payload"), "sequence").alias("o")).select("key", "o.*")


def cache_stats(cache: DataFrame, now: int) -> DataFrame:
    over = F.coalesce(F.col("expires_at") <= now, F.lit(False))
    return cache.agg(F.count(F.lit(1)).alias("entries"), F.count_if(~over).alias("active"), F.count_if(over).alias("expired"), F.sum("hits").alias("hits"), F.min("cached_at").alias("oldest"), F.max("cached_at").alias("newest"), F.sum("bytes").alias("bytes"))


def cache_lookup(work: DataFrame, cache: DataFrame, now: int) -> DataFrame:
    """work_id, entry: pending work with its live cache entry of equal target, policy and fingerprint (least entry), or null."""
    live = cache.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now)).groupBy("target", "policy", "fingerprint").agg(F.min("entry").alias("entry"))
    return work.filter("state = 'pending'").join(live, ["target", "policy", "fingerprint"], "left").select("work_id", "entry")


def unreferenced(artifacts: DataFrame, *references: DataFrame) -> DataFrame:
    """Artifacts that none of the reference tables name. references: reference."""
    used = references[0].select("reference")
    for r in references[1:]:
        used = used.unionByName(r.select("reference"))
    return artifacts.join(used.distinct(), "reference", "left_anti")


def transitions(events: DataFrame, legal: list[tuple[str, str]]) -> DataFrame:
    """work_id, sequence, before, kind of events that may not follow their predecessor."""
    w = Window.partitionBy("work_id").orderBy("sequence")
    e = events.withColumn("before", F.lag("kind").over(w)).filter("before is not null")
    ok = F.concat_ws(">", "before", "kind").isin(*[f"{a}>{b}" for a, b in legal])
    return e.filter(~ok).select("work_id", "sequence", "before", "kind")


def lease(work: DataFrame, log: DataFrame, now: int, millis: int, n: int, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(work as it is after, the new events): the first n available items of each partition are leased and each gets a `leased` event behind the log's last.

    work: work_id, state, attempts, lease_until and more; events: sequence, work_id, kind, at_millis, in the order of work_id.
    """
    taken = lease_next(work, now, millis, n, keys).select("work_id", F.col("attempts").alias("_attempts"), F.col("lease_until").alias("_until"))
    j = work.join(taken, "work_id", "left")
    got = F.col("_until").isNotNull()
    state = {"state": F.when(got, "leased").otherwise(F.col("state")), "attempts": F.coalesce("_attempts", "attempts"), "lease_until": F.coalesce("_until", "lease_until")}
    after = j.select(*[state[c].alias(c) if c in state else F.col(c) for c in work.columns])
    new = append_events(log, taken.select("work_id", F.lit("leased").alias("kind"), F.lit(now).cast("long").alias("at_millis")), ["work_id"])
    return after, new.select("sequence", "work_id", "kind", "at_millis")


def record_adjudications(history: DataFrame, requests: DataFrame) -> DataFrame:
    """run, finding, at, result (recorded, conflict), revision of every request: it is recorded as the next revision if the one it expects is the latest then.

    history: run, finding, revision; requests: run, finding, at, expected (null: none so far). A finding's requests of one batch are taken in the order
    of `at`, then `expected` (nulls first); people make them, so a row holds those of one finding.
    """
    latest = history.groupBy("run", "finding").agg(F.max("revision").alias("had"))
    each = requests.groupBy("run", "finding").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce(F.col("expected").cast("long"), F.lit(-1)).alias("expected")))).alias("asked"))
    j = each.join(latest, ["run", "finding"], "left").withColumn("had", F.coalesce(F.col("had").cast("long"), F.lit(-1).cast("long")))
    kind = dict(requests.dtypes)["at"]
    none = F.expr(f"cast(array() as array<struct<at:{kind},result:string,revision:bigint>>)")

    def step(acc, x):
        fits = x["expected"] == acc["now"]
        after = F.when(fits, F.greatest(acc["now"], F.lit(0)) + 1).otherwise(acc["now"])
        line = F.struct(x["at"].alias("at"), F.when(fits, "recorded").otherwise("conflict").alias("result"), F.when(fits, after).alias("revision"))
        return F.struct(after.alias("now"), F.array_append(acc["done"], line).alias("done"))

    done = F.aggregate("asked", F.struct(F.col("had").alias("now"), none.alias("done")), step)["done"]
    return j.select("run", "finding", F.explode(done).alias("d")).select("run", "finding", "d.*")


def cache_touch(cache: DataFrame, uses: DataFrame) -> DataFrame:
    """The cache after its entries were used: hits raised by the uses, used_at the latest of them. cache: entry, hits, used_at and more; uses: entry, at. Uses of entries that are gone count for nothing."""
    n = uses.groupBy("entry").agg(F.count(F.lit(1)).alias("_n"), F.max("at").alias("_at"))
    j = cache.join(n, "entry", "left")
    new = {"hits": F.col("hits") + F.coalesce("_n", F.lit(0)), "used_at": F.greatest("used_at", "_at")}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in cache.columns])


def cache_insert(cache: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The cache with new entries (the same columns) in place of those of equal keys; of several new ones the latest cached_at stays, then the greatest entry."""
    best = new.groupBy(*keys).agg(F.max_by(F.struct(*new.columns), F.struct("cached_at", "entry")).alias("_b")).select("_b.*")
    return cache.join(best.select(*keys), keys, "left_anti").unionByName(best.select(*cache.columns))

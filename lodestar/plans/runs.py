"""Queries over the queue: states, leases, outcomes, cache, adjudications, telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar import bridge as B
from lodestar.functions.ids import basis_points
from lodestar.operators import queue as Q
from lodestar.operators import report as R
from lodestar.registry import query

N = B.NOW
STATE_COUNTS = ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in Q.STATES)
KEYS = ["run", "adapter", "policy"]


@query(f"WITH {B.SQL_WORK} SELECT {STATE_COUNTS}, count(*) FILTER (state = 'leased' AND lease_until <= {N}) AS stalled FROM wk")
def queue_status(spark, sf):
    return Q.status(B.work(spark, sf), N)


@query(f"WITH {B.SQL_WORK} SELECT run, adapter, policy, count(*) AS total, {STATE_COUNTS} FROM wk GROUP BY ALL")
def coverage_partitions(spark, sf):
    return Q.coverage(B.work(spark, sf), KEYS)


@query(f"WITH {B.SQL_WORK} SELECT run, adapter, policy, grouping_id(run, adapter, policy)::BIGINT AS level, count(*) AS total, count(*) FILTER (state = 'succeeded') AS succeeded FROM wk GROUP BY CUBE (run, adapter, policy)")
def coverage_cube(spark, sf):
    return Q.coverage_cube(B.work(spark, sf), KEYS)


@query(f"""WITH {B.SQL_EVENTS}, s AS (SELECT count(*) AS events, count(*) FILTER (kind = 'retry_scheduled') AS retries, count(*) FILTER (kind = 'succeeded') AS succeeded, min(at_millis) FILTER (kind = 'succeeded') AS first_success, max(at_millis) FILTER (kind = 'succeeded') AS last_success FROM ev)
SELECT *, (SELECT work_id FROM ev WHERE kind = 'succeeded' ORDER BY at_millis DESC, sequence DESC LIMIT 1) AS last_work, CASE WHEN last_success > first_success THEN ((succeeded - 1) * 1000000 // (last_success - first_success))::BIGINT END AS per_1000_s FROM s""")
def queue_telemetry(spark, sf):
    return Q.telemetry(B.events(spark, sf))


FOLD = """fd AS (SELECT work_id, max_by(CASE WHEN kind = 'leased' THEN 'leased' WHEN kind IN ('admitted', 'retry_scheduled') THEN 'pending' ELSE kind END, sequence) FILTER (kind <> 'heartbeat') AS state,
 count(*) FILTER (kind = 'leased') AS attempts, count(*) FILTER (kind = 'retry_scheduled') AS retries, max(sequence) AS last_sequence FROM ev GROUP BY work_id)"""


@query(f"WITH {B.SQL_EVENTS}, {FOLD} SELECT * FROM fd")
def event_fold(spark, sf):
    return Q.fold(B.events(spark, sf))


@query(f"WITH {B.SQL_EVENTS} SELECT work_id, count(*) FILTER (kind = 'retry_scheduled') AS generation FROM ev GROUP BY work_id")
def retry_generation(spark, sf):
    return B.events(spark, sf).groupBy("work_id").agg(F.count_if(F.col("kind") == "retry_scheduled").alias("generation"))


AVAILABLE = f"(state = 'pending' OR (state = 'leased' AND lease_until <= {N}))"


@query(f"WITH {B.SQL_WORK}, r AS (SELECT *, row_number() OVER (PARTITION BY run, adapter, policy ORDER BY work_id) AS rn FROM wk WHERE {AVAILABLE}) SELECT work_id, run, adapter, policy, attempts + 1 AS attempts, {N + 60_000} AS lease_until FROM r WHERE rn <= 3")
def lease_next(spark, sf):
    return Q.lease_next(B.work(spark, sf), N, 60_000, 3, KEYS)


@query(f"WITH {B.SQL_WORK} SELECT work_id, {N + 1000} AS lease_until FROM wk WHERE state = 'leased' AND lease_until >= {N}")
def heartbeat(spark, sf):
    return Q.heartbeat(B.work(spark, sf), N, 1000)


@query(f"WITH {B.SQL_WORK} SELECT work_id, CASE WHEN attempts < 3 THEN 'pending' ELSE 'failed' END AS state, CASE WHEN attempts < 3 THEN 'retry_scheduled' ELSE 'failed' END AS event FROM wk WHERE state = 'leased'")
def fail_attempt(spark, sf):
    return Q.fail_attempt(B.work(spark, sf), 3)


@query(f"WITH {B.SQL_WORK} SELECT work_id, 'pending' AS state, attempts FROM wk WHERE state = 'leased' AND lease_until <= {N}")
def resume_run(spark, sf):
    return Q.resume(B.work(spark, sf), N)


@query(f"WITH {B.SQL_WORK} SELECT work_id, 'pending' AS state, 0::BIGINT AS attempts FROM wk WHERE state = 'failed'")
def retry_failed(spark, sf):
    return Q.retry_failed(B.work(spark, sf))


@query(f"WITH {B.SQL_WORK} SELECT work_id, 'cancelled' AS state FROM wk WHERE state IN ('pending', 'leased')")
def cancel_run(spark, sf):
    return Q.cancel(B.work(spark, sf))


@query(f"WITH {B.SQL_WORK} SELECT run, count(*) FILTER (state IN ('pending', 'leased')) AS open_items, count(*) FILTER (state IN ('pending', 'leased')) = 0 AS may_finalize FROM wk GROUP BY run")
def finalize_run(spark, sf):
    return Q.finalizable(B.work(spark, sf))


@query("SELECT o_orderkey AS work_id, CASE WHEN o_orderkey % 3 = 0 THEN 'insert' WHEN o_orderkey % 5 = 0 THEN 'conflict' ELSE 'same' END AS action FROM orders")
def admit_batch(spark, sf):
    o = B.t(spark, sf, "orders")
    had = o.filter("o_orderkey % 3 != 0").select(F.col("o_orderkey").alias("work_id"), F.when(F.col("o_orderkey") % 5 == 0, "other").otherwise(F.col("o_orderpriority")).alias("payload"))
    return Q.admit(had, o.select(F.col("o_orderkey").alias("work_id"), F.col("o_orderpriority").alias("payload")))


@query("SELECT user_id AS key, min(event_id) AS sequence, arg_min(event_type, event_id) AS payload FROM events GROUP BY user_id")
def first_outcome(spark, sf):
    return Q.first_writer(B.t(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("sequence"), F.col("event_type").alias("payload")))


@query(f"""WITH {B.SQL_EVENTS}, w AS (SELECT *, lag(kind) OVER (PARTITION BY work_id ORDER BY sequence) AS before FROM ev) SELECT work_id, sequence, before, kind FROM w WHERE before IS NOT NULL AND before || '>' || kind NOT IN ('admitted>leased', 'leased>heartbeat', 'leased>succeeded', 'leased>failed', 'leased>retry_scheduled', 'heartbeat>heartbeat', 'heartbeat>succeeded', 'retry_scheduled>leased')""")
def illegal_transitions(spark, sf):
    legal = [("admitted", "leased"), ("leased", "heartbeat"), ("leased", "succeeded"), ("leased", "failed"), ("leased", "retry_scheduled"), ("heartbeat", "heartbeat"), ("heartbeat", "succeeded"), ("retry_scheduled", "leased")]
    return Q.transitions(B.events(spark, sf), legal)


@query(f"WITH {B.SQL_CACHE} SELECT count(*) AS entries, count(*) FILTER (expires_at IS NULL OR expires_at > {N}) AS active, count(*) FILTER (expires_at <= {N}) AS expired, sum(hits)::BIGINT AS hits, min(cached_at) AS oldest, max(cached_at) AS newest, sum(bytes)::BIGINT AS bytes FROM ca")
def cache_stats(spark, sf):
    return Q.cache_stats(B.cache(spark, sf), N)


@query(f"""WITH {B.SQL_CACHE}, {B.SQL_WORK}, live AS (SELECT target, policy, fingerprint, min(entry) AS entry FROM ca WHERE expires_at IS NULL OR expires_at > {N} GROUP BY ALL)
SELECT work_id, entry FROM wk LEFT JOIN live ON wk.target = live.target AND wk.policy = live.policy AND work_id % 11 = fingerprint WHERE state = 'pending'""")
def cache_lookup(spark, sf):
    return Q.cache_lookup(B.work(spark, sf).withColumn("fingerprint", F.col("work_id") % 11), B.cache(spark, sf), N)


@query(f"""WITH {B.SQL_CACHE}, {B.SQL_WORK}, live AS (SELECT DISTINCT target, policy, fingerprint FROM ca WHERE expires_at IS NULL OR expires_at > {N})
SELECT CASE WHEN fingerprint IS NULL THEN 'released' ELSE 'completed' END AS result, count(*) AS items FROM wk LEFT JOIN live ON wk.target = live.target AND wk.policy = live.policy AND work_id % 11 = fingerprint WHERE state = 'pending' GROUP BY 1""")
def cache_short_circuit(spark, sf):
    found = Q.cache_lookup(B.work(spark, sf).withColumn("fingerprint", F.col("work_id") % 11), B.cache(spark, sf), N)
    return found.groupBy(F.when(F.col("entry").isNull(), "released").otherwise("completed").alias("result")).agg(F.count(F.lit(1)).alias("items"))


@query("SELECT count(*) AS artifacts, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AND doc_id NOT IN (SELECT conv_id FROM conversations WHERE conv_id IS NOT NULL)")
def unreferenced_artifacts(spark, sf):
    docs = B.t(spark, sf, "documents").select(F.col("doc_id").alias("reference"), F.octet_length("text").cast("long").alias("bytes"))
    labels, talks = B.t(spark, sf, "labels").select(F.col("doc_id").alias("reference")), B.t(spark, sf, "conversations").select(F.col("conv_id").alias("reference"))
    return Q.unreferenced(docs, labels, talks).agg(F.count(F.lit(1)).alias("artifacts"), F.sum("bytes").alias("bytes"))


@query(f"""WITH {B.SQL_WORK}, terminal AS (SELECT o_custkey AS cust FROM orders GROUP BY o_custkey HAVING max(epoch_ms(o_orderdate)) <= {N}) SELECT work_id FROM wk WHERE target NOT IN (SELECT cust FROM terminal)""")
def prune_terminal(spark, sf):
    o = B.t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("target")).agg(F.max(F.unix_millis(F.col("o_orderdate").cast("timestamp"))).alias("at")).filter(F.col("at") <= N)
    return B.work(spark, sf).join(o, "target", "left_anti").select("work_id")


@query("""SELECT user_id AS session, event_type AS provider, max_by(value, (ts, event_id)) AS value, max(event_id) FILTER (event_id = event_id) AS last_event FROM events GROUP BY ALL""")
def provider_snapshots(spark, sf):
    e = B.t(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("session"), F.col("event_type").alias("provider")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("event_id").alias("last_event"))


@query("""WITH s AS (SELECT user_id, event_type AS provider, count(*) AS requests, max(event_id) AS latest, max(event_id % 100) AS peak FROM events GROUP BY ALL)
SELECT provider, sum(requests)::BIGINT AS requests, max(peak) AS peak, arg_max(user_id, latest) AS health FROM s GROUP BY provider""")
def provider_telemetry_merge(spark, sf):
    s = B.t(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("provider")).agg(F.count(F.lit(1)).alias("requests"), F.max("event_id").alias("latest"), F.max(F.col("event_id") % 100).alias("peak"))
    return s.groupBy("provider").agg(F.sum("requests").alias("requests"), F.max("peak").alias("peak"), F.max_by("user_id", "latest").alias("health"))


LATEST = """la AS (SELECT run, finding, max(revision) AS revision, arg_max(state, revision) AS state, max_by(coalesce(expected_issue, -1), revision) AS ei FROM ad GROUP BY run, finding), lr AS (SELECT run, finding, revision, state, nullif(ei, -1) AS expected_issue FROM la)"""


@query(f"WITH {B.SQL_ADJUDICATIONS}, {LATEST} SELECT * FROM lr")
def latest_adjudication(spark, sf):
    return R.latest(B.adjudications(spark, sf))


@query(f"""WITH {B.SQL_ADJUDICATIONS}, {LATEST}, a AS (SELECT run, count(*) FILTER (state = 'accepted') AS accepted, count(*) FILTER (state = 'rejected') AS rejected, count(*) FILTER (state = 'deferred') AS deferred, count(DISTINCT expected_issue) AS matched_issues FROM lr GROUP BY run)
SELECT *, CASE WHEN accepted + rejected <> 0 THEN accepted * 10000 // (accepted + rejected) END AS precision_bp, matched_issues * 10000 // 50 AS recall_bp FROM a""")
def evaluation_rates(spark, sf):
    return R.rates(R.latest(B.adjudications(spark, sf)), 50)


@query(f"""WITH {B.SQL_ADJUDICATIONS}, m AS (SELECT DISTINCT run, expected_issue AS key FROM ad WHERE expected_issue IS NOT NULL), p AS (SELECT a.run AS r1, b.run AS r2, (SELECT count(*) FROM m x JOIN m y ON x.key = y.key WHERE x.run = a.run AND y.run = b.run) AS c, (SELECT count(DISTINCT key) FROM m WHERE run IN (a.run, b.run)) AS u FROM (SELECT DISTINCT run FROM m) a JOIN (SELECT DISTINCT run FROM m) b ON a.run < b.run)
SELECT count(*) AS pairs, sum(c)::BIGINT AS common, sum(u)::BIGINT AS union_size, (sum(c) * 10000 // sum(u))::BIGINT AS stability_bp FROM p""")
def run_stability(spark, sf):
    return R.stability(B.adjudications(spark, sf).filter("expected_issue is not null").select("run", F.col("expected_issue").alias("key")))


@query(f"""WITH {B.SQL_ADJUDICATIONS} SELECT run, finding, revision, state FROM ad WHERE revision < 1 OR (expected_issue IS NOT NULL AND state <> 'accepted') OR revision > 3""")
def adjudication_violations(spark, sf):
    return B.adjudications(spark, sf).filter("revision < 1 or (expected_issue is not null and state != 'accepted') or revision > 3").select("run", "finding", "revision", "state")


@query("""SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS want FROM conversations) WHERE turn <> want""")
def attempt_history(spark, sf):
    from pyspark.sql import Window

    c = B.t(spark, sf, "conversations").withColumn("want", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    return c.filter("turn != want").select("conv_id", "turn")

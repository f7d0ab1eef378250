"""Queries over manifests, replicas, logs, jobs and state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnwerk.operators import distribution, journal, order, store
from tarnwerk.plans import roles
from tarnwerk.plans.registry import query

c = F.col
O, H, R, J = roles.OBJECTS, roles.HELD, roles.RECORDS, roles.JOBS


@query("missing_set", f"WITH {O}, {H} SELECT txn, hash FROM o WHERE NOT EXISTS (SELECT 1 FROM held WHERE held.hash = o.hash)")
def _(t):
    return store.new_objects(roles.objects(t), roles.held(t)).select("txn", "hash")


@query("catalog_diff", f"WITH {O}, {H}, a AS (SELECT DISTINCT hash FROM o) SELECT hash FROM a EXCEPT SELECT hash FROM held")
def _(t):
    return store.new_objects(roles.objects(t).select("hash").distinct(), roles.held(t))


@query("s0_pull_set", f"WITH {O}, {H} SELECT DISTINCT hash FROM o WHERE length(hash) >= 2 AND hash NOT IN (SELECT hash FROM held)")
def _(t):
    notice = roles.objects(t).groupBy("txn").agg(F.collect_list(F.concat("hash", F.lit("C"))).alias("hashes"))  # an order's parts
    names = notice.select(F.explode("hashes").alias("h")).select(F.regexp_replace("h", "C$", "").alias("hash")).where(F.length("hash") >= 2).distinct()
    return store.new_objects(names, roles.held(t))


@query("size_lookup", f"WITH {O}, {H} SELECT txn, o.hash, coalesce(size, -1) AS size FROM o LEFT JOIN held USING (hash)")
def _(t):
    return store.with_sizes(roles.objects(t), roles.held(t)).select("txn", "hash", "size")


@query("manifest_total", f"WITH {O}, {H} SELECT txn, count(*) AS n, sum(coalesce(size, 0))::BIGINT AS total FROM o LEFT JOIN held USING (hash) GROUP BY txn")
def _(t):
    known = store.with_sizes(roles.objects(t), roles.held(t))
    return known.groupBy("txn").agg(F.count("*").alias("n"), F.sum(F.greatest("size", F.lit(0))).alias("total"))


@query("manifest_objects", f"WITH {O} SELECT txn, unnest(list_sort(list(hash))) AS hash FROM o GROUP BY txn")
def _(t):
    manifests = roles.objects(t).groupBy("txn").agg(F.sort_array(F.collect_list("hash")).alias("objects"))  # an order's parts
    return manifests.select("txn", F.explode("objects").alias("hash"))


@query("manifest_ndjson", f"WITH {O} SELECT txn, 0 AS line_no, '{{\"txn\":' || txn || '}}' AS line FROM o GROUP BY txn UNION ALL SELECT txn, (row_number() OVER (PARTITION BY txn ORDER BY hash))::INT, '{{\"hash\":\"' || hash || '\",\"size\":' || length(hash) || '}}' FROM o")
def _(t):
    from tarnwerk.sources.logs import ndjson_lines

    objects = roles.objects(t).withColumn("size", F.length("hash"))
    return ndjson_lines(objects.select("txn").distinct(), objects)


@query("bundle_requests", f"WITH {O}, {H}, m AS (SELECT txn, hash FROM o WHERE hash NOT IN (SELECT hash FROM held)), n AS (SELECT *, (row_number() OVER (PARTITION BY txn ORDER BY hash) - 1) // 4 AS request FROM m) SELECT txn, request, string_agg(hash, ' ' ORDER BY hash) AS hashes FROM n GROUP BY txn, request")
def _(t):
    missing = store.new_objects(roles.objects(t), roles.held(t))
    return store.requests(missing, 4).select("txn", "request", F.concat_ws(" ", "hashes").alias("hashes"))


@query("pull_result", f"WITH {O}, {H}, x AS (SELECT txn, held.hash IS NOT NULL AS have, hash[8] = '0' AS bad FROM o LEFT JOIN held USING (hash)) SELECT txn, count(*) AS total, sum(have::INT)::BIGINT AS skipped, sum((NOT have AND NOT bad)::INT)::BIGINT AS fetched, sum((NOT have AND bad)::INT)::BIGINT AS failed, sum((NOT have AND bad)::INT) = 0 AS advanced FROM x GROUP BY txn")
def _(t):
    rows = store.with_sizes(roles.objects(t), roles.held(t)).select("txn", (c("size") >= 0).alias("have"), c("hash").endswith("0").alias("bad"))
    n = lambda x: F.sum(x.cast("long"))
    return rows.groupBy("txn").agg(F.count("*").alias("total"), n(c("have")).alias("skipped"), n(~c("have") & ~c("bad")).alias("fetched"), n(~c("have") & c("bad")).alias("failed"), (n(~c("have") & c("bad")) == 0).alias("advanced"))


@query("first_good_base", f"WITH {O} SELECT hash, min(b)::INT AS base FROM (SELECT DISTINCT hash FROM o), (SELECT unnest([0, 1, 2]) AS b) WHERE (ascii(hash[8]) + b) % 3 = 0 GROUP BY hash")
def _(t):
    bases = F.array(*[F.struct(F.lit(b).alias("b"), ((F.ascii(F.substring("hash", 8, 1)) + b) % 3 == 0).alias("good")) for b in range(3)])
    return roles.objects(t).select("hash").distinct().select("hash", F.get(F.filter(bases, lambda x: x["good"]), F.lit(0))["b"].alias("base"))


@query("refcount", f"WITH {O} SELECT hash, count(DISTINCT txn) AS refs FROM o GROUP BY hash")
def _(t):
    return distribution.refcounts(roles.objects(t))


PINS = "p AS (SELECT user_id AS txn, arg_max(event_id, (ts, event_id)) AS pin, max(ts) AS seen FROM events GROUP BY user_id)"


@query("pin_ttl", f"WITH {PINS} SELECT txn, pin FROM p WHERE seen + INTERVAL 1 DAY >= (SELECT max(ts) FROM events)")
def _(t):
    last = t.events.groupBy(c("user_id").alias("txn")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("pin"), F.max("ts").alias("at"))
    now = t.events.agg(F.max("ts").alias("now"))
    return last.join(F.broadcast(now)).where(c("at") + F.expr("INTERVAL 1 DAY") >= c("now")).select("txn", "pin")  # now: one row


@query("quorum", "WITH f AS (SELECT date_trunc('day', ts)::DATE AS txn, user_id, min(ts) AS seen FROM events WHERE user_id < 50 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY txn ORDER BY seen, user_id) AS k FROM f) SELECT txn, count(*) AS acks, min(CASE WHEN k = 20 THEN seen END) AS reached_at FROM k GROUP BY txn")
def _(t):
    acks = t.events.select(c("ts").cast("date").alias("txn"), c("user_id").alias("node"), c("ts").alias("at"))
    replicas = t.spark.range(50).select(c("id").alias("node"))
    return distribution.quorum_reached(acks, replicas, 20)


@query("admission_active", "SELECT user_id % 10 AS node, count(DISTINCT user_id) AS active, count(DISTINCT user_id) < 16 AS room FROM events WHERE event_type = 'view' GROUP BY 1")
def _(t):
    rows = t.events.where("event_type = 'view'").groupBy((c("user_id") % 10).alias("node")).agg(F.count_distinct("user_id").alias("active"))
    return rows.withColumn("room", c("active") < 16)


@query("lease_admission")
def _(t):
    at = c("event_id").cast("double")
    kind = F.when(c("event_type") == "error", "release").when(c("event_type") == "click", "renew").otherwise("acquire")
    rows = t.events.select(c("event_id").alias("seq"), (c("user_id") % 10).cast("string").alias("node"), at.alias("at"), kind.alias("kind"), c("user_id").cast("string").alias("lease"))
    return distribution.admissions(rows, 40, 6, 300.0)


@query("token_bucket")
def _(t):
    rows = t.events.select(c("event_id").alias("seq"), c("user_id").cast("string").alias("ip"), c("event_id").cast("double").alias("at"))
    return distribution.rate_limited(rows, 0.002, 3.0, 0.5, 20.0)


@query("min_rtt", "SELECT user_id, min(value) AS rtt FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(F.min("value").alias("rtt"))


@query("bench_stats", "WITH b AS (SELECT l_suppkey, sum(floor(l_quantity))::BIGINT AS bytes, count(*) AS single, max(l_linenumber)::BIGINT AS bundled FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, round(bytes / 1e6 / bundled, 6) AS mbs, round(single::DOUBLE / bundled, 6) AS speedup, round(1 - bundled::DOUBLE / single, 6) AS reduction, single::DOUBLE / bundled >= 1.5 AS bundle FROM b")
def _(t):
    rows = t.lineitem.groupBy("l_suppkey").agg(F.sum(F.floor("l_quantity")).alias("bytes"), F.count("*").alias("single_requests"), F.max("l_linenumber").cast("long").alias("bundled_requests"))
    out = distribution.compare_transfers(rows.withColumns({"single_s": c("single_requests").cast("double"), "bundled_s": c("bundled_requests").cast("double")}))
    return out.select("l_suppkey", F.round("mbs", 6).alias("mbs"), F.round("speedup", 6).alias("speedup"), F.round("reduction", 6).alias("reduction"), "bundle")


@query("reconcile", f"WITH {R} SELECT * FROM (SELECT txn_id, arg_max(phase, seq) AS phase, min(seq) AS first_seq FROM r GROUP BY txn_id) WHERE phase IN ('prepare', 'warm')")
def _(t):
    return journal.incomplete(roles.records(t))


@query("recovery_actions", f"WITH {R}, l AS (SELECT txn_id, arg_max(phase, seq) AS phase FROM r GROUP BY txn_id) SELECT txn_id, CASE phase WHEN 'warm' THEN 'commit' ELSE 'abort' END AS action FROM l WHERE phase IN ('prepare', 'warm')")
def _(t):
    return journal.incomplete(roles.records(t)).select("txn_id", journal.recovery_action(c("phase")).alias("action"))


@query("commit_outcome", f"WITH {R} SELECT txn_id, bool_or(phase = 'commit') AS committed, bool_or(phase = 'abort') AS aborted, count(*) AS records FROM r GROUP BY txn_id")
def _(t):
    return roles.records(t).groupBy("txn_id").agg(F.bool_or(c("phase") == "commit").alias("committed"), F.bool_or(c("phase") == "abort").alias("aborted"), F.count("*").alias("records"))


@query("first_seen_order", f"WITH {R}, f AS (SELECT txn_id, min(seq) AS first_seq FROM r GROUP BY txn_id) SELECT *, row_number() OVER (ORDER BY first_seq) AS place FROM f")
def _(t):
    return order.placed(roles.records(t).groupBy("txn_id").agg(F.min("seq").alias("first_seq")), "first_seq")


@query("transition_elapsed", "SELECT event_id, user_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS elapsed_us FROM events")
def _(t):
    return journal.elapsed(t.events.select("event_id", "user_id", "ts"), "user_id", "ts", "event_id").select("event_id", "user_id", "elapsed_us")


@query("phase_durations", f"WITH {J} SELECT id, date_diff('microsecond', created_at, updated_at) AS total_us FROM j")
def _(t):
    return roles.jobs(t).select("id", F.timestamp_diff("MICROSECOND", c("created_at"), c("updated_at")).alias("total_us"))


@query("consecutive_failures", "WITH m AS (SELECT user_id, event_type = 'error' AS bad, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events) SELECT user_id, run::BIGINT AS run, count(*) AS n FROM m WHERE bad GROUP BY ALL HAVING count(*) >= 3")
def _(t):
    return journal.runs_of(t.events, "user_id", ["ts", "event_id"], c("event_type") == "error", 3)


@query("until_terminal", "WITH e AS (SELECT user_id, min(event_id) AS stop FROM events WHERE event_type = 'purchase' GROUP BY user_id) SELECT event_id, user_id FROM events LEFT JOIN e USING (user_id) WHERE stop IS NULL OR event_id <= stop")
def _(t):
    return journal.until_terminal(t.events, "user_id", "event_id", c("event_type") == "purchase").select("event_id", "user_id")


@query("retained_last_value", "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def _(t):
    from tarnwerk.operators.catalog import last_wins

    return last_wins(t.events.select("user_id", "event_type", "value", "event_id"), ["user_id"], "event_id").select("user_id", "event_type", "value")


@query("announce_dedup", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("nonce_once", "SELECT props AS nonce, min(event_id) AS first_use, count(*) - 1 AS replays FROM events GROUP BY props")
def _(t):
    return t.events.groupBy(c("props").alias("nonce")).agg(F.min("event_id").alias("first_use"), (F.count("*") - 1).alias("replays"))


@query("keep_newest_n", "SELECT user_id, max(event_id) AS last_put FROM events GROUP BY user_id ORDER BY last_put DESC, user_id LIMIT 100")
def _(t):
    return journal.newest(t.events, "user_id", "event_id", 100)


@query("job_queue", f"WITH {J} SELECT id, tar_size, row_number() OVER (ORDER BY tar_size DESC, created_at, id) AS place FROM j WHERE state = 'staging'")
def _(t):
    queued = roles.jobs(t).where("state = 'staging'").select("id", "tar_size", "created_at")
    return order.placed(queued, F.desc("tar_size"), "created_at", "id").drop("created_at")


@query("priority_pop", f"WITH {J} SELECT repo, arg_max(id, (tar_size, -id)) AS id FROM j WHERE state <> 'leased' GROUP BY repo")
def _(t):
    return roles.jobs(t).where("state <> 'leased'").groupBy("repo").agg(F.max_by("id", F.struct("tar_size", -c("id"))).alias("id"))


@query("find_job", f"WITH {J} SELECT repo, arg_min(state, (CASE state WHEN 'staging' THEN 1 WHEN 'leased' THEN 4 ELSE 6 END, id)) AS state FROM j GROUP BY repo")
def _(t):
    from tarnwerk.schemas import STATES, numbered

    order = numbered(STATES)(c("state"))
    return roles.jobs(t).groupBy("repo").agg(F.min_by("state", F.struct(order.alias("o"), "id")).alias("state"))


@query("scan_job_manifests", f"WITH {J} SELECT state, count(*) AS n, min(created_at) AS oldest FROM j WHERE state NOT IN ('published', 'aborted', 'failed') GROUP BY state")
def _(t):
    return roles.jobs(t).where(~journal.is_terminal(c("state"))).groupBy("state").agg(F.count("*").alias("n"), F.min("created_at").alias("oldest"))


@query("log_join", "SELECT c_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderdate, o_orderkey) AS log FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def _(t):
    entry = F.struct("o_orderdate", "o_orderkey", "o_orderstatus")
    logs = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(entry)).alias("l"))  # a job's transitions
    joined = t.customer.select("c_custkey").join(logs, c("c_custkey") == c("o_custkey"), "left")
    return joined.select("c_custkey", F.when(c("l").isNotNull(), F.array_join(F.transform("l", lambda x: x["o_orderstatus"]), "")).alias("log"))


@query("reset_for_recovery", f"WITH {J} SELECT id, CASE WHEN recovery_count >= 3 THEN 'failed' ELSE 'incoming' END AS state, CASE WHEN recovery_count >= 3 THEN recovery_count ELSE recovery_count + 1 END AS recovery_count, CASE WHEN recovery_count >= 3 THEN state END AS failed_at_state FROM j WHERE state NOT IN ('published', 'aborted', 'failed')")
def _(t):
    return journal.for_recovery(roles.jobs(t))


@query("metrics_counters", "SELECT event_type, user_id % 3 AS class, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def _(t):
    return t.events.groupBy("event_type", (c("user_id") % 3).alias("class")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("phase_histogram", "WITH b AS (SELECT 0.5 * pow(2, unnest(range(15))) AS le UNION ALL SELECT NULL) SELECT le, count(*) AS n FROM b JOIN events ON le IS NULL OR value <= le GROUP BY le UNION ALL SELECT le, 0 FROM b WHERE le IS NOT NULL AND NOT EXISTS (SELECT 1 FROM events WHERE value <= le)")
def _(t):
    return journal.histogram(t.events, "value", [0.5 * 2**k for k in range(15)])


@query("exponential_buckets", "SELECT user_id, sum((value <= 10)::INT)::BIGINT AS le_10, sum((value <= 100)::INT)::BIGINT AS le_100, count(*) AS n FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(F.sum((c("value") <= 10).cast("long")).alias("le_10"), F.sum((c("value") <= 100).cast("long")).alias("le_100"), F.count("*").alias("n"))


@query("announce_check", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'repo' WHEN event_id % 7 = 0 THEN 'payload_id' END AS missing FROM events")
def _(t):
    from tarnwerk.streaming.streams import checked_announcements

    rows = t.events.select("event_id", F.when(c("event_id") % 5 != 0, "r").alias("repo"), F.when(c("event_id") % 7 != 0, "p").alias("payload_id"))
    good, bad = checked_announcements(rows, ["repo", "payload_id"])
    return good.select("event_id", F.lit(None).cast("string").alias("missing")).unionByName(bad.select("event_id", "missing"))


@query("coalesce_busy", "WITH w AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, sum((before IS NULL OR ts - before >= INTERVAL 1 HOUR)::INT)::BIGINT AS pulls FROM w GROUP BY user_id")
def _(t):
    rows = journal.elapsed(t.events, "user_id", "ts", "event_id")
    return rows.groupBy("user_id").agg(F.sum((c("elapsed_us").isNull() | (c("elapsed_us") >= 3_600_000_000)).cast("long")).alias("pulls"))

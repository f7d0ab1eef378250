"""Manifests, replicas, quorums, leases: what is to be sent, who has it, when it counts as there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwerk.functions import paths


def manifest_error(txn: Column, repo: Column, root: Column, urls: Column, generator: Column, auth: Column, hashes: Column) -> Column:
    """The first rule that a manifest breaks, null for a valid one."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    bad = F.exists(F.coalesce(hashes, F.array().cast("array<string>")), lambda h: ~paths.valid_object_name(h))
    return (
        F.when(empty(txn), "missing transaction_id")
        .when(empty(repo), "missing repo")
        .when(empty(root), "missing target_root_hash")
        .when(F.coalesce(F.size(urls), F.lit(0)) <= 0, "missing base_urls")
        .when(~F.coalesce(generator, F.lit("")).isin("pipeline", "diff"), "invalid generator")
        .when(~F.coalesce(auth, F.lit("")).isin("public", "token", ""), "invalid auth")
        .when(bad, "invalid hash")
    )


def refcounts(pins: DataFrame, txn: str = "txn", key: str = "hash") -> DataFrame:
    """(key, refs): live transactions that need an object, each counted once."""
    return pins.select(txn, key).distinct().groupBy(key).agg(F.count("*").alias("refs"))


def quorum_needed(quorum: int, replicas: Column) -> Column:
    return F.when((F.lit(quorum) <= 0) | (F.lit(quorum) > replicas), replicas).otherwise(F.lit(quorum))


def quorum_reached(acks: DataFrame, replicas: DataFrame, quorum: int, txn: str = "txn", node: str = "node", at: str = "at") -> DataFrame:
    """(txn, acks, reached_at): distinct known replicas that answered, and when the quorum was complete (null: never)."""
    n = replicas.select(node).distinct().agg(F.count("*").alias("replicas"))
    first = acks.join(replicas.select(node).distinct(), node, "left_semi").groupBy(txn, node).agg(F.min(at).alias(at))
    ranked = first.withColumn("k", F.row_number().over(Window.partitionBy(txn).orderBy(at, node)))
    both = ranked.join(F.broadcast(n)).withColumn("need", quorum_needed(quorum, F.col("replicas")))  # one row
    return both.groupBy(txn).agg(F.count("*").alias("acks"), F.min(F.when(F.col("k") == F.col("need"), F.col(at))).alias("reached_at"))


def autotune(rtt_ms: Column) -> tuple[Column, Column]:
    """(concurrency, files a request) for a round-trip time."""
    pick = lambda a, b, c, d: F.when(rtt_ms < 5, a).when(rtt_ms < 50, b).when(rtt_ms < 150, c).otherwise(d)
    return pick(32, 16, 8, 8), pick(1, 8, 32, 64)


def load_slots(least: Column, most: Column, load: Column) -> Column:
    return F.greatest(least, most - load.cast("int"))


def serves(repos: Column, repo: Column) -> Column:
    """An empty list serves everything; names are compared without case."""
    return (F.size(repos) == 0) | F.exists(repos, lambda r: F.lower(r) == F.lower(repo))


def acl_allowed(node: Column, publisher: str, write: Column, topic: Column) -> Column:
    return (node == publisher) | ~write | topic.contains("/ready") | topic.contains("/presence")


def error_class(explicit: Column, network: Column) -> Column:
    return F.coalesce(explicit, F.when(network, "transient").otherwise("internal"))


def in_order(rows: DataFrame, order: str, start, step, schema: str, out: str) -> DataFrame:
    """``rows`` with the column ``out`` = step(state, row), followed in one order with one state. The order couples all
    rows, so one task follows it, batch by batch after an external sort: it holds a batch and the state."""

    def run(batches):
        state = start()
        for pdf in batches:
            pdf[out] = [step(state, r) for r in pdf.itertuples(index=False)]
            yield pdf

    return rows.repartition(1).sortWithinPartitions(order).mapInPandas(run, schema)


def admissions(requests: DataFrame, total: int, per_node: int, ttl_s: float) -> DataFrame:
    """``requests`` (seq, node, at double seconds, kind 'acquire', 'renew' or 'release', lease) with granted.

    One global cap couples all nodes, so the order is followed in one task, in bounded state: the leases that are
    held. A lease expires once strictly more than ``ttl_s`` has passed.
    """
    from tarnwerk.streaming.state import Leases

    rows = requests.select("seq", "node", "at", "kind", "lease")
    step = lambda held, r: held.step(r.kind, r.node, r.lease, r.at)
    return in_order(rows, "seq", lambda: Leases(total, per_node, ttl_s), step, "seq long, node string, at double, kind string, lease string, granted boolean", "granted")


def rate_limited(requests: DataFrame, rate: float, burst: float, global_rate: float, global_burst: float, most: int = 1 << 20) -> DataFrame:
    """``requests`` (seq, ip, at double seconds) with allowed, by a bucket an address behind one for all. The global
    bucket couples all addresses: one task, whose state is the buckets."""
    from tarnwerk.streaming.state import Buckets

    rows = requests.select("seq", "ip", "at")
    step = lambda buckets, r: buckets.allow(r.ip, r.at)
    return in_order(rows, "seq", lambda: Buckets(rate, burst, global_rate, global_burst, most), step, "seq long, ip string, at double, allowed boolean", "allowed")


def compare_transfers(rows: DataFrame, floor: float = 1.5) -> DataFrame:
    """Adds mbs, speedup, reduction and verdict to (bytes, single_s, bundled_s, single_requests, bundled_requests)."""
    c = F.col
    speedup = F.when(c("bundled_s") <= 0, 0.0).otherwise(c("single_s") / c("bundled_s"))
    reduction = F.when(c("single_requests") == 0, 0.0).otherwise(1 - c("bundled_requests") / c("single_requests"))
    mbs = F.when(c("bundled_s") <= 0, 0.0).otherwise(c("bytes") / 1e6 / c("bundled_s"))
    return rows.withColumns({"mbs": mbs, "speedup": speedup, "reduction": reduction}).withColumn("bundle", c("speedup") >= floor)

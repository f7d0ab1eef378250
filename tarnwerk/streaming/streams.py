"""Streaming forms: each takes a stream (or a batch, which is the twin used in checks) and states its bound on state.

The operators have no event time of their own; what bounds their state here is a watermark, which is our addition.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwerk.streaming.state import Leases


def once(stream: DataFrame, key: str, at: str, within: str) -> DataFrame:
    """The first row of each key within the watermark: duplicate announcements, nonces."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def checked_announcements(stream: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, error rows with the first missing field)."""
    missing = F.coalesce(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in required])
    marked = stream.withColumn("missing", missing)
    return marked.where("missing is null").drop("missing"), marked.where("missing is not null")


def upsert_last(spark: SparkSession, path: str, key: str, seq: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that keeps the last value of each key: a retained message, a synced root. Each micro-batch
    writes a new version of the table next to the old one, named by the batch, so a repeated batch changes nothing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def write(batch: DataFrame, number: int) -> None:
        fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        old = f"{path}/v={number - 1}"
        rows = batch.sparkSession.read.parquet(old).unionByName(batch) if number and fs.exists(hadoop.Path(old)) else batch
        rest = [c for c in batch.columns if c != key]
        last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(key, *[F.col(f"_r.`{c}`").alias(c) for c in rest])
        last.write.mode("overwrite").parquet(f"{path}/v={number}")

    return write


def missing_objects(manifests: DataFrame, held: DataFrame, key: str = "hash") -> DataFrame:
    """Stream of manifest rows (txn, objects) to the objects that a static table doesn't hold."""
    return manifests.select("txn", F.explode("objects").alias(key)).join(held.select(key).distinct(), key, "left_anti")


def lease_stream(stream: DataFrame, per_node: int, ttl_s: float, at: str = "at") -> DataFrame:
    """Admission a node over a stream of (node, seq, kind, lease, at timestamp), with the node's leases as keyed state;
    state of a node goes when the watermark has passed its last lease's end. The global cap couples all nodes and is
    checked in the batch form only."""

    def run(key, frames: Iterator[pd.DataFrame], state):
        leases = Leases(0, per_node, ttl_s)
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            names, ends = state.get
            leases.held = {n: (key[0], float(e)) for n, e in zip(names, ends)}
        for f in frames:
            f = f.sort_values("seq")
            now = [t.timestamp() for t in f[at]]
            f["granted"] = [leases.step(k, key[0], lease, t) for k, lease, t in zip(f["kind"], f["lease"], now)]
            yield f[["node", "seq", "granted"]]
        state.update((list(leases.held), [e for _, e in leases.held.values()]))
        if leases.held and state.getCurrentWatermarkMs() < (end := int(1000 * max(e for _, e in leases.held.values())) + 1):
            state.setTimeoutTimestamp(end)

    rows = stream.withWatermark(at, f"{int(ttl_s)} seconds").groupBy("node")
    return rows.applyInPandasWithState(run, "node string, seq long, granted boolean", "names array<string>, ends array<double>", "append", "EventTimeTimeout")


def topic_matches(topic: Column, pattern: str) -> Column:
    """Whether a topic matches a subscription: + stands for one segment, a final # for any rest."""
    parts = ["[^/]+" if p == "+" else ".*" if p == "#" else re.escape(p) for p in pattern.split("/")]
    return topic.rlike("^" + "/".join(parts).replace("/.*", "(/.*)?") + "$")


def subscribe(spark: SparkSession, path: str, schema: str, pattern: str) -> DataFrame:
    """A stream of the messages (JSON lines with a topic) that arrive as files under ``path`` and match a subscription."""
    return spark.readStream.schema(schema).json(path).where(topic_matches(F.col("topic"), pattern))


def manifests_in(stream: DataFrame, text: str = "value") -> DataFrame:
    """Manifest documents of a stream or table of JSON texts, with the first rule that each breaks in ``error``."""
    from tarnwerk.operators.distribution import manifest_error
    from tarnwerk.schemas import MANIFEST

    m = stream.withColumn("m", F.from_json(text, MANIFEST)).select("m.*")
    hashes = F.transform("objects", lambda o: o["hash"])
    return m.withColumn("error", manifest_error(*[F.col(c) for c in ("transaction_id", "repo", "target_root_hash", "base_urls", "generator", "auth")], hashes))

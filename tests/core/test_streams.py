"""Streams over a table split into files, against their batch twins; multi-batch and restarts included."""

import os

from pyspark.sql import functions as F

from tarnwerk.streaming import streams
from tarnwerk.streaming.state import Leases

EVENTS = "/root/testdata/sf0.001/events.parquet"


def parts(spark, tmp_path, n=4):
    rows = spark.read.parquet(EVENTS).select("event_id", F.col("ts").cast("timestamp").alias("at"), "user_id", "event_type", "value")
    rows.repartitionByRange(n, "event_id").sortWithinPartitions("event_id").write.parquet(str(tmp_path / "in"))
    for k, f in enumerate(sorted((tmp_path / "in").glob("*.parquet"))):  # the source takes files by age
        os.utime(f, (1_700_000_000 + 10 * k,) * 2)
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drain(spark, stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return spark.table(name)


def test_first_announcement_only(spark, tmp_path):
    rows, stream = parts(spark, tmp_path)
    got = drain(spark, streams.once(stream, "user_id", "at", "365 days"), tmp_path, "once").collect()
    assert len(got) == rows.select("user_id").distinct().count() == len({r.user_id for r in got})


def test_retained_values_survive_a_repeated_batch(spark, tmp_path):
    rows, stream = parts(spark, tmp_path)
    path = str(tmp_path / "kept")
    write = streams.upsert_last(spark, path, "user_id", "event_id")
    seen = []

    def twice(batch, number):
        seen.append(number)
        write(batch, number)
        write(batch, number)

    q = stream.writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert len(seen) > 1
    got = {(r.user_id, r.event_id) for r in spark.read.parquet(f"{path}/v={seen[-1]}").collect()}
    assert got == {(r.user_id, r.m) for r in rows.groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}


def test_missing_objects_of_a_stream(spark, tmp_path):
    rows, stream = parts(spark, tmp_path)
    held = spark.range(0, 500).select(F.col("id").alias("hash"))
    manifests = lambda d: d.select(F.col("user_id").alias("txn"), F.array("event_id").alias("objects"))
    got = drain(spark, streams.missing_objects(manifests(stream), held), tmp_path, "missing")
    assert sorted(map(tuple, got.select("txn", "hash").collect())) == sorted(map(tuple, streams.missing_objects(manifests(rows), held).select("txn", "hash").collect()))


def test_lease_stream_equals_the_machine(spark, tmp_path):
    rows, stream = parts(spark, tmp_path)
    shape = lambda d: d.select((F.col("user_id") % 5).cast("string").alias("node"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "release").otherwise("acquire").alias("kind"), (F.col("user_id") % 20).cast("string").alias("lease"), "at")
    got = {r.seq: r.granted for r in drain(spark, streams.lease_stream(shape(stream), 2, 86400.0), tmp_path, "leases").collect()}
    machines, want = {}, {}
    for r in shape(rows).orderBy("seq").collect():
        want[r.seq] = machines.setdefault(r.node, Leases(0, 2, 86400.0)).step(r.kind, r.node, r.lease, r["at"].timestamp())
    ordered = rows.select("event_id", "at").orderBy("event_id").collect()
    if all(a["at"] <= b["at"] for a, b in zip(ordered, ordered[1:])):
        assert got == want
    assert set(got) == set(want)


def test_subscriptions_and_manifests(spark, tmp_path):
    (tmp_path / "msg").mkdir()
    (tmp_path / "msg/1.json").write_text('{"topic": "b/repos/r1/announce", "body": "1"}\n{"topic": "b/repos/r1/x/announce", "body": "2"}\n{"topic": "b/receivers/n/ready", "body": "3"}\n')
    got = drain(spark, streams.subscribe(spark, str(tmp_path / "msg"), "topic string, body string", "b/repos/+/announce"), tmp_path, "announced")
    assert [r.body for r in got.collect()] == ["1"]
    assert [r.x for r in spark.createDataFrame([("b",), ("b/c/d",), ("bc",)], "t string").select(streams.topic_matches(F.col("t"), "b/#").alias("x")).collect()] == [True, True, False]
    text = '{"transaction_id": "t", "repo": "r", "target_root_hash": "aa", "base_urls": ["u"], "generator": "%s", "objects": [{"hash": "%s", "size": 4}]}'
    rows = spark.createDataFrame([(text % ("diff", "00aa"),), (text % ("guess", "00aa"),), (text % ("pipeline", "a/b"),)], "value string")
    assert [r.error for r in streams.manifests_in(rows).collect()] == [None, "invalid generator", "invalid hash"]


def test_fetchers():
    import pytest

    from tarnwerk.sources import registry

    registry.register("local", lambda base, name: b"")
    assert registry.names() == ["local"] and registry.get("local")("", "") == b""
    with pytest.raises(KeyError):
        registry.register("local", None)

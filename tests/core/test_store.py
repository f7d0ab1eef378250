"""Stores, builds and changes on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tarnwerk.operators import build, catalog, distribution, journal, store
from tarnwerk.sources import logs

FILE = "path string, type string, size long, perm int, n_chunks int, external boolean, n_xattrs int, hash string"


def test_put_is_idempotent(spark, tmp_path):
    one = spark.createDataFrame([("00aa", 1), ("00aa", 1), ("11bb", 2)], "hash string, size long")
    path = str(tmp_path / "cas")
    store.put(one, path)
    store.put(one.unionByName(spark.createDataFrame([("22cc", 3)], one.schema)), path)
    held = spark.read.parquet(path)
    assert sorted((r.hash, r.size, str(r.shard)) for r in held.collect())[0][:2] == ("00aa", 1) and held.count() == 3
    asked = spark.createDataFrame([("00aa",), ("ffff",)], "hash string")
    assert sorted(map(tuple, store.with_sizes(asked, held.select("hash", "size")).collect())) == [("00aa", 1), ("ffff", -1)]


def test_build_below_a_lease(spark):
    rows = [(".", "dir", 4096, 0o755, 0, False, 0, None), ("sub", "dir", 4096, 0o755, 0, False, 0, None), ("sub/.marker", "reg", 0, 0o644, 0, False, 0, "aa"), ("sub/file.txt", "reg", 1000, 0o644, 0, False, 1, "bb"), ("big", "reg", 2048, 0o644, 2, False, 0, "cc"), ("ext", "reg", 512, 0o644, 0, True, 0, "dd"), ("a/ln", "symlink", 0, 0o777, 0, False, 0, None)]
    b = build.build(spark.createDataFrame(rows, FILE), [], "pkg/v1")
    got = {r.catalog_path: r for r in b.counters.collect()}
    assert set(got) == {"", "/pkg/v1/sub"}
    root, sub = got[""], got["/pkg/v1/sub"]
    assert (sub.self_regular, sub.self_dir, sub.self_file_size, sub.self_xattr, sub.subtree_regular) == (2, 1, 1000, 1, 0)
    assert (root.self_regular, root.self_dir, root.self_chunked, root.self_chunks, root.self_chunked_size, root.self_external, root.self_external_file_size, root.self_symlink, root.self_nested, root.subtree_regular, root.subtree_file_size) == (2, 2, 1, 2, 2048, 1, 512, 1, 1, 2, 1000)
    assert [tuple(r) for r in b.mounts.collect()] == [("/pkg/v1/sub", "")]
    again = build.build(spark.createDataFrame(rows[::-1], FILE).repartition(3), [], "pkg/v1")
    assert sorted(map(tuple, b.identities.collect())) == sorted(map(tuple, again.identities.collect()))
    with pytest.raises(Exception, match="path twice"):
        build.build(spark.createDataFrame([*rows, rows[4]], FILE), [], "pkg/v1").rows.collect()


def test_changes(spark):
    fresh = build.new_catalog(spark, "/x")
    assert fresh["statistics"].count() == 24 and fresh["catalog"].first().mode == 0o040755
    assert build.set_property(fresh["properties"], "root_prefix", "/y").where("value = '/y'").count() == 1
    mounts = spark.createDataFrame([("/a", "00", 1)], "path string, sha1 string, size long")
    assert tuple(build.update_mount(mounts, "/a", "ff", 9).first()) == ("/a", "ff", 9)
    with pytest.raises(KeyError):
        build.update_mount(mounts, "/b", "ff", 9)
    with pytest.raises(Exception, match="key twice"):
        build.insert(mounts, mounts).collect()
    rows = spark.createDataFrame([(1, "a", False), (2, "a", True), (3, "a", False), (4, "b", False), (5, "b", True), (6, "c", True)], "seq long, path string, gone boolean")
    assert [r.seq for r in catalog.apply_deletes(rows, "path", "seq", F.col("gone")).collect()] == [3]
    jobs = spark.createDataFrame([("j1", "incoming"), ("j2", "leased")], "id string, state string")
    change = lambda *r: spark.createDataFrame(r, "id string, to string, t timestamp, run_id string, note string")
    moved, lines = build.move_jobs(jobs, change(("j1", "staging", None, "r", "")))
    assert sorted(map(tuple, moved.select("id", "state").collect())) == [("j1", "staging"), ("j2", "leased")]
    assert lines.first().line[8] == " "
    with pytest.raises(Exception, match="no way from leased to staging"):
        build.move_jobs(jobs, change(("j2", "staging", None, "r", "")))[0].collect()


def test_hardlinks(spark):
    rows = [("t", 0, "a", "reg", None, 8, b"original"), ("t", 1, "b", "link", "a", 0, None), ("t", 2, "c", "link", "b", 0, None), ("t", 3, "d", "link", "later", 0, None), ("t", 4, "later", "reg", None, 1, b"x"), ("t", 5, "e", "link", "e", 0, None), ("u", 6, "f", "link", "a", 0, None)]
    got = {r.path: r for r in catalog.resolve_hardlinks(spark.createDataFrame(rows, "archive string, seq long, path string, type string, link_target string, size long, data binary")).collect()}
    assert [(got[p].size, bytes(got[p].data), got[p].bad) for p in "abc"] == [(8, b"original", False)] * 3
    assert [got[p].bad for p in ("d", "e", "f", "later")] == [True, True, True, False]


def test_logs_and_recovery(spark, tmp_path):
    records = [(1, "t1", "prepare"), (2, "t1", "warm"), (3, "t1", "commit"), (4, "t2", "prepare"), (5, "t2", "warm"), (6, "t3", "prepare"), (7, "t3", "abort")]
    left = journal.incomplete(spark.createDataFrame(records, "seq long, txn_id string, phase string")).collect()
    assert [(r.txn_id, r.phase) for r in left] == [("t2", "warm")]
    (tmp_path / "incoming/j1").mkdir(parents=True)
    (tmp_path / "incoming/j1/manifest.json").write_text('{"id": "j1",\n "state": "incoming", "tar_size": 5, "unknown": 1}')
    assert [(r.id, r.tar_size) for r in logs.read_jobs(spark, str(tmp_path)).collect()] == [("j1", 5)]


def test_refcounts(spark):
    pins = spark.createDataFrame([("t1", "a"), ("t1", "b"), ("t1", "b"), ("t2", "b"), ("t2", "c")], "txn string, hash string")
    assert sorted(map(tuple, distribution.refcounts(pins).collect())) == [("a", 1), ("b", 2), ("c", 1)]

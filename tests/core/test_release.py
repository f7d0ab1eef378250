"""The life of a release on disk, logs that are appended to, staging paths."""

import posixpath

import pytest
from pyspark.sql import functions as F

from tarnwerk.functions import paths
from tarnwerk.operators import build, catalog, release
from tarnwerk.schemas import CHUNKS_BY_PATH, COUNTERS
from tarnwerk.sources import journals, logs

FILE = "path string, type string, size long, perm int, n_chunks int, external boolean, n_xattrs int, hash string"
ROWS = [
    ("sub/.marker", "reg", 0, 0o644, 0, False, 0, "aa"), ("sub/file", "reg", 1000, 0o644, 0, False, 1, "bb"), ("sub/in/.marker", "reg", 0, 0o644, 0, False, 0, "cc"),
    ("sub/in/big", "reg", 2048, 0o644, 2, False, 0, "dd"), ("ext", "reg", 512, 0o644, 0, True, 0, "ee"), ("dev", "fifo", 0, 0o644, 0, False, 0, None),
]
CHUNK_ROWS = [("/sub/in", "/sub/in/big", 0, 0, 1024, "d0"), ("/sub/in", "/sub/in/big", 1, 1024, 1024, "d1")]


def counters(tables):
    return {(r.catalog_path, r.counter): r.value for r in tables["statistics"].collect()}


def properties(tables):
    return {(r.catalog_path, r.key): r.value for r in tables["properties"].collect()}


def test_write_reopen_change_write_again(spark, tmp_path):
    path = str(tmp_path / "release")
    with pytest.raises(FileNotFoundError):
        release.open_release(spark, path)
    # a version that was never finished isn't seen
    built = build.build(spark.createDataFrame(ROWS, FILE), [])
    made = release.tables_of(built, spark.createDataFrame(CHUNK_ROWS, CHUNKS_BY_PATH))
    assert release.finalize(made, path, 100) == 1
    (tmp_path / "release" / "v=7").mkdir()
    first = release.open_release(spark, path)
    n = counters(first)
    assert len(n) == 3 * 24 and {c for _, c in n} == {f"{k}_{c}" for k in ("self", "subtree") for c in COUNTERS}
    assert (n["/sub/in", "self_chunks"], n["/sub", "subtree_chunked_size"], n["", "subtree_chunks"], n["", "subtree_nested"], n["", "self_special"]) == (2, 2048, 2, 1, 1)
    assert {k: v for k, v in properties(first).items() if k[1] in ("revision", "last_modified")} == {(p, k): v for p in ("", "/sub", "/sub/in") for k, v in (("revision", "1"), ("last_modified", "100"))}
    assert sorted(map(tuple, release.root_prefixes(first).collect())) == [("", ""), ("/sub", "/sub"), ("/sub/in", "/sub/in")]
    assert [(r.catalog_path, r.path) for r in release.mounts_of(first).orderBy("path").collect()] == [("", "/sub"), ("/sub", "/sub/in")]

    row = lambda **k: first["catalog"].where(F.col("path") == k["path"]).withColumns({c: F.lit(v).cast(dict(first["catalog"].dtypes)[c]) for c, v in k.items()})
    plain = row(path="/sub/in/big", n_chunks=0, size=5, hash="ff")
    again = release.remove(release.upsert(first, plain), first["catalog"].where("path in ('/sub/file', '/ext')").unionByName(row(path="/dev").withColumn("path", F.lit("/nothing"))))
    touched = spark.createDataFrame([("/sub/in",)], "catalog_path string")
    assert release.finalize(again, path, 200, touched) == 2
    second = release.open_release(spark, path)
    assert second["chunks"].count() == 0 and first["chunks"].count() == 2
    n = counters(second)
    assert (n["/sub/in", "self_chunked"], n["/sub/in", "self_file_size"], n["/sub", "subtree_file_size"], n["", "subtree_file_size"]) == (0, 5, 5, 5)
    assert (n["/sub", "self_regular"], n["/sub", "self_xattr"], n["", "self_external"], n["", "subtree_xattr"]) == (1, 0, 0, 0)
    # counters kept by differences are those of the rows that are left
    mounts = release.mounts_of(second).select("path", "catalog_path", F.lit(True).alias("m"))
    own = catalog.self_counters(second["catalog"].join(mounts, ["path", "catalog_path"], "left").where("m is null")).collect()
    assert all(n[r.catalog_path, f"self_{c}"] == r[f"self_{c}"] for r in own for c in catalog.SELF)
    p = properties(second)
    assert (p["", "revision"], p["/sub/in", "revision"], p["/sub/in", "last_modified"]) == ("1", "2", "200")
    points = lambda t: {r.path: r.sha1 for r in release.mounts_of(t).collect()}
    assert points(first)["/sub/in"] != points(second)["/sub/in"] is not None
    assert counters(release.open_release(spark, path, 1)) == counters(first)
    with pytest.raises(Exception, match="path twice"):
        release.upsert(first, plain.unionByName(plain))["catalog"].collect()


def test_new_catalog_has_all_tables(spark):
    fresh = build.new_catalog(spark)
    assert set(fresh) == set(release.TABLES) and fresh["chunks"].count() == fresh["bind_mountpoints"].count() == 0


def test_appends_are_read_in_their_order(spark, tmp_path):
    log = str(tmp_path / "uploads")
    rows = lambda *h: spark.createDataFrame([(k, x) for k, x in enumerate(h)], "k int, hash string").withColumn("at", F.to_timestamp(F.lit("2024-05-06 07:08:09")))
    assert [journals.append_upload_log(rows("b", "a", "b"), log, "k"), journals.append_upload_log(rows("c", "a"), log, "k")] == [0, 1]
    texts = [r.value for r in logs.lines(spark, log).orderBy("file", "line_no").collect()]
    assert texts[0] == '{"hash":"b","time":"2024-05-06T07:08:09Z"}' and len(texts) == 5
    assert {r.hash for r in logs.read_upload_log(spark, log).collect()} == {"a", "b", "c"}

    log = str(tmp_path / "txn")
    phase = lambda *p: spark.createDataFrame([(k, "t1", "r", x, None, None, None) for k, x in enumerate(p)], "k int, txn_id string, repo string, phase string, target_root_hash string, gc_pin string, at timestamp")
    journals.append_txn_log(phase("prepare", "warm"), log, "k")
    journals.append_txn_log(phase("commit"), log, "k")
    assert [r.phase for r in logs.read_txn_log(spark, log).orderBy("file", "seq").collect()] == ["prepare", "warm", "commit"]

    log = str(tmp_path / "journal")
    entry = spark.createDataFrame([("j1", "incoming", "staging", "r", "")], "job_id string, `from` string, `to` string, run_id string, note string").withColumn("t", F.to_timestamp(F.lit("2024-05-06 07:08:09")))
    journals.append_journal(entry, log, "job_id")
    assert [(r.job_id, r["to"]) for r in logs.read_journal(spark, log).collect()] == [("j1", "staging")]


def test_staging_paths(spark):
    cases = ["/stage/a.tar", "a.tar", "/stage/x/../b", "/stage/../etc/passwd", "/stage", "/stage2/a", "/etc", "../stage/c", "/stage//d/./e", "/stage/..f", "", "/../stage/g", None]
    rows = spark.createDataFrame([(c,) for c in cases], "p string")
    got = {r.p: r.q for r in rows.select("p", paths.staging_path("/stage/", F.col("p"), "/stage").alias("q")).collect()}
    for c in cases:
        full = posixpath.normpath(posixpath.join("/stage", c)) if c is not None else ""
        inside = full == "/stage" or (full.startswith("/stage/") and not full.startswith("/stage/.."))
        assert got[c] == (full if inside else None), c

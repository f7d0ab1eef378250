"""Literal cases of the scalar functions, codecs, chunks, rules and archives."""

import datetime as dt
import gzip
import io
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwerk.functions import bits, codecs, paths
from tarnwerk.operators import catalog, chunks, distribution
from tarnwerk.sources import archives, logs
from tarnwerk.streaming.state import Buckets, Leases


def values(spark, rows, expr, schema="a string, b string"):
    return [r.x for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema).orderBy("i").select(expr.alias("x")).collect()]


def test_paths(spark):
    good, bad = ["", "file.txt", "dir/file.txt", "a/b/c/d.so", "./file.txt"], ["/etc/passwd", "../secret", "foo/../../../etc/passwd", "a/../../b", ".."]
    assert values(spark, [(p, "") for p in good + bad], paths.valid_path(F.col("a"))) == [True] * 5 + [False] * 5
    good = [("dir/link", "sibling.so"), ("a/b/link", "../c/file"), ("a/b/link", "../../top"), ("link", "file.txt"), ("pkg/lib/libfoo.so", "../lib64/libfoo.so.1.0")]
    bad = [("link", ""), ("link", "/etc/passwd"), ("a/link", "../../evil"), ("link", "../evil"), ("a/b/link", "../../../evil"), ("l", "x/../../y")]
    assert values(spark, good + bad, paths.valid_symlink(F.col("a"), F.col("b"))) == [True] * 5 + [False] * 6
    assert values(spark, [(p, "") for p in ("", "/foo", "/foo/bar", "/a/b/c", "x")], paths.parent_path(F.col("a"))) == [None, "", "/foo", "/a/b", ""]
    assert values(spark, [(p, "") for p in ("", "/a", "/a/b/c")], paths.ancestors(F.col("a"))) == [[], [""], ["", "/a", "/a/b"]]
    assert values(spark, [(t, "") for t in ("v1.0.0", "", "a" * 255, "tag name", "v1/0/0", "a" * 256)], paths.valid_tag(F.col("a"))) == [True] * 3 + [False] * 3
    assert values(spark, [(s, "") for s in ("ok", "", "a/b", "a+", "#", "a\0b")], paths.valid_topic_segment(F.col("a"))) == [True] + [False] * 5
    assert values(spark, [(s, "") for s in ("exp/24", "/x/", "", "/")], paths.lease_path(F.col("a"))) == ["/exp/24", "/x", "", ""]
    assert values(spark, [("00aabb", ""), ("ab", ""), ("a", "")], paths.object_path(F.col("a"))) == ["data/00/aabb", "data/ab/", "data/00/a"]


def test_keys_and_bits(spark):
    lo, hi = bits.md5_path(F.col("a"))
    assert values(spark, [("", ""), ("/dir1", "")], lo) == [338333539836370388, 3166896040631616765]
    assert values(spark, [("", ""), ("/dir1", "")], hi) == [9098107892288553193, -9060999833566460932]
    assert values(spark, [("dir", 0o755), ("reg", 0o644), ("symlink", 0o777)], bits.unix_mode(F.col("a"), F.col("b")), "a string, b int") == [0o040755, 0o100644, 0o120777]
    flag = lambda **k: bits.entry_flags(F.col("a"), F.lit(0), F.lit(k.get("algo", 0)), F.lit(0), F.lit(k.get("nested", False)), F.lit(k.get("hidden", False)), F.lit(0))
    assert values(spark, [("reg", "")], flag(algo=2)) == [4 | 256] and values(spark, [("dir", ""), ("symlink", "")], flag()) == [1, 8]
    assert values(spark, [("reg", "")], flag(hidden=True)) == [4 | 32768] and values(spark, [("dir", "")], flag(nested=True)) == [1 | 32]
    assert values(spark, [(0, 1), (5, 3), (2, 0)], bits.pack_hardlinks(F.col("a"), F.col("b")), "a long, b long") == [1, 5 << 32 | 3, 2 << 32 | 1]
    assert values(spark, [(0, ""), (1023, ""), (1536, ""), (5 << 20, ""), (3 << 30, "")], paths.human_bytes(F.col("a")), "a long, b string") == ["—", "1023 B", "1.5 KB", "5.0 MB", "3.00 GB"]
    assert values(spark, [(-5, ""), (61_000, ""), (3_725_000, "")], paths.human_duration(F.col("a")), "a long, b string") == ["0s", "1m 1s", "1h 2m"]


def test_attribute_blobs_and_tokens():
    attrs = {"b": b"\x00\x01\xff\xfe", "a": b"", "c": b"x", "d": b"yy"}
    blob = codecs.pack_attributes(attrs)
    assert blob[:4] == b"\x04\0\0\0" and codecs.unpack_attributes(blob) == attrs
    assert codecs.pack_attributes({}) is codecs.pack_attributes(None) is None
    for bad in (b"\x01", b"\x01\0\0\0\x05", blob[:-1], blob + b"x"):
        with pytest.raises(ValueError):
            codecs.unpack_attributes(bad)
    token = codecs.sign_token({"exp": 100, "scope": "read"}, b"k")
    assert codecs.check_token(token, b"k", 130, "read")["exp"] == 100
    assert codecs.check_token(token, b"k", 131, "read") is codecs.check_token(token, b"k", 0, "write") is codecs.check_token(token, b"x", 0, "read") is codecs.check_token("junk", b"k", 0, "read") is None


def scalar_cuts(data, least, average, most):
    out, last, n = [], 0, len(data)
    if not least or n <= least:
        return out
    threshold = 0xFFFFFFFF // average
    while n - last > least:
        start, x, at = last + least, 0, None
        for i in range(start - 32, min(last + most, n)):
            x = (x << 1 ^ data[i]) & 0xFFFFFFFF
            away = ((x - (1 << 32) if x >> 31 else x) - 0x7FFFFFFF + (1 << 31)) % (1 << 32) - (1 << 31)
            if i >= start and (away if away == -(1 << 31) else abs(away)) < threshold:
                at = i
                break
        if at is None:
            if last + most > n:
                break
            at = last + most
        out.append(last := at)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_cuts_equal_the_byte_by_byte_form(seed):
    rng = np.random.default_rng(seed)
    for size in (10, 64, 65, 1000, 6000):
        data = rng.integers(0, 256, size, dtype=np.uint8).tobytes() if seed < 5 else b"\xff" * size
        for least, average, most in ((64, 128, 256), (32, 1000, 700), (64, 64, 64)):
            got = chunks.cuts(data, least, average, most)
            assert got == scalar_cuts(data, least, average, most)
            assert all(least <= b - a <= most for a, b in zip([0, *got], got))


def test_chunk_frames(spark):
    df = spark.createDataFrame([("a", b"chunk0chunk1chunk2"), ("b", b"tiny"), ("c", bytes(range(256)) * 9)], "path string, data binary")
    got = chunks.fixed(df, 6).where("path = 'a'").orderBy("idx").collect()
    assert [(r.idx, r.offset, r.size) for r in got] == [(0, 0, 6), (1, 6, 6), (2, 12, 6)]
    whole = chunks.content_defined(df, 64, 128, 256).groupBy("path").agg(F.sum("size").alias("n")).collect()
    assert {r.path: r.n for r in whole} == {"a": 18, "b": 4, "c": 2304}


def test_rules(spark):
    def hits(rules, *names):
        return values(spark, [(n, "") for n in names], catalog.matches(F.col("a"), catalog.parse_rules(rules)))

    assert hits("/software/releases/*", "/software/releases/2.1.1", "/software/releases/2.1.1/extra", "/software/releases", "/other/releases/foo") == [True, False, False, False]
    assert hits("# note\n\n/data/*\n! *.svn", "/data/run123", "/data/repo.svn") == [True, False]
    assert hits("software/releases/*", "/software/releases/v1", "software/releases/v1/") == [True, True]
    assert hits("/a[0-9]?/\\*x", "/a1b/*x", "/a1b/yx") == [True, False]
    with pytest.raises(ValueError, match="line 2"):
        catalog.parse_rules("/ok\n/bad/[pattern")


def archive(*members, pax=None):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as tar:
        for name, kind, body in members:
            m = tarfile.TarInfo(name)
            m.type = kind
            m.pax_headers = pax or {}
            if kind in (tarfile.LNKTYPE, tarfile.SYMTYPE):
                m.linkname = body
            elif body is not None:
                m.size = len(body)
            tar.addfile(m, io.BytesIO(body) if isinstance(body, bytes) else None)
    return out.getvalue()


REG, LNK, SYM, DIR, FIFO = tarfile.REGTYPE, tarfile.LNKTYPE, tarfile.SYMTYPE, tarfile.DIRTYPE, tarfile.FIFOTYPE


def test_archives(spark, tmp_path):
    raw = archive(("d", DIR, None), ("a.txt", REG, b"original"), ("b", LNK, "a.txt"), ("c", LNK, "b"), ("s", SYM, "d/x"), ("p", FIFO, None), pax={"SCHILY.xattr.user.k": "v", "SCHILY.xattr.": "no"})
    (tmp_path / "one.tar").write_bytes(raw)
    (tmp_path / "two.tar").write_bytes(gzip.compress(archive(("a.txt", REG, b"other"))))
    rows = archives.read_archives(spark, str(tmp_path)).collect()
    one = {r.path: r for r in rows if r.archive.endswith("one.tar")}
    assert [one[p].type for p in ("d", "a.txt", "b", "c", "s")] == ["dir", "reg", "reg", "reg", "symlink"] and "p" not in one
    assert {bytes(one[p].data) for p in "bc"} == {b"original"} and one["s"].link_target == "d/x" and dict(one["d"].xattrs) == {"user.k": b"v"}
    assert [r.path for r in archives.duplicate_paths(archives.read_archives(spark, str(tmp_path))).collect()] == ["a.txt"]
    for bad in (("x", LNK, "later"), ("x", LNK, ""), ("../x", REG, b""), ("x", SYM, "../y"), ("/x", REG, b"")):
        with pytest.raises(archives.ArchiveError):
            list(archives.entries(archive(bad)))
    with pytest.raises(archives.ArchiveError):
        list(archives.entries(archive(("big", REG, b"12345")), most=4))


def test_logs(spark, tmp_path):
    line = lambda d: spark.createDataFrame([(d,)], "p string").select(bits.crc_line(F.col("p")).alias("x")).first().x
    good = [line('{"job_id":"j%d","from":"incoming","to":"staging"}' % k) for k in range(2)]
    (tmp_path / "j").write_text("\n".join(good) + "\n")
    assert [(r.job_id, r.to) for r in logs.read_journal(spark, str(tmp_path / "j")).orderBy("line_no").collect()] == [("j0", "staging"), ("j1", "staging")]
    (tmp_path / "bad").write_text(good[0].replace("j0", "j9") + "\n")
    with pytest.raises(Exception, match="bad journal line"):
        logs.read_journal(spark, str(tmp_path / "bad")).collect()
    txn = lambda t, p: '{"txn_id":"%s","phase":"%s"}' % (t, p)
    (tmp_path / "t").write_text("\n".join([txn("1", "prepare"), txn("1", "warm"), txn("2", "prepare"), '{"txn_id":"2","ph']))
    assert [(r.txn_id, r.phase) for r in logs.read_txn_log(spark, str(tmp_path / "t")).orderBy("seq").collect()] == [("1", "prepare"), ("1", "warm"), ("2", "prepare")]
    (tmp_path / "t2").write_text("\n".join(["{torn", txn("1", "warm")]) + "\n")
    with pytest.raises(Exception, match="bad record"):
        logs.read_txn_log(spark, str(tmp_path / "t2")).collect()
    (tmp_path / "u").write_text('{"hash":"b"}\n{"hash":""}\n{"hash":"a"}\n{"hash":"b"}\n')
    assert [r.hash for r in logs.read_upload_log(spark, str(tmp_path / "u")).orderBy("line_no").collect()] == ["b", "a"]
    (tmp_path / "m").write_text('{"transaction_id":"t"}\n\n{"hash":"00aa","size":4}\n{"hash":"11bb","size":8,"suffix":"C"}\n')
    assert [(r.hash, r.size, r.suffix) for r in logs.read_ndjson_manifest(spark, str(tmp_path / "m")).orderBy("hash").collect()] == [("00aa", 4, None), ("11bb", 8, "C")]
    text = "C713ca8a74dd20682338da781e314ac2b8ce883e4-\nD3600\nNrepo.example.org\nS2\n--\nsignature"
    got = values(spark, [(text, "")], logs.parse_repo_manifest(F.col("a")))[0]
    assert (got.root[:6], got.algo, got.repo, int(got.revision), got.ttl) == ("713ca8", 2, "repo.example.org", 2, 3600)
    with pytest.raises(Exception, match="without root"):
        values(spark, [("Nrepo\n--", "")], logs.parse_repo_manifest(F.col("a")))


def test_leases_and_buckets():
    held = Leases(2, 1, 300)
    steps = [("acquire", "n1", "a"), ("acquire", "n1", "b"), ("acquire", "n2", "c"), ("acquire", "n3", "d"), ("release", "n1", "a"), ("acquire", "n3", "d")]
    assert [held.step(k, n, x, 0) for k, n, x in steps] == [True, False, True, False, True, True]
    held = Leases(1, 0, 300)
    assert held.step("acquire", "a", "x", 0) and not held.step("acquire", "b", "y", 300) and held.step("acquire", "b", "y", 300.1)
    b = Buckets(1, 2, 100, 100, 2)
    assert [b.allow("i", t) for t in (0, 0, 0, 1, 1)] == [True, True, False, True, False]
    b = Buckets(1, 9, 0, 1, 2)
    assert [b.allow(i, 0) for i in "xy"] == [True, False] and "y" not in b.by


def test_quorum(spark):
    replicas = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    t = [dt.datetime(2024, 1, 1, 0, k) for k in range(4)]
    acks = spark.createDataFrame([("x", "stranger", t[0]), ("x", "a", t[1]), ("x", "a", t[2]), ("x", "b", t[3]), ("y", "a", t[0])], "txn string, node string, at timestamp_ntz")
    got = {r.txn: (r.acks, r.reached_at) for r in distribution.quorum_reached(acks, replicas, 2).collect()}
    assert got == {"x": (2, t[3]), "y": (1, None)}
    assert all(r.reached_at is None for r in distribution.quorum_reached(acks, replicas, 0).collect())


def test_names_with_a_line_feed_at_the_end_are_refused(spark):
    rows = [("abc", ""), ("abc\n", "")]
    for check in (paths.valid_object_name, paths.valid_repo_name, paths.valid_tag):
        assert values(spark, rows, check(F.col("a"))) == [True, False]


def test_a_bad_line_that_ended_is_an_error(spark, tmp_path):
    (tmp_path / "t3").write_text('{"txn_id": "1", "phase": "prepare"}\n{torn\n')
    with pytest.raises(Exception, match="bad record"):
        logs.read_txn_log(spark, str(tmp_path / "t3")).collect()


def test_an_empty_scope_asks_for_none():
    token = codecs.sign_token({"exp": 100, "scope": "read"}, b"k")
    assert codecs.check_token(token, b"k", 50, "")["scope"] == "read"


def test_places_over_a_whole_table(spark):
    from tarnwerk.operators import order

    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"), F.lit("clash").alias("part")).repartition(7)
    got = {r.x: r.place for r in order.placed(df, F.desc("x")).collect()}
    assert got == {x: 5000 - x for x in range(5000)}
    assert order.placed(df.limit(0), "x").collect() == []

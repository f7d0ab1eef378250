import datetime as dt

import pytest

from tarnwerk.llm import rollup, urls


def changes(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "source string, lang string, tokenizer string, op string, n_tokens long, old_tokens long, docs string")


def totals(store):
    return sorted((tuple(r) for r in store.totals().collect()), key=str)


def test_batches_are_idempotent_and_additive(spark, tmp_path):
    store = rollup.Rollup(spark, str(tmp_path / "store"))
    assert totals(store) == []
    load = changes(spark, [("a", "en", "w", "insert", 5, None), ("a", "en", "w", "insert", 7, None), (None, None, "w", "insert", None, None), ("b", "de", "w", "insert", 3, None)])
    assert store.commit("one", load) and not store.commit("one", load)
    assert totals(store) == sorted([("a", "en", "w", 2, 12), (None, None, "w", 1, 0), ("b", "de", "w", 1, 3)], key=str)
    more = changes(spark, [("a", "en", "w", "revise", 1, 7), ("a", "en", "w", "delete", 5, None), ("b", "de", "w", "delete", 3, None)])
    assert store.commit("two", more) and not store.commit("two", more)
    want = sorted([("a", "en", "w", 1, 1), (None, None, "w", 1, 0)], key=str)
    assert totals(store) == want == totals(rollup.Rollup(spark, str(tmp_path / "store")))
    assert store.commit("empty", changes(spark, []))
    assert totals(store) == want


def test_failed_batches_leave_nothing(spark, tmp_path):
    store = rollup.Rollup(spark, str(tmp_path / "store"))
    with pytest.raises(Exception, match="unknown op"):
        store.commit("bad", changes(spark, [("a", "en", "w", "upsert", 5, None)]))
    assert not store.committed("bad") and totals(store) == []
    with pytest.raises(ValueError):
        store.commit("a/b", changes(spark, []))


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


ENTRIES = [
    ("domain", "Evil.com", "block", True, day(10)),
    ("host", "good.evil.com", "allow", True, day(20)),
    ("host", "good.evil.com", "allow", False, day(30)),
    ("host", "good.evil.com", "allow", True, day(40)),
    ("prefix", "good.evil.com/ads/", "block", True, day(45)),
    ("prefix", "x.org/a/b", "block", True, day(0)),
    ("host", "x.org", "block", True, day(5)),
    ("host", "x.org", "block", False, day(5)),
    (None, "x.org", "block", True, day(0)),
    ("host", None, "block", True, day(0)),
    ("host", "y.org", "block", True, None),
]


def brute(url, at):
    if url is None or at is None or "://" not in url:
        return ("allow", None, None, None)
    rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
    host, _, path = rest.partition("/")
    host, path = host.split("@")[-1].split(":")[0].lower().rstrip("."), ("/" + path if "/" in rest else "")
    if not host:
        return ("allow", None, None, None)
    parts = path.split("/")
    keys = [("domain", ".".join(host.split(".")[i:])) for i in range(len(host.split(".")) - 1, -1, -1)] + [("host", host)]
    keys += [("prefix", host + "/".join(parts[:i]) + "/") for i in range(1, max(2, len(parts)))] + [("prefix", host + path)]
    found = ("allow", None, None, None)
    for kind, value in keys:
        mine = [(e[4], e[3], e[2]) for e in ENTRIES if e[0] == kind and e[1] is not None and e[4] is not None and (e[1] if kind == "prefix" else e[1].lower()) == value and e[4] <= at]
        if mine and max(mine)[1]:
            found = (max(mine)[2], kind, value, max(mine)[0])
    return found


def test_captures_against_entries_of_their_time(spark):
    hosts = ["http://evil.com", "https://Good.Evil.com./ads/x?u=/q", "https://user@good.evil.com:80/ads", "http://a.good.evil.com/", "http://notevil.com/", "http://x.org/a/b", "http://x.org/a/b/c", "http://x.org", "ftp://y.org/#evil.com", "no url", "", None, "http:///a"]
    rows = [(k, u, day(d)) for k, u in enumerate(hosts) for d in (0, 5, 9, 10, 20, 29, 30, 44, 45, 400)] * 2 + [(None, hosts[0], None), (1, hosts[0], None)]
    df = spark.createDataFrame([(*r, "clash", "kept") for r in rows], "page_id long, url string, fetched_at timestamp, verdict string, kind string")
    entries = spark.createDataFrame(ENTRIES, "kind string, value string, verdict string, active boolean, at timestamp")
    out = urls.evaluate(df, entries)
    assert out.columns == ["page_id", "url", "fetched_at", "kind", "verdict", "matched_kind", "matched_value", "matched_from"]
    got = sorted(str((r.page_id, r.url, r.fetched_at, r.verdict, r.matched_kind, r.matched_value, r.matched_from)) for r in out.collect())
    assert got == sorted(str((*r, *brute(r[1], r[2]))) for r in rows)
    assert urls.evaluate(df.limit(0), entries).collect() == []
    assert {r.verdict for r in urls.evaluate(df, entries.limit(0)).collect()} == {"allow"}

"""The rule for list entries of kind prefix, as intervals() states it."""

import datetime

import pytest

from tarnwerk.llm import urls

DAY = datetime.datetime(2024, 1, 1)


@pytest.mark.parametrize(
    "prefix, blocked",
    [("example.com/foo", ["/foo", "/foo?q=/bar"]), ("example.com/foo/", ["/foo/", "/foo/bar", "/foo/bar/x"])],
)
def test_prefix_with_and_without_a_final_slash(spark, prefix, blocked):
    paths = ["", "/", "/foo", "/foo?q=/bar", "/foo/", "/foo/bar", "/foo/bar/x", "/foobar", "/foobar/x"]
    captures = spark.createDataFrame([(f"http://example.com{p}", DAY) for p in paths], "url string, fetched_at timestamp")
    entries = spark.createDataFrame([("prefix", prefix, "block", True, DAY)], "kind string, value string, verdict string, active boolean, at timestamp")
    got = {r.url.removeprefix("http://example.com") for r in urls.evaluate(captures, entries).collect() if r.verdict == "block"}
    assert got == set(blocked)

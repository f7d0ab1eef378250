"""A pair of lines that shares several buckets is compared in the first only, and linked."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwerk.llm import bucketlinks, lines


@pytest.mark.parametrize("sketch", [lines.sketches, None])
def test_a_pair_is_compared_in_one_bucket(spark, monkeypatch, sketch):
    rnd = random.Random(11)
    base, other, last = ("".join(rnd.choice("abcdefghij 漢") for _ in range(200)) for _ in range(3))
    texts = spark.createDataFrame([(1, base), (2, base[:100] + "#" + base[100:]), (3, other), (4, last)], "k long, line string")
    # all signatures agree; 3 shares most buckets and is the pivot, but like none
    bands = [(1, [10, 11, 12]), (2, [12, 11, 10]), (3, [10, 11, 12, 13]), (4, [13])]
    signed = spark.createDataFrame([(k, b, 0, 0, 0) for k, b in bands], "k long, bands array<long>, s0 long, s1 long, s2 long")
    fetch = lambda keys: texts.join(keys, "k", "left_semi")
    given, joined = [], bucketlinks._joined

    def seen(rows, *rest):
        given.extend(map(tuple, rows.select("bk", "k", "before").collect()))
        return joined(rows, *rest)

    monkeypatch.setattr(bucketlinks, "_joined", seen)
    edges = bucketlinks.linked(signed, fetch, 0.8, bucketlinks.Kind(36, lines.shingle_set, F.length, sketch=sketch)).collect()
    assert {tuple(sorted((e.k, e.p))) for e in edges} == {(1, 2)}
    apart = [(a, b) for a in given for b in given if a[0] == b[0] and a[1] == 1 and b[1] == 2 and not {*a[2]} & {*b[2]}]
    assert [(a[0], b[0]) for a, b in apart] == [(10, 10)]
    if sketch:
        assert sorted(x[:2] for x in given) == [(10, 1), (10, 2)]

"""Line dedup against brute force over the 5-character shingles at every position, with the bands in use."""

import random

import pytest
import test_lines
from test_lines import shingles


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("tile", [256, 3])
def test_short_lines_with_an_edit_within_a_word(spark, monkeypatch, tile):
    from tarnwerk.llm import bucketlinks, lines

    monkeypatch.setattr(lines, "BANDS", 16)
    monkeypatch.setattr(bucketlinks, "TILE", tile)
    rnd = random.Random(4)
    rows = []
    for k in range(60):
        line = " ".join("".join(rnd.choice("abcdefghijklmnop漢é") for _ in range(rnd.randrange(2, 10))) for _ in range(rnd.randrange(8, 18)))
        for v in range(3):
            at = rnd.randrange(len(line))
            rows.append((3 * k + v, line[:at] + "Z" * (v > 0) + line[at + (v > 0) :]))
    assert sum(jaccard(a, b) >= 0.8 for (_, a), (_, b) in zip(rows[::3], rows[1::3])) > 50
    assert test_lines.run(spark, rows) == test_lines.brute(rows)


def test_lines_that_differ_late_in_a_word_all_stay(spark):
    lines = ["card 4111111111111111", "card 4111111111119999", "00f1a2b3c4d5e6f7", "00f1a2b3c4d50918", "serial ABCDEFGHIJKL1234", "serial ABCDEFGHIJKL5678"]
    assert all(jaccard(a, b) < 0.8 for a in lines for b in lines if a != b)
    rows = [(k, x) for k, x in enumerate(lines)]
    assert test_lines.run(spark, rows) == [(str(k), x) for k, x in rows]


def test_recall_of_the_bands_in_use_right_above_the_threshold(spark):
    rnd = random.Random(6)
    rows, near = [], 0
    while near < 800:
        line = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200))
        other = list(line)
        for at in rnd.sample(range(200), 5):
            other[at] = "#"
        if 0.8 <= jaccard(line, "".join(other)) < 0.85:
            rows += [(2 * near, line), (2 * near + 1, "".join(other))]
            near += 1
    found = sum(t == "" for _, t in test_lines.run(spark, rows))
    print(f"{found} of {near} pairs at 0.80 to 0.85")
    assert found >= 0.987 * near


def short_lines(rnd, count):
    parts = ["th", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed"]
    return sorted({" ".join("".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(4, 8)))[:44] for _ in range(count)})


def test_unlike_short_lines_seldom_share_a_bucket(spark):
    """The pairs that meet grow with the square of the lines, so there must be few."""
    from pyspark.sql import functions as F

    from tarnwerk.llm import lines

    rows = [(k, x, "", "") for k, x in enumerate(short_lines(random.Random(7), 3000))]
    bands = lines.signatures(spark.createDataFrame(rows, test_lines.SCHEMA), "text", "doc_id").select("k", F.explode("bands").alias("bk"))
    met = bands.groupBy("bk").count().agg(F.sum(F.expr("count * (count - 1) div 2"))).first()[0]
    print(f"{met} pairs of {len(rows)} lines meet")
    assert met < 0.5 * len(rows)


def test_recall_on_short_lines_with_the_bands_in_use(spark):
    rnd = random.Random(8)
    rows, near = [], 0
    while near < 600:
        line = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(14, 44)))
        other = line + "".join(rnd.choice("0123456789") for _ in range(rnd.randrange(1, 10)))
        if 0.8 <= jaccard(line, other) < 0.85:
            rows += [(2 * near, line), (2 * near + 1, other)]
            near += 1
    found = sum(t == "" for _, t in test_lines.run(spark, rows))
    print(f"{found} of {near} pairs of short lines at 0.80 to 0.85")
    assert found >= 0.985 * near


def test_sketches_rule_out_unlike_lines_and_never_similar_ones(spark):
    from pyspark.sql import functions as F

    from tarnwerk.llm import bucketlinks, lines

    rnd = random.Random(10)
    rows = []
    for k in range(400):
        line = "".join(rnd.choice("abcdefgh \u6f22\U0001f600") for _ in range(rnd.choice([1, 3, 5, 6, 9, 40, 300, 3000])))
        line *= rnd.choice([1, 1, 3])
        other = list(line)
        for at in rnd.sample(range(len(line)), rnd.randrange(1 + len(line) // 20)):
            other[at] = rnd.choice("xyz")
        rows.append((k, line, "".join(other) + "z" * rnd.randrange(2)))
    df = spark.createDataFrame(rows, "k long, a string, b string")
    of = lambda side: lines.sketches(df.select("k", F.col(side).alias("line"))).select("k", F.struct("*").alias(side))
    may = bucketlinks._possible(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"), 0.8)
    left = {r.k: r.may for r in of("a").join(of("b"), "k").select("k", may.alias("may")).collect()}
    assert len(left) == len(rows)
    near = [k for k, a, b in rows if jaccard(a, b) >= 0.8]
    far = [k for k, a, b in rows if jaccard(a, b) < 0.6 and len(a) <= 300]
    assert len(near) > 100 and all(left[k] for k in near)
    assert len(far) > 20 and sum(left[k] for k in far) < 0.2 * len(far)


def test_members_that_are_near_are_marked_without_a_list_of_pairs(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tarnwerk.llm import bucketlinks

    made = []

    def rows_out(plan):
        kind = plan.getClass().getSimpleName()
        kids = plan.children()
        below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [kids.apply(i) for i in range(kids.size())]
        own = plan.metrics().get("numOutputRows")
        return max([own.get().value() if own.isDefined() else 0, *map(rows_out, below)])

    def run(df):
        got = df.collect()
        made.append(rows_out(df._jdf.queryExecution().executedPlan()))
        return spark.createDataFrame(got, df.schema)

    monkeypatch.setattr(bucketlinks, "cut", run)
    # bucket 1: all are near, in components of their own; 2: one outer and one inner member are near; 3: none are; 4: near within a component
    near = [(1, k, k, k == 0, 0) for k in range(600)]
    few = [(2, k, k if k > 8 else 1, k < 9, 7 if k in (3, 9) else 1 << k) for k in range(12)] + [(3, k, k, k == 0, 1 << k) for k in range(12)]
    same = [(4, k, 5, False, 0) for k in range(4)] + [(4, 9, 6, True, 1)]
    rows = spark.createDataFrame(near + few + same, "bk long, k long, c long, main boolean, s long")
    got = sorted(map(tuple, run(bucketlinks._marked(rows, ["s"], lambda x, y: F.col("ot_s") == F.col("mt_s"))).collect()))
    assert got == [(1, k) for k in range(600)] + [(2, 3), (2, 9)]
    assert 600 <= max(made) <= 600 * 10

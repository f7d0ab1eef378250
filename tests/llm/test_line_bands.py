"""Bands of line signatures: few unlike lines meet, which is what the work after them grows with."""

import random

import test_lines
from pyspark.sql import functions as F

from tarnwerk.llm import lines


def test_unlike_long_lines_seldom_share_a_bucket(spark):
    rnd = random.Random(12)
    parts = ["th", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha"]
    word = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4)))
    texts = [" ".join(word() for _ in range(rnd.randrange(100, 220))) for _ in range(2000)]
    sets = [test_lines.shingles(x) for x in texts[:60]]
    assert max(len(a & b) / len(a | b) for n, a in enumerate(sets) for b in sets[:n]) < 0.3
    rows = spark.createDataFrame([(k, x, "", "") for k, x in enumerate(texts)], test_lines.SCHEMA)
    bands = lines.signatures(rows, "text", "doc_id").select("k", F.explode("bands").alias("bk"))
    met = bands.groupBy("bk").count().agg(F.coalesce(F.sum(F.expr("count * (count - 1) div 2")), F.lit(0))).first()[0]
    print(f"{met} pairs of {len(texts)} lines meet")
    assert met < 1000000

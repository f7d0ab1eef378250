import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwerk.llm import simhash

SCHEMA = "doc_id long, text string, fp string, low string"


def brute(rows, budget=3, width=3):
    fps = [simhash.fingerprint(t.encode() if t is not None else None, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= budget:
                parent[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return sorted(((str(d), fps[i], str(low.get(find(i)))) for i, (d, _) in enumerate(rows)))


def run(spark, rows, **how):
    df = spark.createDataFrame([(d, t, "clash", "clash") for d, t in rows], SCHEMA)
    return sorted((str(r[0]), r[1] & (2**64 - 1), str(r[2])) for r in simhash.near_duplicates(df, **how).collect())


def test_fingerprint_matches_spark_hash(spark):
    text = "The  Quick\tbrown\x0bfox É jumps\nover"
    words = ["the", "quick", "brown", "fox", "É", "jumps", "over"]
    shingles = [" ".join(words[i : i + 3]) for i in range(5)]
    got = [r[0] & (2**64 - 1) for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()]
    want = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in got) > len(got))
    assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(b"") == simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0


def test_against_brute_force(spark):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(rnd.choice(words) for _ in range(120)) for _ in range(25)]
    rows = [(None, "lonely words here now"), (None, None), (7, None), (3, ""), (5, " \t"), (900, "one"), (901, "ONE"), (901, "ONE")]
    for k in range(150):
        t = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 2, 5])):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        rows.append((1000 - k, " ".join(t)))
    rows.append((2, "long " * 30000))
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("depth", [0, 1, 3, 7])
def test_trie_finds_all_links(spark, depth):
    rnd = np.random.default_rng(depth)
    base = rnd.integers(0, 2**63, 40, dtype=np.uint64)
    fps = {int(x) for x in base}
    for x in base:
        for _ in range(6):
            y = int(x)
            for bit in rnd.choice(64, rnd.integers(1, 5), replace=False):
                y ^= 1 << int(bit)
            fps.add(y)
    fps |= {0, 1, 3, 7, 15, 31, 2**64 - 1}
    fps = sorted(fps)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    from tarnwerk.llm.components import connected_components

    got = {(r[0], r[1]) for r in connected_components(simhash.linked_fingerprints(df, depth=depth)).collect()}
    of = dict(got)
    groups = {}
    for x in fps:
        s = x - 2**64 if x >= 2**63 else x
        groups.setdefault(of.get(s, s), set()).add(x)
    want = {frozenset(c) for c in components(fps)}
    assert {frozenset(c) for c in groups.values()} == want


def components(fps):
    left, out = set(fps), []
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            x = todo.pop()
            seen.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= 3}
            left -= near
            todo += near
        out.append(seen)
    return out


def test_walk_with_many_equal_leaves_in_small_memory(monkeypatch):
    monkeypatch.setattr(simhash, "LEAVES", 50)
    monkeypatch.setattr(simhash, "FRONTIER", 4)
    a = np.sort(np.concatenate([np.zeros(30, np.uint64), np.arange(40, dtype=np.uint64)]))
    forest = simhash.Forest(len(a))
    simhash.walk(a, None, 0, 0, 3, forest.link)
    assert len(forest.edges()[0]) == len(a) - 1


def test_keep_one_drops_all_but_the_smallest(spark):
    df = spark.createDataFrame([(4, "a b c d"), (2, "a b c d"), (9, "x y z w q"), (None, "a b c d")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in simhash.keep_one(df).collect()) == ["2", "9", "None"]


def test_keep_one_judges_rows_that_share_an_id_by_their_texts(spark):
    rows = [(2, "one two three four five six"), (5, "one two three four five six"), (5, "a text that nothing else resembles")]
    got = sorted((r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [rows[0], rows[2]]


def test_a_walk_takes_little_memory():
    rng = np.random.default_rng(4)
    halves = rng.integers(0, 1 << 16, (2, 1 << 17)).astype(np.uint64)
    halves[:, ::64] = halves[:, 1::64]
    halves[0, ::64] ^= np.uint64(5)
    keys = np.unique(halves[0] << np.uint64(48) | halves[1] << np.uint64(16))
    found = []
    tracemalloc.start()
    simhash.walk(keys, None, 0, 0, 3, lambda i, j: found.append(np.stack([keys[i], keys[j]])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    differ = keys[:500, None] ^ keys[None]
    near = np.triu(np.bitwise_count(differ) <= 3, 1)
    sure = near & (np.bitwise_count(differ >> np.uint64(32)) <= 1)  # the other walk finds the rest
    got = {(int(x), int(y)) for x, y in np.concatenate(found, 1).T if x <= keys[499]}
    pairs = lambda m: {(int(keys[i]), int(keys[j])) for i, j in np.argwhere(m)}
    assert set() < pairs(sure) <= got <= pairs(near)
    assert peak < 64 << 20

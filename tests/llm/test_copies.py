import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(rows, threshold=0.8):
    """The kept ids, and how many pairs of different texts are similar."""
    sets, of, near = [shingles(t) for _, t in rows], list(range(len(rows))), 0

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if both >= threshold * (len(a) + len(b) - both):
                of[find(i)] = find(j)
                near += rows[i][1] != rows[j][1]
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(str(d) for i, (d, _) in enumerate(rows) if d is None or d == low[find(i)]), near


def corpus(seed):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    rows = [(None, "lonely words here now"), (None, None), (7, None), (3, ""), (5, " \t"), (900, "one"), (901, "ONE"), (902, "a b c d e f"), (903, "a b c d e g")]
    for k in range(40):
        base = [rnd.choice(words) for _ in range(rnd.randrange(20, 300))]
        for v in range(4):
            t = base.copy()
            for at in rnd.sample(range(len(t)), min(len(t), v * len(t) // 100)):
                t[at] = rnd.choice(words)
            rows.append((2000 - 4 * k - v, " ".join(t)))
    return rows


@pytest.mark.parametrize("tile", [256, 2])
def test_stage_drops_what_brute_force_jaccard_drops(spark, monkeypatch, tile):
    from tarnwerk.llm import bucketlinks

    monkeypatch.setattr(bucketlinks, "TILE", tile)
    rows = corpus(5)
    want, near = brute(rows)
    assert near > 60
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    got = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert got.columns == df.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == want


def test_rows_that_share_an_id_lose_only_the_text_that_is_elsewhere(spark):
    rows = [(2, "one two three four five six"), (5, "one two three four five six"), (5, "a text that nothing else resembles"), (7, "twice the same row"), (7, "twice the same row")]
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect())
    assert got == [rows[0], rows[2], rows[3], rows[4]]


def test_no_rows(spark):
    assert corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([], SCHEMA), "").collect() == []


def test_the_tries_link_what_brute_force_links(spark):
    import numpy as np

    from tarnwerk.llm import simhash

    rnd = random.Random(2)
    keys = []
    for _ in range(150):
        x = rnd.getrandbits(32)
        keys += [x, x ^ 1 << rnd.randrange(32), x ^ sum(1 << b for b in rnd.sample(range(32), 3)), x ^ sum(1 << b for b in rnd.sample(range(32), 4))]
    signed = lambda x: int(np.uint64((x >> 16) << 48 | (x & 0xFFFF) << 16).view(np.int64))
    rows = [(0, signed(x), k, 0, 0 if k % 5 else -1) for k, x in enumerate(keys)]
    of = list(range(len(keys)))

    def find(k):
        return k if of[k] == k else find(of[k])

    same = {x: keys.count(x) > 1 for x in keys}
    for i, x in enumerate(keys):
        for j, y in enumerate(keys[:i]):
            if x == y or (x ^ y).bit_count() <= 3 and (same[x] or same[y] or (i % 5 > 0) == (j % 5 > 0)):
                of[find(i)] = find(j)
    df = spark.createDataFrame(rows, "t int, key long, k long, c0 long, c1 long")
    for node in (1 << 20, 16):
        got = list(range(len(keys)))
        at = lambda k: k if got[k] == k else at(got[k])
        for a, b in simhash.linked_keys(df, 3, 38, node).collect():
            got[at(a)] = at(b)
        assert len({(find(k), at(k)) for k in range(len(keys))}) == len({find(k) for k in range(len(keys))}) == len({at(k) for k in range(len(keys))})

import random

import pytest

from tarnwerk.llm import packing

SIZES = (8, 16, 64)


def brute(lengths, sizes, cost=packing.token_cost):
    """Best fit one piece at a time; of bins with equal room the one that has had it longest."""
    lengths, bins, out = sorted(lengths, reverse=True), [], []
    k = 0
    while k < len(lengths):
        n = lengths[k]
        fits = [b for b in bins if b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: (b[0], b[2]))
        else:
            left = sum(x == n for x in lengths[k:])
            usable = [s for s in sizes if s >= n]
            size = min(usable, key=lambda s: (cost(s) / (s // n * n), -s))
            if left < size // n:
                size = min((s for s in usable if s // n >= left), key=lambda s: (cost(s), s))
            b = [size, [], 0]
            bins.append(b)
        b[0] -= n
        b[1].append(n)
        b[2] = k
        k += 1
    return sorted(sorted(b[1]) for b in bins)


def contents(p, histogram, sizes):
    import numpy as np

    places = packing.Places(p, sizes)
    bins = {}
    for length, n in histogram.items():
        got = places(np.full(n, length), np.arange(n))
        for b, offset, size, held in zip(*(x.tolist() for x in got)):
            bins.setdefault(b, []).append((offset, length, size, held))
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_best_fit_piece_by_piece(seed):
    rnd = random.Random(seed)
    lengths = [rnd.choice([rnd.randrange(1, 65), rnd.randrange(1, 12), 64, 7]) for _ in range(rnd.choice([1, 5, 60, 400]))]
    histogram = {x: lengths.count(x) for x in lengths}
    bins = contents(packing.plan(histogram, SIZES), histogram, SIZES)
    assert sorted(bins) == list(range(len(bins)))
    assert sorted(sorted(x[1] for x in b) for b in bins.values()) == brute(lengths, SIZES)
    for b in bins.values():
        at = 0
        for offset, length, size, held in sorted(b):
            assert offset == at and held == sum(x[1] for x in b)
            at += length
            assert size == min(s for s in SIZES if s >= held)


def test_rows(spark):
    rnd = random.Random(1)
    data = [(k, rnd.choice([0, None, 3, 3, 3, 20, 64, 200, 1000])) for k in range(700)] + [(None, 5), (None, 5), (3, 9), (3, 9)]
    df = spark.createDataFrame([(i, n, 1) for i, n in data], "doc_id long, n long, bin_id int")
    got = packing.pack(df, "doc_id", "n", SIZES).collect()
    total = {}
    for r in got:
        assert (r.bin_id is None) == (r.n_tokens == 0)
        total.setdefault(r.doc_id, []).append(r.n_tokens)
    want = {}
    for i, n in data:
        want.setdefault(i, []).append(n or 0)
    assert {k: sum(v) for k, v in total.items()} == {k: sum(v) for k, v in want.items()}
    bins = {}
    for r in got:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append((r.bin_offset, r.n_tokens, r.bin_size, r.bin_tokens))
    for b in bins.values():
        at = 0
        for offset, n, size, held in sorted(b):
            assert offset == at
            at += n
            assert held == sum(x[1] for x in b) and size == min(s for s in SIZES if s >= held)
    pieces = [r.n_tokens for r in got if r.n_tokens]
    assert sorted(sorted(x[1] for x in b) for b in bins.values()) == brute(pieces, SIZES)
    long = sorted((r.piece, r.start, r.n_tokens) for r in got if r.doc_id == next(i for i, n in data if n == 200))
    assert long == [(0, 0, 64), (1, 64, 64), (2, 128, 64), (3, 192, 8)]


def test_texts_and_empty(spark):
    df = spark.createDataFrame([(1, " a b\tc\x0bd "), (2, None), (3, ""), (4, "x " * 9000)], "doc_id long, text string")
    got = sorted((r.doc_id, r.piece, r.n_tokens) for r in packing.pack_texts(df).collect())
    assert got == [(1, 0, 4), (2, 0, 0), (3, 0, 0), (4, 0, 4096), (4, 1, 4096), (4, 2, 808)]
    assert packing.pack_texts(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        packing.plan({65: 1}, SIZES)

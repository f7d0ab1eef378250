import numpy as np
import pytest

from tarnwerk.llm import topk, vectors

SCHEMA = "vec_id long, embedding array<float>, node long, v string"
ODD = [None, [], [0.0] * 8, [1.0] * 7 + [None], [float("nan")] + [1.0] * 7, [float("inf")] + [0.0] * 7, [1.0, 0.0]]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], SCHEMA)


def sample(n=400, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    for k in range(0, n, 3):
        x[k] = x[(k * 7) % n] + 0.15 * rng.standard_normal(dim).astype(np.float32)
    x[5:25] = x[4]
    x[30] = 3 * x[31]
    return x


def brute(rows, threshold=0.9):
    good = [(k, np.array(v, np.float64)) for k, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    links = {k: set() for k in range(len(rows))}
    for a, x in good:
        for b, y in good:
            if a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a].add(b)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        low = min((rows[s][0] for s in seen if rows[s][0] is not None), default=None)
        out.append((str(i), len(links[k]), str(low), i is not None and i == low))
    return sorted(out)


@pytest.mark.parametrize("tile", [4096, 7])
def test_dedup_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    monkeypatch.setattr(vectors, "BLOCK", 9)
    monkeypatch.setattr(vectors, "PAIRS", 11)
    rows = [(1000 - k, v.tolist()) for k, v in enumerate(sample())] + [(2000 + k, v) for k, v in enumerate(ODD)]
    rows += [(None, rows[0][1]), (rows[3][0], rows[3][1]), (3000, [1.0, 0.1]), (3001, [1e-30, 1e-31])]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in vectors.near_duplicates(frame(spark, rows), recall=0.999999).collect())
    assert got == brute(rows)


def test_dedup_empty(spark):
    assert vectors.near_duplicates(frame(spark, [])).collect() == []


def ranked(rows, every=50, k=5):
    good = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()})
    w = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in good]
    out = []
    for q in sorted({i for i, _ in w if i % every == 0}):
        score = {}
        for qi, x in w:
            for c, y in w:
                if qi == q and c != q:
                    s = sum(a * b for a, b in zip(x, y))
                    score[c] = max(score.get(c, s), s)
        out += [(q, r + 1, c, s) for r, (c, s) in enumerate(sorted(score.items(), key=lambda t: (-t[1], t[0]))[:k])]
    return out


@pytest.mark.parametrize("sizes", [(256, 64, 2048), (4, 3, 5)])
def test_top_k_against_brute_force(spark, monkeypatch, sizes):
    for name, size in zip(("BLOCK", "SUPER", "QUERIES"), sizes):
        monkeypatch.setattr(topk, name, size)
    rows = [(10 * k, v.tolist()) for k, v in enumerate(sample(150))] + [(2001 + k, v) for k, v in enumerate(ODD)]
    rows += [(None, rows[0][1]), rows[10], (100, rows[3][1]), (7, rows[3][1])]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted(tuple(r) for r in topk.top_k(frame(spark, rows)).collect())
    assert got == ranked(rows)


def test_top_k_small_tables(spark):
    assert topk.top_k(frame(spark, [])).collect() == []
    assert topk.top_k(frame(spark, [(50, [1.0])])).collect() == []
    assert [tuple(r) for r in topk.top_k(frame(spark, [(50, [1.0]), (1, [-0.5])])).collect()] == [(50, 1, 1, -128 * 256)]


def test_large_weights_are_exact():
    a, b = np.array([[1 << 40, -(1 << 40), 3]]), np.array([[1 << 13, 1 << 13, 1], [1 << 21, 0, 5]])
    assert topk.product(a, b).tolist() == [[3, (1 << 61) + 15]]
    assert topk.product(a << 10, b << 30).max() == 1 << 62


def test_pruning_skips_blocks_and_keeps_ties():
    rng = np.random.default_rng(0)
    w = np.sort(rng.integers(-50, 50, (40 * topk.BLOCK, 1)), axis=0)
    w = np.hstack([w, np.ones_like(w)])
    ids = rng.permutation(len(w))
    cuts = np.arange(0, len(w), topk.BLOCK)
    q = np.array([[5, 1], [-5, 0]])
    found = topk.search(np.array([-1, -2]), q, np.full(2, topk.LOW), ids, w, np.maximum.reduceat(w, cuts), np.minimum.reduceat(w, cuts), 5)
    assert found[4] < 12
    s = w @ q.T
    for k in range(2):
        want = sorted(zip((-s[:, k]).tolist(), ids.tolist()))[:5]
        assert [(-x, i) for i, x in zip(found[1][found[0] == k].tolist(), found[2][found[0] == k].tolist())] == want

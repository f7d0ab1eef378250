import random

import pytest

from tarnwerk.llm import bucketlinks, lines

SCHEMA = "doc_id long, text string, k string, pos string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "clash", "clash") for d, t in rows], SCHEMA)


def shingles(line):
    return {line[i : i + 5] for i in range(max(len(line) - 4, 1))}


def brute(rows, threshold=0.8):
    texts = sorted({x for _, t in rows for x in (t or "").split("\n") if x.strip(" ")})
    sets, of = {x: shingles(x) for x in texts}, {x: x for x in texts}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[:i]:
            both = len(sets[a] & sets[b])
            if both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                of[find(a)] = find(b)
    first = {}
    places = [(d, p, x) for d, t in rows for p, x in enumerate((t or "").split("\n")) if x.strip(" ")]
    for d, p, x in sorted(places, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        first.setdefault(find(x), (d, p))
    out = []
    for d, t in rows:
        if t is not None and d is not None:
            t = "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip(" ") or first[find(x)] == (d, p))
        out.append((str(d), t))
    return sorted(out, key=str)


def run(spark, rows):
    out = lines.dedup_lines(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "k", "pos"]
    return sorted(((str(r.doc_id), r.text) for r in out.collect()), key=str)


def corpus(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéü漢") for _ in range(rnd.randrange(1, 9))) for _ in range(400)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(25, 60))) for _ in range(30)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(rnd.randrange(6)):
            w = rnd.choice(base).split(" ")
            if rnd.random() < 0.6:
                w[rnd.randrange(len(w))] = rnd.choice(words)
            text.append(" ".join(w) if rnd.random() < 0.8 else " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 30))))
            if rnd.random() < 0.2:
                text.append(rnd.choice(["", "  "]))
        rows.append((d, "\n".join(text)))
    return rows


@pytest.fixture
def many_bands(monkeypatch):
    """So many that no pair of these small corpora is missed, which is a matter of chance otherwise."""
    monkeypatch.setattr(lines, "BANDS", 16)


@pytest.mark.parametrize("tile", [256, 3])
def test_against_brute_force(spark, monkeypatch, many_bands, tile):
    monkeypatch.setattr(bucketlinks, "TILE", tile)
    run_of = "QWxhZGRpbjpvcGVuIHNlc2FtZQ" * 20
    rows = corpus(1) + [(None, "kept by a row without id\nagain"), (500, "again"), (None, None), (501, None), (502, ""), (503, "\n\n"), (504, run_of), (505, run_of[:12] + "zz" * 300), (506, run_of + "x")]
    rows += [(600, "twice the same row\nwith two lines"), (600, "twice the same row\nwith two lines"), (601, "漢字仮名交じり文の長い行" * 9), (602, "違う" + "漢字仮名交じり文の長い行" * 9)]
    assert run(spark, rows) == brute(rows)


def test_long_chain_of_variants_is_one_class(spark, many_bands):
    words = [f"word{k}" for k in range(60)]
    rows = []
    for k in range(40):
        words = words.copy()
        words[k] = f"new{k}"
        rows.append((k, " ".join(words)))
    assert run(spark, rows) == brute(rows)


def test_recall_with_the_bands_in_use(spark):
    rnd = random.Random(9)
    rows = []
    for k in range(300):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(60)]
        other = words.copy()
        for at in rnd.sample(range(60), 2):
            other[at] = f"x{rnd.randrange(10**6)}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    near = sum(len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b)) for (_, a), (_, b) in zip(rows[::2], rows[1::2]))
    assert near > 250
    assert sum(t == "" for _, t in run(spark, rows)) >= 0.97 * near


def test_empty_and_counts(spark):
    assert run(spark, []) == []
    out = lines.dedup_lines(frame(spark, [(1, "a b\na b\n\nc"), (2, None)]), counts=True)
    assert sorted((r.doc_id, r.text, r._lines, r._dropped) for r in out.collect()) == [(1, "a b\n\nc", 4, 1), (2, None, 0, 0)]


def test_only_builtin_functions_run(spark):
    plan = lines.dedup_lines(frame(spark, corpus(2)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

"""Each stage against brute force on what the stage before it returned, and the run as a whole."""

import random

import test_lines
import test_simhash

import corpus_pipeline
from tarnwerk.llm import langid, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs():
    rnd = random.Random(8)
    words = {"en": ["the", "house", "river", "with", "stone", "under", "morning", "light", "every", "small"], "de": ["der", "haus", "fluss", "mit", "stein", "unter", "morgen", "licht", "jeder", "klein"]}
    text = lambda lang, n: " ".join(rnd.choice(words[lang]) + rnd.choice(["", "s", "en", "er"]) + str(rnd.randrange(40)) for _ in range(n))
    rows = []
    for k in range(80):
        lang = rnd.choice(["en", "de"])
        rows.append((k, "\n".join(text(lang, rnd.randrange(10, 40)) for _ in range(rnd.randrange(1, 4))), lang, f"s{k % 3}", 0))
    rows += [(100 + k, rows[k][1], rows[k][2], "copy", 0) for k in range(10)]
    rows += [(200, "12345 !!", "en", None, 0), (201, None, "en", "s", None), (202, "", None, "s", 0), (203, "the house " * 4000, None, None, 0), (None, "the river with stone", "en", "s", 0), (204, "a", "en", "s", 0), (204, "a", "en", "s", 0)]
    return rows


def pairs(rows):
    return [(r.doc_id, r.text) for r in rows]


def test_stages_against_brute_force(spark, monkeypatch):
    from tarnwerk.llm import lines

    monkeypatch.setattr(lines, "BANDS", 16)
    df = spark.createDataFrame(docs(), SCHEMA)
    steps = [f for _, f in corpus_pipeline.STAGES]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "packing"]
    first = steps[0](spark, df, "")
    predict = langid.Predictor(langid.fit(df))
    assert first.columns == df.columns
    one = first.collect()
    assert sorted(map(str, pairs(one))) == sorted(str((d, t)) for d, t, *_ in docs() if predict(t)[0] != "und" and predict(t)[1] >= 0.3)
    assert {200, 201, 202}.isdisjoint(r.doc_id for r in one) and len(one) == len(docs()) - 3

    second = steps[1](spark, spark.createDataFrame(one, SCHEMA), "")
    assert second.columns == df.columns
    two = second.collect()
    assert sorted(((str(r.doc_id), r.text) for r in two), key=str) == test_lines.brute(pairs(one))
    assert all(r.n_chars == len(r.text) for r in two)

    third = steps[2](spark, spark.createDataFrame(two, SCHEMA), "")
    assert third.columns == df.columns
    three = third.collect()
    keep = {d for d, _, low in test_simhash.brute(pairs(two), width=5) if d in (low, "None")}
    assert sorted(str(r.doc_id) for r in three) == sorted(str(r.doc_id) for r in two if str(r.doc_id) in keep)

    four = steps[3](spark, spark.createDataFrame(three, SCHEMA), "").collect()
    total = {}
    for r in four:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    want = {}
    for d, t in pairs(three):
        want[d] = want.get(d, 0) + len(t.encode().split())
    assert total == want
    bins = {}
    for r in four:
        if r.bin_id is not None:
            bins[r.bin_id] = bins.get(r.bin_id, 0) + r.n_tokens
    assert all(n <= max(packing.SIZES) for n in bins.values())


def test_run_and_empty_table(spark, tmp_path):
    spark.createDataFrame(docs(), SCHEMA).write.parquet(str(tmp_path / "a/documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    assert len({r.doc_id for r in out}) > 70
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "b/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).collect() == []

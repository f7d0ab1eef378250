import random
import zlib

import pytest

from tarnwerk.llm import langid

SYLLABLES = {"en": "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split(), "de": "en er ch de ei ie in te ge un nd ich ver sch ung der hei gen aus auf äu öß ür be".split(), "xx": "ka ki ku ke ko sa shi su se so ta chi tsu te to na ni nu ne no ha hi fu he ho".split()}


def text(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(n)).capitalize() + "."


def rows(n=600):
    rnd = random.Random(0)
    return [(k, text(rnd, lang := rnd.choice(list(SYLLABLES)), rnd.randrange(8, 60)), lang, "src") for k in range(n)]


ODD = [(None, "then there in the another", None, None), (9001, None, "en", None), (9002, "", "en", None), (9003, "123 !? ½ 44", "en", None), (9004, "漢字", "en", None), (9005, "the " * 100_000, None, None), (9005, "the " * 100_000, None, None)]
SCHEMA = "doc_id long, text string, lang string, score string"


def test_held_out_accuracy_and_defined_cases(spark):
    data = rows()
    docs = spark.createDataFrame(data + ODD, SCHEMA)
    got = langid.identify(docs, langid.fit(docs)).collect()
    assert len(got) == len(data) + len(ODD)
    by = {r.doc_id: r for r in got}
    out = [d for d in data if zlib.crc32(str(d[0]).encode()) % 4 == 2]
    assert all(by[d[0]].held_out == (zlib.crc32(str(d[0]).encode()) % 4 == 2) for d in data)
    assert sum(by[d[0]].lang_pred == d[2] for d in out) >= 0.97 * len(out) > 100
    assert all(0 <= r.score <= 1 for r in got)
    assert [(by[k].lang_pred, by[k].score) for k in (9001, 9002, 9003)] == [("und", 0.0)] * 3
    assert by[9004].lang_pred in SYLLABLES and by[9005].lang_pred == by[None].lang_pred == "en"
    assert by[None].held_out is False
    kept = langid.keep_identified(docs, langid.fit(docs))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(by) - {9001, 9002, 9003}


def test_held_out_rows_teach_nothing(spark):
    out = [k for k in range(300) if zlib.crc32(str(k).encode()) % 4 == 2]
    docs = spark.createDataFrame([(k, "zork zork", "only", "") for k in out] + [(k, "plain words", "en", "") for k in range(300) if k not in out], SCHEMA)
    model = langid.fit(docs)
    assert model.langs == ["en"] and "zork" not in model.words


def test_backoff():
    import numpy as np

    model = langid.Model(["a", "b"], np.zeros(2), {"known": np.array([1.0, -1.0])}, {n: {} for n in langid.LENGTHS})
    model.grams[3]["abc"] = np.array([-2.0, 2.0])
    model.grams[1]["q"] = np.array([4.0, -4.0])
    assert model.vector("known").tolist() == [1, -1]
    assert model.vector("xabcq").tolist() == pytest.approx([-2 * 0.7**3, 2 * 0.7**3])
    assert model.vector("qx").tolist() == pytest.approx([4 * 0.7**5, -4 * 0.7**5])
    assert model.vector("zz").tolist() == [0, 0]


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert langid.identify(docs, langid.fit(docs)).collect() == []
    docs = spark.createDataFrame([(1, "some text", None, "")], SCHEMA)
    assert langid.identify(docs, langid.fit(docs)).first().lang_pred == "und"

"""Snapshots, racing writers and vocabulary files of the rollup store."""

from tarnwerk.llm import bpe, rollup


def changes(spark, *rows):
    return spark.createDataFrame(rows, "source string, lang string, tokenizer string, op string, n_tokens long, old_tokens long")


def totals(store):
    return sorted((tuple(r) for r in store.totals().collect()), key=str)


def test_totals_read_the_snapshot_and_what_came_after(spark, tmp_path):
    store = rollup.Rollup(spark, str(tmp_path / "store"))
    store.compact()
    assert totals(store) == []
    store.commit("one", changes(spark, ("a", "en", "w", "insert", 5, None), ("b", None, "w", "insert", 2, None)))
    store.commit("two", changes(spark, ("a", "en", "w", "insert", 7, None)))
    before = totals(store)
    store.compact()
    assert totals(store) == before == [("a", "en", "w", 2, 12), ("b", None, "w", 1, 2)]
    assert not store.commit("one", changes(spark, ("a", "en", "w", "insert", 5, None)))
    store.commit("three", changes(spark, ("b", None, "w", "delete", 2, None), ("a", "en", "w", "revise", 1, 7)))
    assert totals(store) == [("a", "en", "w", 2, 6)]
    for _ in range(2):
        store.compact()
        assert totals(rollup.Rollup(spark, store.path)) == [("a", "en", "w", 2, 6)]
    # the covered batches aren't read again
    assert not any("batch=" in f for f in store._sums()[0].inputFiles())


def test_the_slower_of_two_writers_adds_nothing(spark, tmp_path, monkeypatch):
    one, two = (rollup.Rollup(spark, str(tmp_path / "store")) for _ in range(2))
    late = changes(spark, ("a", "en", "w", "insert", 5, None))
    seen = iter([False, False, True, True])
    monkeypatch.setattr(two, "committed", lambda batch: next(seen))
    assert one.commit("x", late)
    assert two.commit("x", late) is False
    assert totals(one) == [("a", "en", "w", 1, 5)]


def test_vocabulary_files_are_versions(spark, tmp_path):
    rows = [(1, "a", "en", "Some words, and some more words."), (2, "a", "en", None), (3, "b", "de", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    store = rollup.Rollup(spark, str(tmp_path / "store"))
    store.commit("load", rollup.inserts(docs))
    n = {r.doc_id: r.n_tokens for r in bpe.digests(docs).collect()}
    version = bpe.default_path().rsplit("/", 1)[-1]
    assert totals(store) == [("a", "en", version, 2, n[1]), ("b", "de", version, 1, 0)] and n[1] > 0
    store.commit("gone", rollup.inserts(docs, op="delete"))
    assert totals(store) == []


def test_encode_over_the_text_itself(spark):
    docs = spark.createDataFrame([(k, "word " * k, "clash") for k in range(3000)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.encode(docs, out="text").collect()}
    want = {r.doc_id: r for r in bpe.encode(docs).collect()}
    assert len(got) == 3000 and got[7].asDict().keys() == {"doc_id", "ids", "text"} and got[7].ids == "clash"
    assert all(got[k].text == want[k].ids for k in got)
    assert {r.doc_id: r.n_tokens for r in bpe.count_tokens(docs).collect()} == {k: len(want[k].ids) for k in want}

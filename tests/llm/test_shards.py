import random
import zlib

from tarnwerk.llm import shards


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, slot string, shard int")


def test_contract(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(k, "é" * rnd.choice([1, 5, 40, 900])) for k in range(3000)] + [(k, "same text") for k in range(3000, 4500)]
    rows += [(None, None), (None, ""), (9000, None), (17, "twice"), (17, "twice"), (9001, "x" * 200_000)]
    got = shards.assign(docs(spark, rows), path=str(tmp_path / "map")).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    load = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(load) - min(load) <= 2 or max(load) > 200_000
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    of = {}
    assert all(of.setdefault(r.virtual_slot, r.shard) == r.shard for r in got)
    stored = shards.load(spark, str(tmp_path / "map"))
    assert stored.version == 2 and all(stored.shard[v] == s for v, s in of.items())
    assert shards.load(spark, str(tmp_path / "map"), 1) == shards.SlotMap.first(8)


def test_same_rows_get_the_same_slots_in_any_order(spark):
    rows = [(k, "x" * (k % 37)) for k in range(500)]
    a = {r.doc_id: (r.shard, r.slot) for r in shards.assign(docs(spark, rows)).collect()}
    assert a == {r.doc_id: (r.shard, r.slot) for r in shards.assign(docs(spark, rows[::-1]).repartition(3)).collect()}


def test_empty(spark):
    assert shards.assign(docs(spark, [])).collect() == []


def test_map_edits():
    rnd = random.Random(6)
    size = [rnd.choice([0, 3, 50, 1000, 7777]) for _ in range(shards.SLOTS)]
    first = shards.SlotMap.first(8)
    second = first.rebalanced(size)
    load = second.loads(size)
    assert max(load) - min(load) <= 1e-4 * sum(load) / 8
    assert 0 < len(second.moved) < 400 and all(first.shard[s] != second.shard[s] for s in second.moved)
    third = second.grown(size, 9)
    assert all(b in (a, 8) for a, b in zip(second.shard, third.shard))
    load = third.loads(size)
    assert abs(load[8] - sum(load) / 9) < 8000 and third.version == 3
    # one slot heavier than all others together
    assert shards.SlotMap.first(4, 8).rebalanced([1, 1000, 1, 1, 1, 1, 1, 1]).loads([1, 1000, 1, 1, 1, 1, 1, 1]).count(1000) == 1

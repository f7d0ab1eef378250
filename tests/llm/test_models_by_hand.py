"""Shards and languages held against models of their own, written without the operators."""

import math
import random
import re
import struct
import zlib

import xxhash

from tarnwerk.llm import langid, shards

SLOTS = 8192


def long_hash(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_shards_by_hand(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(k, "x" * rnd.choice([0, 3, 200]) + str(k % 50)) for k in range(6000)] + [(None, None), (None, "é"), (5, "again"), (5, "again"), (9999, None), (10000, "long " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.size, r.text_crc32, r.virtual_slot, r.shard, r.slot) for r in shards.assign(docs, path=str(tmp_path / "map")).collect())
    shard_of = shards.load(spark, str(tmp_path / "map")).shard
    slots = {}
    for i, t in rows:
        raw = (t or "").encode()
        size, crc = len(raw) + 1, zlib.crc32(raw)
        v = (long_hash(i) if i is not None else long_hash(crc, size)) % SLOTS
        slots.setdefault(v, []).append((i is not None, i or 0, crc, size))
    want, filled, load = [], [0] * 8, [0] * 8
    for v in sorted(slots):
        for known, i, crc, size in sorted(slots[v]):
            to = shard_of[v]
            want.append((str(i if known else None), size, crc, v, to, filled[to]))
            filled[to] += 1
            load[to] += size
    assert got == sorted(want)
    assert max(load) - min(load) <= max(150_001, 0.01 * sum(load))


def words_of(text):
    return re.findall(r"[^\W\d_]+", text.lower())


def pieces(word, n):
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def test_languages_by_hand(spark):
    rnd = random.Random(3)
    parts = {"en": ["th", "er", "on", "an", "re", "he"], "de": ["en", "er", "ch", "de", "ei", "ie"], "xx": ["ka", "ki", "er", "ke", "on"]}
    word = lambda lang: "".join(rnd.choice(parts[lang]) for _ in range(rnd.randrange(1, 5)))
    rows = [(k, " ".join(word(lang) for _ in range(rnd.randrange(1, 9))), lang) for k in range(500) for lang in [rnd.choice(["en", "en", "de", "xx"])]]
    rows += [(600, "Then zzq onkaki", None), (601, "12 3", "en"), (602, None, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taught = [r for r in rows if r[1] is not None and r[2] and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    langs = sorted({r[2] for r in taught})
    seen = {}
    for _, t, lang in taught:
        for w in words_of(t):
            for n, g in [(0, w)] + [(n, g) for n in range(1, 6) for g in pieces(w, n)]:
                seen.setdefault(n, {}).setdefault(g, dict.fromkeys(langs, 0))[lang] += 1
    logs = {}
    for n, by in seen.items():
        by = {g: {x: c[x] + 0.5 if c[x] else 0.5 for x in langs} for g, c in by.items() if sum(c.values()) >= 2}
        whole = {x: sum(c[x] for c in by.values()) for x in langs}
        for g, c in by.items():
            raw = [math.log(c[x] / whole[x]) for x in langs]
            logs[n, g] = [v - sum(raw) / len(raw) for v in raw]

    def vector(w):
        if (0, w) in logs:
            return logs[0, w]
        for step, n in enumerate((5, 4, 3, 2, 1), 1):
            if known := [logs[n, g] for g in pieces(w, n) if (n, g) in logs]:
                return [0.7**step * sum(k[i] for k in known) / len(known) for i in range(len(langs))]
        return [0.0] * len(langs)

    got = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    unseen = 0
    for k, t, _ in rows:
        words = words_of(t or "")
        if not words:
            assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
            continue
        unseen += any((0, w) not in logs for w in words)
        total = [math.log(sum(r[2] == x for r in taught) / len(taught)) + sum(vector(w)[i] for w in words) for i, x in enumerate(langs)]
        share = 1 / sum(math.exp(v - max(total)) for v in total)
        assert got[k].lang_pred == langs[total.index(max(total))], k
        assert abs(got[k].score - share) < 1e-4
    assert unseen > 20

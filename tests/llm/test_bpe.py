import hashlib
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarnwerk.llm import bpe

LIB = Tokenizer.from_file(bpe.default_path())
CODEC = bpe.codec(open(bpe.default_path(), "rb").read())


def lib(text):
    return LIB.encode(text, add_special_tokens=False).ids


def own(texts):
    return [x.tolist() for x in CODEC.encode(texts)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sre\x85\xa0\x1c　aé1.<|>"))), max_size=4))
def test_equals_the_library(texts):
    assert own(texts) == [lib(t) for t in texts]
    assert [CODEC.decode(np.array(x, np.int64)).decode() for x in own(texts)] == texts


@settings(max_examples=300, deadline=None)
@given(st.text("abehintor ", max_size=60))
def test_words_of_common_letters(text):
    assert own([text]) == [lib(text)]


CASES = ["", " ", "  ", "a  b", "a   b ", "x\n\n y", " \n", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "it's 'Twas 'S", "aaaaaaaaaaaaa" * 5, "é" * 9, "汉字仮名" * 4, "՘x՘", "a\x00b", "word " * 3000, "q" * 5000, "ab " + "xyz" * 4000, "�", "👩‍👩‍👧 ok"]


def test_cases_alone_and_together():
    assert own(CASES) == [lib(t) for t in CASES]


def test_small_pieces_and_small_cache(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", 3)
    monkeypatch.setattr(bpe, "CACHED_WORDS", 5)
    assert own(CASES[:18]) == [lib(t) for t in CASES[:18]]


def test_exact_merging_both_ways():
    rnd = random.Random(2)
    words = [bytes(rnd.choice(b"abcdeinorst ") for _ in range(rnd.randrange(1, 40))) for _ in range(400)]
    assert CODEC.merged_many(words) == [CODEC.merged(w) for w in words]
    tokens, of = CODEC.greedy_many(words)
    assert [tokens[of == i].tolist() for i in range(len(words))] == [CODEC.greedy(w) for w in words]


def test_border_test_equals_merging():
    rnd = np.random.default_rng(5)
    ids = np.array(sorted(CODEC.ids.values()))
    ids = ids[CODEC.are_solid(ids)]
    x, y = rnd.choice(ids, 4000), rnd.choice(ids, 4000)
    text = lambda t: CODEC.text[CODEC.text_at[t] : CODEC.text_at[t] + CODEC.text_len[t]].tobytes()
    want = [CODEC.merged(text(a) + text(b)) == [a, b] for a, b in zip(x.tolist(), y.tolist())]
    assert CODEC.hold(x, y).tolist() == want


def test_digests_and_frames(spark):
    rows = [(1, "Hello <|endoftext|> world", "en"), (2, None, "en"), (2, None, "en"), (None, "", None), (3, "long " * 50000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(bpe.digests(df).collect(), key=str)
    want = []
    for d, t, _ in rows:
        ids = lib(t or "")
        want.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), True))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    back = bpe.decode(bpe.encode(df), out="again")
    assert back.columns == ["doc_id", "text", "ids", "again"]
    assert sorted(str((r.doc_id, r.text or "")) for r in back.collect()) == sorted(str((r.doc_id, r.again)) for r in back.collect())
    assert bpe.digests(df.limit(0)).collect() == []


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Codec(open(bpe.default_path().replace("byte_bpe_50k", "word_bpe_49k"), "rb").read())

"""Byte-level BPE by speculation and verification.

Each distinct word of a batch is first cut greedily into longest vocabulary entries. A sequence of tokens is what
merging would give exactly if every token, merged alone, gives itself, and no merge would cross the border of any two
neighbours; both are tested for all words at once on arrays, and only words with a bad border are merged exactly.

The vocabulary (fixed size, a few MB) is read on the driver from a path and sent to the executors once.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How byte-level vocabularies split text into words. White space is Unicode's White_Space.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Code points (hexadecimal) that the regex module counts as letters or numbers and the tokenizers library,
#: with an earlier Unicode, does not.
LATER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf "
    "10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f "
    "12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 "
    "18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff "
    "1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e "
    "2cea2-2cead 323b0-33479 "
)
LATER_CLASS = "".join("-".join(rf"\U{int(x, 16):08x}" for x in run.split("-")) for run in LATER.split())
PATTERN_LATER = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{LATER_CLASS}]]+| ?[\p{{N}}--[{LATER_CLASS}]]+| ?[[^{SPACE}\p{{L}}\p{{N}}]||[{LATER_CLASS}]]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: A space inside a run of white space: the only spaces at which a text can't be cut into chunks before splitting.
INNER = re.compile(r"\s (?:\s|\Z)")
#: First letters of cache keys that aren't chunks after a space: no text holds them.
HEAD, ADDED = "\udfff", "\udffe"
#: Words kept with their tokens by one worker; beyond that it starts anew. Only speed depends on it.
CACHED_WORDS = 1_000_000
#: Longer words (bytes) are done one by one.
LONG = 200
#: Words tokenised in one go: the memory of a batch, whatever the length of a text.
WORDS_AT_ONCE = 400_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others in
    order from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Grown:
    """An int array that grows."""

    def __init__(self):
        self.a, self.n = np.zeros(1024, np.int64), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.a):
            self.a = np.concatenate([self.a[: self.n], np.zeros(max(len(self.a), len(x)), np.int64)])
        self.a[self.n : self.n + len(x)] = x
        self.n += len(x)


def spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + lens[i] - 1 for all i, one after the other."""
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)


class Codec:
    """Encoder and decoder for a tokenizers file of kind BPE with a ByteLevel pre-tokenizer and decoder."""

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        model, pre = spec["model"], spec["pre_tokenizer"]
        known = model["type"] == "BPE" and pre["type"] == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True)
        if not known or spec["normalizer"] or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("not a plain byte-level BPE tokenizer")
        letters = byte_letters()
        of = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("only plain added tokens are supported")
        size = 1 + max([*model["vocab"].values(), *self.special.values()])
        text = [b""] * size
        for t, i in model["vocab"].items():
            text[i] = of.get(t, b"")
        for t, i in self.special.items():
            text[i] = t.encode()
        self.ids = {of[t]: i for t, i in model["vocab"].items() if t in of and t not in self.special}
        self.letter = np.array([self.ids[bytes([b])] for b in range(256)])
        self.text, self.text_len = np.frombuffer(b"".join(text), np.uint8), np.array([len(t) for t in text])
        self.text_at = np.cumsum(self.text_len) - self.text_len
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [(model["vocab"][a], model["vocab"][b], model["vocab"][a + b]) for a, b in merges]
        self.merge = {a << 32 | b: (rank, c) for rank, (a, b, c) in reversed([*enumerate(made)])}
        # by token: rank of the merge that makes it (-1: a byte), its two parts
        self.rank, self.left, self.right = np.full(size, -1), np.arange(size), np.arange(size)
        for rank, (a, b, c) in reversed([*enumerate(made)]):
            self.rank[c], self.left[c], self.right[c] = rank, a, b
        self.keys = np.array(sorted(self.merge), np.int64)
        self.key_rank = np.array([self.merge[k][0] for k in self.keys.tolist()], np.int64)
        self.key_made = np.array([self.merge[k][1] for k in self.keys.tolist()], np.int64)
        # a trie of the vocabulary: node << 8 | byte -> node, and the token that ends at a node
        nodes: dict[int, int] = {}
        accept = [-1]
        for t, i in self.ids.items():
            node = 0
            for byte in t:
                step = node << 8 | byte
                if step not in nodes:
                    nodes[step] = len(accept)
                    accept.append(-1)
                node = nodes[step]
            accept[node] = i
        self.steps = np.array(sorted(nodes), np.int64)
        self.step_to, self.accept = np.array([nodes[k] for k in self.steps.tolist()], np.int64), np.array(accept, np.int64)
        self.nodes = nodes
        self.solid = np.zeros(size, np.int8)  # 1: merged alone it gives itself, -1: it doesn't, 0: not yet known
        self.plain, self.careful, self.later = regex.compile(PATTERN), regex.compile(PATTERN_LATER), regex.compile(f"[{LATER_CLASS}]")
        self.parts = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.forget()

    def forget(self) -> None:
        self.cache: dict[str, int] = {}
        self.tokens, self.at, self.len = Grown(), Grown(), Grown()
        for t, i in self.special.items():
            self.keep([ADDED + t], [[i]])

    def keep(self, words: list[str], tokens: list[list[int]]) -> None:
        lens = np.array([len(t) for t in tokens], np.int64)
        self.cache.update(zip(words, range(self.at.n, self.at.n + len(words))))
        self.at.add(self.tokens.n + np.cumsum(lens) - lens)
        self.len.add(lens)
        self.tokens.add(np.fromiter(chain.from_iterable(tokens), np.int64, int(lens.sum())))

    def words_of(self, text: str) -> regex.Pattern:
        return self.careful if not text.isascii() and self.later.search(text) else self.plain

    # one word

    def merged(self, word: bytes) -> list[int]:
        """Exact merging, lowest rank first and leftmost among equals, with a heap over neighbours."""
        t = self.letter[np.frombuffer(word, np.uint8)].tolist()
        n, merge = len(t), self.merge
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, t[i], t[i + 1], m[1]) for i in range(n - 1) if (m := merge.get(t[i] << 32 | t[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, c = heapq.heappop(heap)
            j = nxt[i]
            if t[i] != a or j >= n or t[j] != b:
                continue
            t[i], t[j] = c, -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            for k, m in ((prev[i], nxt[prev[i]] if prev[i] >= 0 else n), (i, nxt[i])):
                if k >= 0 and m < n and (found := merge.get(t[k] << 32 | t[m])):
                    heapq.heappush(heap, (found[0], k, t[k], t[m], found[1]))
        return [x for x in t if x >= 0]

    def greedy(self, word: bytes) -> list[int]:
        """Longest vocabulary entries from left to right."""
        out, at, n, nodes, accept = [], 0, len(word), self.nodes, self.accept
        while at < n:
            node, i, stop = 0, at, at
            while i < n and (node := nodes.get(node << 8 | word[i], -1)) >= 0:
                i += 1
                if accept[node] >= 0:
                    best, stop = int(accept[node]), i
            out.append(best)
            at = stop
        return out

    # many words

    def greedy_many(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words one after the other, their word), all words a byte further at each step."""
        text = np.frombuffer(b"".join(raw) + b"\0", np.uint8).astype(np.int64)
        stop = np.cumsum([len(w) for w in raw])
        word, at = np.arange(len(raw)), stop - [len(w) for w in raw]
        node, best, best_at = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64), at.copy()
        words, tokens = [], []
        word, at, stop, node, best, best_at = (x[at < stop] for x in (word, at, stop, node, best, best_at))
        while len(word):
            key = node << 8 | text[at]
            k = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            goes = (self.steps[k] == key) & (at < stop)
            node = np.where(goes, self.step_to[k], 0)
            at = np.where(goes, at + 1, best_at)
            token = self.accept[node]
            hit = goes & (token >= 0)
            words.append(word[~goes])
            tokens.append(best[~goes])
            best, best_at = np.where(hit, token, best), np.where(hit, at, best_at)
            live = goes | (at < stop)
            if not live.all():
                word, at, stop, node, best, best_at = (x[live] for x in (word, at, stop, node, best, best_at))
        words, tokens = np.concatenate([*words, np.zeros(0, np.int64)]), np.concatenate([*tokens, np.zeros(0, np.int64)])
        order = np.argsort(words, kind="stable")
        return tokens[order], words[order]

    def merged_many(self, raw: list[bytes]) -> list[list[int]]:
        """merged() of each word: one merge in every word at each step."""
        out: list[list[int]] = [self.merged(w) if len(w) > LONG else [] for w in raw]
        short = [i for i, w in enumerate(raw) if len(w) <= LONG]
        t = self.letter[np.frombuffer(b"".join(raw[i] for i in short), np.uint8)]
        word = np.repeat(np.array(short, np.int64), [len(raw[i]) for i in short])
        done_t, done_w = [], []
        while len(t):
            key = t << 32 | np.append(t[1:], 0)
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            pair = (self.keys[k] == key) & np.append(word[1:] == word[:-1], False)
            rank = np.where(pair, self.key_rank[k], 1 << 40)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, len(t)))
            low = np.minimum.reduceat(rank, first)
            at = np.flatnonzero((rank == np.repeat(low, size)) & pair)
            at = at[np.append(True, word[at[1:]] != word[at[:-1]])] if len(at) else at
            t = t.copy()
            t[at] = self.key_made[k[at]]
            ended = np.repeat(low == 1 << 40, size)
            done_t.append(t[ended])
            done_w.append(word[ended])
            live = ~ended
            live[at + 1] = False
            t, word = t[live], word[live]
        if done_t:
            tokens, words = np.concatenate(done_t), np.concatenate(done_w)
            order = np.argsort(words, kind="stable")
            words = words[order]
            at = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
            for w, part in zip(words[at].tolist(), np.split(tokens[order], at[1:])):
                out[w] = part.tolist()
        return out

    def are_solid(self, tokens: np.ndarray) -> np.ndarray:
        new = np.unique(tokens[self.solid[tokens] == 0])
        alone = self.merged_many([self.text[self.text_at[t] : self.text_at[t] + self.text_len[t]].tobytes() for t in new])
        self.solid[new] = [1 if x == [t] else -1 for x, t in zip(alone, new.tolist())]
        return self.solid[tokens] > 0

    def hold(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border between tokens x[i] and y[i]. Takes the last merge inside either side
        back again and again; a merge of what then meets at the border must not have come before it."""
        holds, live = np.ones(len(x), bool), np.arange(len(x))
        limit = np.full(len(x), 1 << 40)
        while len(live):
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            crossed = (self.keys[at] == key) & (self.key_rank[at] < limit)
            holds[live[crossed]] = False
            go = ~crossed & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            x, y, live = x[go], y[go], live[go]
            rx, ry = self.rank[x], self.rank[y]
            later = rx > ry
            limit = np.where(later, rx, ry + 1)
            x, y = np.where(later, self.right[x], x), np.where(later, y, self.left[y])
        return holds

    def learn_words(self, words: list[str]) -> None:
        """Tokenise distinct new words and keep the result: propose, test all borders, merge where a test fails."""
        raw = [w[1:].encode() for w in words]
        short = [w if len(w) <= LONG else b"" for w in raw]
        flat, word = self.greedy_many(short)
        if long := [(i, self.greedy(w)) for i, w in enumerate(raw) if len(w) > LONG]:
            flat = np.concatenate([flat, *(np.array(g, np.int64) for _, g in long)])
            word = np.concatenate([word, *(np.full(len(g), i) for i, g in long)])
            order = np.argsort(word, kind="stable")
            flat, word = flat[order], word[order]
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, which = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        bad = np.zeros(len(raw), bool)
        bad[word[~self.are_solid(flat)]] = True
        bad[word[inner][~self.hold(pairs >> 32, pairs & 0xFFFFFFFF)[which]]] = True
        lens = np.bincount(word, minlength=len(raw))
        ends = np.cumsum(lens)
        flat, ends, lens = flat.tolist(), ends.tolist(), lens.tolist()
        tokens = [flat[e - n : e] for e, n in zip(ends, lens)]
        wrong = np.flatnonzero(bad).tolist()
        for i, exact in zip(wrong, self.merged_many([raw[i] for i in wrong])):
            tokens[i] = exact
        self.keep(words, tokens)

    def learn(self, chunks: list[str]) -> None:
        """Tokenise distinct new chunks and keep the result, word by word and put together."""
        texts = [c[1:] if c[:1] == HEAD else " " + c for c in chunks]
        split = [[HEAD + w for w in self.words_of(x).findall(x)] for x in texts]
        if new := list({w for words in split for w in words}.difference(self.cache)):
            self.learn_words(new)
        made = [(c, words) for c, words in zip(chunks, split) if c not in self.cache]
        if not made:
            return
        count = np.array([len(words) for _, words in made], np.int64)
        w = np.fromiter((self.cache[x] for _, words in made for x in words), np.int64, int(count.sum()))
        n = self.len.a[w]
        total = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum(count)
        lens = total[ends] - total[ends - count]
        self.cache.update(zip((c for c, _ in made), range(self.at.n, self.at.n + len(made))))
        flat = self.tokens.a[spans(self.at.a[w], n)]
        self.at.add(self.tokens.n + np.cumsum(lens) - lens)
        self.len.add(lens)
        self.tokens.add(flat)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Cache keys of a text, in lists of bounded length: chunks between spaces where a text can be cut at each
        of them, words elsewhere, and added tokens."""
        at, stops = 0, [*((m.start(), m[0]) for m in (self.parts.finditer(text) if self.parts else ())), (len(text), "")]
        for stop, added in stops:
            part = text[at:stop] if at or stop < len(text) else text
            if INNER.search(part):
                found = (HEAD + m[0] for m in self.words_of(part).finditer(part))
                while some := list(islice(found, WORDS_AT_ONCE)):
                    yield some
            elif part:
                chunks = part.split(" ")
                chunks[0] = HEAD + chunks[0]
                yield chunks
            if added:
                yield [ADDED + added]
            at = stop + len(added)

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The token ids of each text, in order, int64."""
        words: list[str] = []
        ends: list[int] = []  # of texts, in words
        done: list[np.ndarray] = []  # of a text that is longer than one go

        def flush() -> np.ndarray:
            if len(self.cache) > CACHED_WORDS:
                self.forget()
            if new := list(set(words).difference(self.cache)):
                self.learn(new)
            return np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))

        def out() -> Iterator[np.ndarray]:
            w = flush()
            at, n = self.at.a[w], self.len.a[w]
            ids = self.tokens.a[spans(at, n)]
            total = np.concatenate([[0], np.cumsum(n)])
            start = 0
            for e in ends:
                part = ids[total[start] : total[e]]
                yield np.concatenate([*done, part]) if done else part
                done.clear()
                start = e
            if start < len(words):
                done.append(ids[total[start] :].copy())
            words.clear()
            ends.clear()

        for text in texts:
            for some in self.pieces(text or ""):
                words += some
                if len(words) >= WORDS_AT_ONCE:
                    yield from out()
            ends.append(len(words))
        yield from out()

    def decode(self, ids: np.ndarray) -> bytes:
        """The decoded text in UTF-8; what isn't UTF-8 becomes U+FFFD."""
        raw = self.text[spans(self.text_at[ids], self.text_len[ids])].tobytes()
        return raw.decode("utf-8", "replace").encode()


_codecs: dict[bytes, Codec] = {}


def codec(blob: bytes) -> Codec:
    """One codec a worker process and file."""
    key = hashlib.sha256(blob).digest()
    if key not in _codecs:
        _codecs[key] = Codec(blob)
    return _codecs[key]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _sent(spark: SparkSession, path: str | None):
    with open(path or default_path(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _texts(column) -> Iterator[str]:
    return ((x.decode("utf-8", "replace") if (x := v.as_py()) is not None else "") for v in column)


#: Ids that are gathered for one Arrow batch, about.
IDS_A_BATCH = 1 << 20


def _beside(docs: DataFrame, text: str, out: str) -> tuple[DataFrame, list[str], str]:
    """(columns but ``out`` by position and the text's bytes, their names, their types)."""
    names = docs.columns
    keep = [i for i, n in enumerate(names) if n.lower() != out.lower()]
    plain = docs.toDF(*[f"d{i}" for i in range(len(names))])
    source = plain.select(*[F.col(f"d{i}").alias(f"c{k}") for k, i in enumerate(keep)], F.col(f"d{names.index(text)}").cast("binary").alias("_t"))
    return source, [names[i] for i in keep], "".join(f"c{k} {docs.dtypes[i][1]}, " for k, i in enumerate(keep))


def encode(docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with the column ``out`` array<int>: the token ids of the whole text, an empty array for null.

    Every other column passes unchanged. A column named ``out`` is replaced, the text's own as well. Added tokens that
    occur in a text get their id, as the tokenizers library does it.
    """
    sent = _sent(docs.sparkSession, path)
    source, kept, types = _beside(docs, text, out)
    names = [f"c{i}" for i in range(len(kept))] + ["ids"]

    def run(batches):
        c = codec(sent.value)
        for b in batches:
            held: list[np.ndarray] = []
            start = 0
            for k, ids in enumerate(c.encode(_texts(b.column(len(kept))))):
                held.append(ids.astype(np.int32))
                if k == b.num_rows - 1 or sum(map(len, held)) >= IDS_A_BATCH or len(held) >= 1024:
                    ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held)))
                    yield pa.RecordBatch.from_arrays([*(b.column(i).slice(start, len(held)) for i in range(len(kept))), lists], names)
                    held, start = [], k + 1

    return source.mapInArrow(run, f"{types}ids array<int>").toDF(*kept, out)


def count_tokens(docs: DataFrame, text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """``docs`` with the column ``out`` long: how many token ids encode() gives the whole text, 0 for null. Every other
    column passes unchanged; a column named ``out`` is replaced."""
    sent = _sent(docs.sparkSession, path)
    source, kept, types = _beside(docs, text, out)

    def run(batches):
        c = codec(sent.value)
        for b in batches:
            n = [len(ids) for ids in c.encode(_texts(b.column(len(kept))))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(n, pa.int64())], [*(f"c{i}" for i in range(len(kept))), "n"])

    return source.mapInArrow(run, f"{types}n long").toDF(*kept, out)


def decode(df: DataFrame, ids: str = "ids", out: str = "text", path: str | None = None) -> DataFrame:
    """``df`` with the column ``out``: the text of the token ids in ``ids`` (null: empty text)."""
    sent = _sent(df.sparkSession, path)

    @F.pandas_udf("string")
    def run(column):
        c = codec(sent.value)
        return column.map(lambda x: c.decode(np.asarray(x if x is not None else [], np.int64)).decode())

    return df.withColumn(out, run(F.col(ids)))


def digests(docs: DataFrame, text: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """(id_col, n_tokens long, ids_sha256, decoded_sha256, round_trip boolean) for every row: what encode() and
    decode() give, digested where it is made so that ids and texts needn't travel.

    Defined cases: null text counts as empty (0 tokens, digests of nothing); null ids and repeated rows come back as
    given; columns besides these two are not looked at; texts of any length are done in pieces of bounded memory.
    """
    sent = _sent(docs.sparkSession, path)

    def run(batches):
        c = codec(sent.value)
        for b in batches:
            rows: list[tuple] = []
            for ids, raw in zip(c.encode(_texts(b.column(1))), b.column(1)):
                decoded = c.decode(ids)
                rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest(), decoded == (raw.as_py() or b"")))
            columns = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.string(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["id", "n", "i", "d", "r"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    return source.mapInArrow(run, "id long, n long, i string, d string, r boolean").toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256", "round_trip")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))

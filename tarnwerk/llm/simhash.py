"""SimHash near-duplicates by a self-join of a binary trie.

Every document gets a 64-bit fingerprint. Distinct fingerprints are the leaves of a binary trie; the self-join walks
pairs of its nodes together, adds up the bits in which their paths differ and drops a pair of nodes as soon as the
error budget is exceeded. Two tries are walked, one over the bits as they are and one with the halves exchanged: of at
most ``budget`` differing bits, at most ``budget // 2`` lie in one of the halves, so each walk has only that smaller
budget until half-way down. That keeps the number of live node pairs near n * (1 + depth).

Spread: the upper ``depth`` levels are unrolled into rows (a fingerprint goes to every pair of upper nodes it can meet
in), each pair of upper nodes is one Arrow group, and inside it the walk is vectorised in numpy with a bounded
frontier. A group returns a spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwerk.llm.common import cut, join_hot
from tarnwerk.llm.components import connected_components

BITS = 64
#: Fingerprints below one upper node, about, when the depth is chosen.
NODE = 8192
#: Node pairs expanded at once, pairs of leaves compared at once and places held over all levels: the memory of a walk.
FRONTIER, LEAVES, PLACES = 1 << 16, 1 << 17, 1 << 23
#: A node pair with at most so many pairs of leaves is compared outright.
SMALL = 64


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The fingerprint of one text in UTF-8: words between ASCII white space, A-Z in lower case, ``width``-word
    shingles with repeats (fewer words: all of them as one), XXH64 with seed 42, bits set in over half the hashes.
    No words, or null: 0."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(x + 1 for x in ends)]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(joined[i:j], 42) for i, j in zip(starts, ends[width - 1 :])]), np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 3) -> DataFrame:
    """(id_col, fp long) for every row of ``docs``; fp holds the 64 bits as a signed long. Null ids stay."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), width) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    return source.mapInArrow(run, "id long, fp long").withColumnRenamed("id", id_col)


class Forest:
    """Union-find over 0..n-1 that takes links by the array."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        p = self.parent
        while True:
            y = p[p[x]]
            if (y == p[x]).all():
                return y
            p[x] = y

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            x, y = self.find(x), self.find(y)
            apart = x != y
            x, y = x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        root = self.find(np.arange(len(self.parent)))
        child = np.flatnonzero(root != np.arange(len(root)))
        return child, root[child]


def walk(a: np.ndarray, b: np.ndarray | None, depth: int, diff: int, budget: int, link) -> None:
    """Walk two sub-tries that start at ``depth`` with ``diff`` differing bits so far and call ``link(i, j)`` with
    arrays of positions of leaves that differ in at most ``budget`` bits. a, b: sorted uint64; b None: a with itself.
    Down to bit 32 only budget // 2 differing bits are allowed."""
    same = b is None
    b = a if same else b
    zeros: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def before(level: int) -> tuple[np.ndarray, np.ndarray]:
        if level not in zeros:
            if (len(zeros) + 1) * (len(a) if same else len(a) + len(b)) > PLACES:
                zeros.clear()
            at = np.uint64(1 << BITS - 1 - level)
            low = [np.concatenate([[0], np.cumsum((x & at) == 0, dtype=np.int32)], dtype=np.int32) for x in ((a,) if same else (a, b))]
            zeros[level] = (low[0], low[-1])
        return zeros[level]

    def leaves(p: np.ndarray) -> None:
        na, nb = p[:, 1] - p[:, 0], p[:, 3] - p[:, 2]
        cell = np.cumsum(na * nb)
        start = 0
        while start < len(p):
            stop = max(start + 1, int(np.searchsorted(cell, (cell[start - 1] if start else 0) + LEAVES, "right")))
            q, ma, mb = p[start:stop], na[start:stop], nb[start:stop]
            if len(q) == 1 and ma[0] * mb[0] > LEAVES:  # identical paths to the last bit can't be split further
                for i in range(q[0, 0], q[0, 1], step := max(1, LEAVES // int(mb[0]))):
                    leaves(np.array([[i, min(i + step, q[0, 1]), q[0, 2], q[0, 3], 0]]))
            else:
                pair = np.repeat(np.arange(len(q)), ma * mb)
                at = np.arange(len(pair)) - np.repeat(np.cumsum(ma * mb) - ma * mb, ma * mb)
                i, j = q[pair, 0] + at // mb[pair], q[pair, 2] + at % mb[pair]
                near = np.bitwise_count(a[i] ^ b[j]) <= budget
                near &= (i < j) if same else True
                link(i[near], j[near])
            start = stop

    stack = [(depth, np.array([[0, len(a), 0, len(b), diff]], np.int64))]
    while stack:
        level, p = stack.pop()
        p = p[(p[:, 1] > p[:, 0]) & (p[:, 3] > p[:, 2])]
        done = (p[:, 1] - p[:, 0]) * (p[:, 3] - p[:, 2]) <= SMALL
        if done.any() or level == BITS:
            leaves(p[done] if level < BITS else p)
            p = p[~done] if level < BITS else p[:0]
        if not len(p):
            continue
        if len(p) > FRONTIER:
            stack += [(level, x) for x in np.array_split(p, -(-len(p) // FRONTIER))]
            continue
        za, zb = before(level)
        am, bm = p[:, 0] + za[p[:, 1]] - za[p[:, 0]], p[:, 2] + zb[p[:, 3]] - zb[p[:, 2]]
        a0, a1, b0, b1, d = p.T
        nxt = [np.stack([a0, am, b0, bm, d], 1), np.stack([am, a1, bm, b1, d], 1)]
        split = d < (budget // 2 if level < BITS // 2 else budget)
        nxt.append(np.stack([a0, am, bm, b1, d + 1], 1)[split])
        twin = (a0 == b0) & (a1 == b1) if same else np.zeros(len(p), bool)
        nxt.append(np.stack([am, a1, b0, bm, d + 1], 1)[split & ~twin])
        stack.append((level + 1, np.concatenate(nxt)))


def linked_fingerprints(fps: DataFrame, budget: int = 3, depth: int | None = None) -> DataFrame:
    """A spanning forest (a long, b long) of the links between the distinct values of the long column ``fp``."""
    if depth is None:
        n = fps.count()
        depth = min(BITS // 2 - 1, max(0, (max(n, 1) // NODE).bit_length()))
    near = budget // 2
    if near > 1:
        raise ValueError("budgets over 3 need more upper node pairs than this unrolls")
    rest = BITS - depth
    turned = lambda t: F.col("fp") if t == 0 else F.shiftleft("fp", BITS // 2).bitwiseOR(F.shiftrightunsigned("fp", BITS // 2))
    both = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), turned(t).alias("key")) for t in (0, 1)])).alias("s")
    rows = fps.select(both).select("s.t", "s.key")
    own = F.shiftrightunsigned("key", rest) if depth else F.lit(0).cast("long")
    rows = rows.select("t", "key", own.alias("p"))
    other = F.array(F.col("p"), *[F.col("p").bitwiseXOR(F.lit(1 << i).cast("long")) for i in range(depth if near else 0)])
    rows = rows.select("t", "key", "p", F.explode(other).alias("q")).select("t", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), (F.col("p") > F.col("q")).alias("side"), "key")

    def run(key, table):
        t, lo, hi = (x.as_py() for x in key)
        values = table.column("key").to_numpy().view(np.uint64)
        side = table.column("side").to_numpy(zero_copy_only=False).astype(bool)
        if lo == hi:
            order = np.sort(values)
            forest = Forest(len(order))
            walk(order, None, depth, 0, budget, forest.link)
        else:
            a, b = np.sort(values[~side]), np.sort(values[side])
            order = np.concatenate([a, b])
            forest = Forest(len(order))
            if len(a) and len(b):
                walk(a, b, depth, 1, budget, lambda i, j: forest.link(i, j + len(a)))
        child, root = forest.edges()
        if t:
            order = order << np.uint64(32) | order >> np.uint64(32)
        return pa.table({"a": pa.array(order[child].view(np.int64), pa.int64()), "b": pa.array(order[root].view(np.int64), pa.int64())})

    return rows.groupBy("t", "lo", "hi").applyInArrow(run, "a long, b long")


def fingerprint_words(hashes: np.ndarray, words: int) -> np.ndarray:
    """A SimHash of ``words`` 64-bit words of a set of 64-bit hashes: each word has bits of its own, made from the hash
    by mixing. An empty set: zero."""
    if not len(hashes):
        return np.zeros(words, np.uint64)
    ones = np.zeros(words * BITS, np.int64)
    step = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(0, len(hashes), 255):  # as many as a byte can count
        x = hashes[k : k + 255, None] + step
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(hashes)).view(np.uint64)


def linked_keys(rows: DataFrame, budget: int, far: int, node: int = 1 << 20) -> DataFrame:
    """A spanning forest (a, b) of links between the texts k of rows (t, key, k, c0, c1): same t, keys that differ in at
    most ``budget`` bits (2 or 3), and c0 and c1 in at most ``far`` bits. Texts of one key are linked whatever their c0
    and c1, and so are those of keys nearby, so that many near copies are not compared pair by pair."""
    n = rows.where("t = 0").count()
    depth = min(15, max(0, (max(n, 1) // node).bit_length()))
    rest = BITS - depth
    swapped = F.shiftleft("key", BITS // 2).bitwiseOR(F.shiftrightunsigned("key", BITS // 2))
    both = F.explode(F.array(F.struct((F.col("t") * 2).alias("t"), F.col("key").alias("key")), F.struct((F.col("t") * 2 + 1).alias("t"), swapped.alias("key")))).alias("s")
    rows = rows.select(both, "k", "c0", "c1").select("s.t", "s.key", "k", "c0", "c1")
    own = F.shiftrightunsigned("key", rest) if depth else F.lit(0).cast("long")
    rows = rows.withColumn("p", own)
    other = F.array(F.col("p"), *[F.col("p").bitwiseXOR(F.lit(1 << i).cast("long")) for i in range(depth)])
    # t, the lower and the higher node in one number, for a group's rows all carry it to Python
    pair = F.shiftleft(F.col("t").cast("long"), 30) + F.shiftleft(F.least("p", "q"), 15) + F.greatest("p", "q")
    rows = rows.withColumn("q", F.explode(other)).select(pair.alias("g"), (F.col("p") > F.col("q")).alias("side"), "key", "k", "c0", "c1")

    def run(group, table):
        lo, hi = group[0].as_py() >> 15 & 0x7FFF, group[0].as_py() & 0x7FFF
        key, k, c0, c1 = (table.column(c).to_numpy().view(np.uint64) for c in ("key", "k", "c0", "c1"))
        side = table.column("side").to_numpy(zero_copy_only=False).astype(bool)
        order = np.lexsort((key, side))
        key, k, c0, c1, side = key[order], k[order], c0[order], c1[order], side[order]
        first = np.r_[True, (key[1:] != key[:-1]) | (side[1:] != side[:-1])][: len(key)]
        start = np.flatnonzero(first)
        many = np.diff(np.r_[start, len(key)]) > 1
        of = start[np.cumsum(first) - 1]
        forest = Forest(len(start))
        split = int((~side[start]).sum())

        def link(i, j, add=0):
            j = j + add
            x, y = start[i], start[j]
            near = np.bitwise_count(c0[x] ^ c0[y]).astype(np.int64) + np.bitwise_count(c1[x] ^ c1[y]) <= far
            near |= many[i] | many[j]
            forest.link(i[near], j[near])

        distinct = key[start]
        if lo == hi:
            walk(distinct, None, depth, 0, budget, link)
        elif split and split < len(distinct):
            walk(distinct[:split], distinct[split:], depth, 1, budget, lambda i, j: link(i, j, split))
        child, root = forest.edges()
        again = np.flatnonzero(~first)
        a, b = np.r_[k[again], k[start[child]]], np.r_[k[of[again]], k[start[root]]]
        return pa.table({"a": pa.array(a.view(np.int64), pa.int64()), "b": pa.array(b.view(np.int64), pa.int64())})

    return rows.groupBy("g").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 3, budget: int = 3) -> DataFrame:
    """(id_col, fp long, component_id) for every row of ``docs``; component_id is the smallest id reachable by links.

    Defined cases: null or empty text and text of white space have fingerprint 0 and link like any other; rows with
    one fingerprint are linked whatever their texts; repeated rows come back as often as they are given; a null id
    stays null and is no candidate for component_id (which is null only if no linked row has an id); columns besides
    id and text are not looked at, whatever their names; an empty table gives an empty result.
    """
    marked = cut(fingerprints(docs, text, id_col, width).withColumnRenamed(id_col, "id"))
    classes = cut(marked.groupBy("fp").agg(F.min("id").alias("low")))
    found = connected_components(linked_fingerprints(classes.select("fp"), budget))
    joined = cut(found.join(classes, found["node"] == classes["fp"]).select("fp", "component", "low"))
    lows = joined.groupBy("component").agg(F.min("low").alias("reach"))
    linked = joined.withColumnRenamed("component", "k").join(lows.withColumnRenamed("component", "k"), "k").select("fp", "reach")
    answer = classes.join(linked, "fp", "left").select("fp", F.coalesce("reach", "low").alias("component_id"))
    return join_hot(marked, answer.withColumnRenamed("component_id", "c"), "fp").select(F.col("id").alias(id_col), "fp", F.col("c").alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` without the rows whose id is not the smallest of their text's group.

    Defined cases: a row is judged by its own text, so of rows that share an id only those go whose text's group has a
    smaller id; equal rows stay or go together; rows with a null id stay; an empty table gives an empty result.
    """
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = cut(docs.select(F.col(id_col).cast("long").alias("id"), key.alias("k")))
    groups = cut(near_duplicates(docs.select(key.alias("k"), F.col(text).alias("text")), "text", "k", **how).select("k", F.col("component_id").alias("g")).distinct())
    grouped = join_hot(rows, groups, "k")
    gone = join_hot(grouped, grouped.groupBy("g").agg(F.min("id").alias("low")), "g").where("id <> low").select(F.col("id").alias("_gone_id"), F.col("k").alias("_gone_k")).distinct()
    return docs.join(gone, (F.col(id_col).cast("long") == F.col("_gone_id")) & (key == F.col("_gone_k")), "left_anti")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

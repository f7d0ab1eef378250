"""Exact top-k search by inner product, a block of documents at a time.

Documents are ordered by a sign key and cut into ranges (blocks) with a forward index each: their weights, and per term
the largest and smallest weight. A query's bound for a block is the sum over its terms of weight times the block's
largest (for a negative weight: smallest) value. Blocks are scored in the order of their bounds until the bound falls
below the query's k-th score.

Spread: blocks travel as rows of SUPER blocks, queries as rows of up to QUERIES queries; every such row of queries meets
every row of blocks (the stated query set against all rows, in blocks). A first pass over one row of blocks a query
gives each query a floor for its k-th score. The bounds of whole rows of blocks are held against the floors before any
block travels: only the queries that a row of blocks can still improve are sent to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwerk.llm.common import cut

BLOCK, SUPER, QUERIES = 256, 64, 2048
#: Integers up to here are exact in double precision.
EXACT = float(1 << 53)
LOW = -(1 << 62)


def packed(w: np.ndarray) -> bytes:
    """A matrix of integers in as few bytes as it needs."""
    top = int(np.abs(w).max()) if w.size else 0
    return w.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64).tobytes()


def unpacked(raw: bytes, rows: int, dim: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[len(raw) // max(1, rows * dim)] if rows * dim else np.int64
    return np.frombuffer(raw, kind).reshape(rows, dim).astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exact; by BLAS where doubles can hold every sum."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top < EXACT * 512:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, LOW, -LOW).astype(np.int64)


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The highest score that a query (row) can reach in a block (column); endless where a part of it saturates."""
    a, b = product(np.maximum(q, 0), high), product(np.minimum(q, 0), low)
    return np.where((a >= -LOW) | (b >= -LOW), np.iinfo(np.int64).max, a + np.minimum(b, -LOW - 1))


def best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best: highest score, then smallest id; a pair of query and id once."""
    order = np.lexsort((ids, -scores, q))
    same = np.zeros(len(order), bool)
    same[1:] = (q[order][1:] == q[order][:-1]) & (ids[order][1:] == ids[order][:-1])
    order = order[~same]
    start = np.flatnonzero(np.append(True, q[order][1:] != q[order][:-1])) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank < k]


def search(qids: np.ndarray, q: np.ndarray, floor: np.ndarray, ids: np.ndarray, w: np.ndarray, high: np.ndarray, low: np.ndarray, k: int, size: int = BLOCK):
    """(query positions, ids, scores): the k best of each query among the documents of one row of blocks, those below
    the query's floor left out. Returns also how many blocks were scored, over all queries."""
    bound = bounds(q, high, low)
    order = np.argsort(-bound, axis=1, kind="stable")
    kth, scored = floor.copy(), 0
    found = [np.zeros(0, np.int64)] * 3
    for r in range(bound.shape[1]):
        block = order[:, r]
        live = np.flatnonzero(bound[np.arange(len(q)), block] >= kth)
        if not len(live):
            break
        parts = [found]
        for b in np.unique(block[live]).tolist():
            mine, at = live[block[live] == b], slice(b * size, (b + 1) * size)
            s = product(q[mine], w[at])
            scored += len(mine)
            x, y = np.nonzero((s >= kth[mine][:, None]) & (ids[at][None, :] != qids[mine][:, None]))
            parts.append([mine[x], ids[at][y], s[x, y]])
        found = [np.concatenate(p) for p in zip(*parts)]
        keep = best(*found, k)
        found = [f[keep] for f in found]
        count = np.bincount(found[0], minlength=len(q))
        full = np.flatnonzero(count >= k)
        if len(full):
            kth[full] = np.maximum(kth[full], found[2][(np.cumsum(count) - 1)[full]])
    return *found, kth, scored


def top_k(vectors: DataFrame, vec: str = "embedding", id_col: str = "vec_id", every: int = 50, k: int = 5, scale: int = 256, seed: int = 5) -> DataFrame:
    """(query_id, rank int, id_col, score long): for every row whose id is divisible by ``every``, the ``k`` rows with
    the highest inner product of floor(scale * component), ties to the smaller id; fewer if there are fewer.

    Defined cases: rows without an id, and vectors that are null or hold null or non-finite components, take no part;
    a shorter vector has weight 0 in the terms it lacks, and an empty one everywhere; rows that repeat an id never
    answer to that id, count once if they repeat the vector too, and else with their best score; weights and scores
    saturate at 2^62; other columns aren't looked at; an empty table gives an empty result.
    """
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False))).distinct()
    dim = int(rows.agg(F.max(F.size("v"))).first()[0] or 0)

    def weigh(batches):
        planes = np.random.default_rng(seed).standard_normal((dim, 16))
        for b in batches:
            x = np.zeros((b.num_rows, dim))
            for i in range(b.num_rows):
                x[i, : len(b.column(1)[i].values)] = b.column(1)[i].values.to_numpy(zero_copy_only=False)
            w = np.clip(np.floor(np.clip(x, -1e18, 1e18) * scale), LOW, -LOW).astype(np.int64)
            key = (x @ planes > 0) @ (1 << np.arange(16))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key, pa.int64()), pa.array([r.tobytes() for r in w], pa.binary())], ["id", "key", "w"])

    weighed = cut(rows.mapInArrow(weigh, "id long, key long, w binary"))

    def gathered(batches, size):
        ids, w = [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            w += b.column(2).to_pylist()
            while len(ids) >= size:
                yield ids[:size], w[:size]
                ids, w = ids[size:], w[size:]
        if ids:
            yield ids, w

    def index(batches):
        for ids, raw in gathered(batches, BLOCK * SUPER):
            w = np.frombuffer(b"".join(raw), np.int64).reshape(len(ids), dim)
            cuts = np.arange(0, len(ids), BLOCK)
            high, low = np.maximum.reduceat(w, cuts), np.minimum.reduceat(w, cuts)
            yield pa.RecordBatch.from_pylist([{"n": len(ids), "ids": np.array(ids, np.int64).tobytes(), "w": packed(w), "high": packed(high), "low": packed(low), "top": packed(high.max(axis=0)), "bottom": packed(low.min(axis=0))}])

    def ask(batches):
        for ids, raw in gathered(batches, QUERIES):
            w = np.frombuffer(b"".join(raw), np.int64).reshape(len(ids), dim)
            yield pa.RecordBatch.from_pylist([{"qn": len(ids), "qids": np.array(ids, np.int64).tobytes(), "qw": packed(w)}])

    n = weighed.count()
    parts = max(1, -(-n // (BLOCK * SUPER)))
    blocks = weighed.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id").mapInArrow(index, "n long, ids binary, w binary, high binary, low binary, top binary, bottom binary")
    blocks = cut(blocks.withColumn("m", F.monotonically_increasing_id()))
    blocks = _numbered(blocks, "m", "sb")
    queries = weighed.where(F.col("id") % every == 0)
    asked = max(1, -(-queries.count() // QUERIES))
    queries = queries.repartitionByRange(asked, "key", "id").sortWithinPartitions("key", "id").mapInArrow(ask, "qn long, qids binary, qw binary")
    queries = _numbered(cut(queries.withColumn("qm", F.monotonically_increasing_id())), "qm", "qb")
    supers = blocks.count()

    def run(b, row, floors):
        g = lambda c: b.column(c)[row].as_py()
        qn, m = g("qn"), g("n")
        qids, ids = np.frombuffer(g("qids"), np.int64), np.frombuffer(g("ids"), np.int64)
        q, w = unpacked(g("qw"), qn, dim), unpacked(g("w"), m, dim)
        cuts = -(-m // BLOCK)
        return qids, search(qids, q, floors if floors is not None else np.full(qn, LOW), ids, w, unpacked(g("high"), cuts, dim), unpacked(g("low"), cuts, dim), k, BLOCK)

    def first(batches):
        for b in batches:
            for row in range(b.num_rows):
                _, (_, _, _, kth, _) = run(b, row, None)
                yield pa.RecordBatch.from_arrays([b.column("qn")[row : row + 1], b.column("qids")[row : row + 1], b.column("qw")[row : row + 1], pa.array([kth.tobytes()], pa.binary())], ["qn", "qids", "qw", "floor"])

    def sift(batches):
        for b in batches:
            for row in range(b.num_rows):
                g = lambda c: b.column(c)[row].as_py()
                qids, floor, q = np.frombuffer(g("qids"), np.int64), np.frombuffer(g("floor"), np.int64), unpacked(g("qw"), g("qn"), dim)
                live = np.flatnonzero(bounds(q, unpacked(g("top"), 1, dim), unpacked(g("bottom"), 1, dim))[:, 0] >= floor)
                if len(live):
                    yield pa.RecordBatch.from_pylist([{"sb": g("sb"), "qn": len(live), "qids": qids[live].tobytes(), "qw": packed(q[live]), "floor": floor[live].tobytes()}])

    def rest(batches):
        for b in batches:
            for row in range(b.num_rows):
                qids, (q, ids, scores, _, _) = run(b, row, np.frombuffer(b.column("floor")[row].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(ids), pa.array(scores)], ["query_id", "id", "score"])

    if not supers:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(id_col), F.lit(0).cast("long").alias("score")).limit(0)
    seeded = queries.withColumn("sb", F.pmod("qb", F.lit(supers))).join(blocks, "sb").mapInArrow(first, "qn long, qids binary, qw binary, floor binary")
    tops = blocks.select("sb", "top", "bottom")
    pairs = cut(seeded).withColumn("sb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(supers - 1).cast("long")))).join(tops, "sb")
    pairs = pairs.mapInArrow(sift, "sb long, qn long, qids binary, qw binary, floor binary").join(blocks.drop("top", "bottom"), "sb")
    hits = pairs.mapInArrow(rest, "query_id long, id long, score long").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def _numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """Rows with 0, 1, 2, ... in the order of ``by`` = monotonically_increasing_id(): a base a partition plus the place in
    it. Few rows a partition, and the table of bases has one row a partition."""
    part = F.shiftright(by, 33)
    sizes = df.groupBy(part.alias("p")).agg(F.count("*").alias("c"))
    bases = sizes.select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("base"))
    return df.withColumn("p", part).join(bases, "p").withColumn(name, F.col("base") + F.col(by).bitwiseAND(F.lit((1 << 33) - 1))).drop("p", "base", by)


def op3_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH w AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM w q JOIN w c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""

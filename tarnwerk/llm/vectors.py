"""Near-duplicate embeddings: sign hashing in several tables, exact cosines, distributed components.

Equal vectors are one node with a weight. A table gives each vector the signs of its products with random hyperplanes
as a bucket; vectors that share a bucket in some table are compared exactly, a pair in the first table only in which
the two meet, so that links can be counted without gathering pairs. A large bucket is dealt out as pairs of tiles, so
no task holds more than two tiles. A task returns link counts and a spanning forest, never pairs.

A vector travels once a table, with its signs in the tables before and nothing else. Bits and tables grow with the
number of vectors, so that buckets don't.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwerk.llm.common import cut
from tarnwerk.llm.components import connected_components
from tarnwerk.llm.groups import map_groups
from tarnwerk.llm.simhash import Forest

#: Vectors of a tile: a task holds two at most.
TILE = 4096
#: Rows of a block of products, and pairs whose buckets are compared at once.
BLOCK, PAIRS = 512, 1 << 17


def shape(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits, tables): buckets of about 256 unrelated vectors, and as many tables as give a pair right at the threshold
    the chance ``recall`` to meet. Comparing with 256 costs about as much as sending a vector to one more table."""
    bits = max(4, round(math.log2(max(n, 2))) - 8)
    meet = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet))) if meet < 1 else 1


def usable(v, i):
    """True where a row can link: it has an id, and its vector has finite components only and isn't zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(i.isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors stored as bytes of float32 or float64, scaled to length 1 in double precision."""
    raw = column.to_pylist()
    if all(len(r) == 4 * dim for r in raw):
        x = np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), dim).astype(np.float64)
    else:
        x = np.stack([np.frombuffer(r, np.float32 if len(r) == 4 * dim else np.float64).astype(np.float64) for r in raw])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_duplicates(vectors: DataFrame, vec: str = "embedding", id_col: str = "vec_id", threshold: float = 0.9, recall: float = 0.998, seed: int = 11) -> DataFrame:
    """(id_col, n_links long, component_id long, kept boolean) for every row of ``vectors``.

    Two rows link if the cosine of their vectors in double precision is ``threshold`` or more. No pair below it is
    ever linked; a pair right at it is missed with the chance 1 - ``recall``, a closer pair with a smaller one.
    Defined cases: a vector that is null, empty or zero or has null or non-finite components links with nothing, nor
    does a row without an id (its kept is false); vectors of different lengths don't link; repeated rows are vectors
    of their own; other columns aren't looked at; an empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(usable(F.col("v"), F.col("id")), F.col("v")))
    nodes = cut(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("w")).withColumn("node", F.monotonically_increasing_id()))
    bits, tables = shape(nodes.count(), threshold, recall)
    mark = np.dtype(np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.uint64)

    def sign(batches):
        planes: dict[int, np.ndarray] = {}
        power = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            lists = b.column(2)
            out = []
            for k in range(b.num_rows):
                v = np.asarray(lists[k].values.to_numpy(zero_copy_only=False), np.float64)
                d = len(v)
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, tables * bits))
                signs = ((v / np.abs(v).max()) @ planes[d] > 0).reshape(tables, bits) @ power
                single = v.astype(np.float32) if np.abs(v).max() < 1e38 else np.zeros(0)
                out.append((signs, (single if len(single) == d and (single == v).all() else v).tobytes(), d))
            keys = pa.array([x[0] for x in out], pa.list_(pa.int64()))
            marks = pa.array([x[0].astype(mark).tobytes() for x in out], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[2] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), keys, marks], ["node", "w", "dim", "x", "keys", "marks"])

    signed = cut(nodes.select("node", "w", "v").mapInArrow(sign, "node long, w long, dim int, x binary, keys array<long>, marks binary"))
    slim = signed.select("node", "dim", F.posexplode("keys").alias("t", "key"))
    big = slim.groupBy("t", "key", "dim").count().where(F.col("count") > TILE)
    big = big.select("t", "key", "dim", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    over = slim.join(big, ["t", "key", "dim"]).groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("t", "tiles"))).alias("over"))  # an entry a table
    dealt = signed.join(over, "node", "left").select("*", F.posexplode("keys").alias("t", "key"))
    dealt = dealt.withColumn("tiles", F.coalesce(F.try_element_at("over", F.col("t")), F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    before = F.substring("marks", F.lit(1), F.col("t") * mark.itemsize).alias("before")
    dealt = dealt.select("t", "key", "dim", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), (F.col("own") > F.col("o")).alias("side"), "node", "w", "x", before)

    def compare(key, table):
        if table.num_rows < 2:
            return None
        t, _, dim, i, j = key
        node, w, side = (table.column(c).to_numpy() for c in ("node", "w", "side"))
        keys = np.frombuffer(b"".join(table.column("before").to_pylist()), mark).reshape(len(node), t) if t else np.zeros((len(node), 0), mark)
        x = matrix(table.column("x"), dim)
        a = np.arange(len(node)) if i == j else np.flatnonzero(~side.astype(bool))
        b = a if i == j else np.flatnonzero(side.astype(bool))
        links, forest = np.zeros(len(node), np.int64), Forest(len(node))
        for s in range(0, len(a), BLOCK):
            p, q = np.nonzero(x[a[s : s + BLOCK]] @ x[b].T >= threshold)
            p, q = a[s + p], b[q]
            if i == j:
                p, q = p[p < q], q[p < q]
            for c in range(0, len(p), PAIRS):
                pp, qq = p[c : c + PAIRS], q[c : c + PAIRS]
                first = ~(keys[pp] == keys[qq]).any(axis=1)
                pp, qq = pp[first], qq[first]
                links += np.bincount(pp, w[qq], len(node)).astype(np.int64) + np.bincount(qq, w[pp], len(node)).astype(np.int64)
                forest.link(pp, qq)
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(node[forest.find(some)])], ["node", "links", "root"])

    found = cut(map_groups(dealt, ["t", "key", "dim", "i", "j"], compare, "node long, links long, root long"))
    reach = cut(connected_components(found.select("node", "root"), "node", "root").join(nodes.select("node", "low"), "node"))
    lows = reach.groupBy("component").agg(F.min("low").alias("reach"))
    reach = reach.select("node", F.col("component").alias("k")).join(lows.withColumnRenamed("component", "k"), "k").select("node", "reach")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.join(links, "node", "left").join(reach, "node", "left")
    known = known.select(F.col("v").alias("kv"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("reach", "low").alias("c"))
    both = rows.withColumn("h", F.xxhash64("v")).join(known.withColumn("kh", F.xxhash64("kv")), (F.col("h") == F.col("kh")) & (F.col("v") == F.col("kv")), "left")
    component = F.coalesce("c", "id")
    return both.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
), ok AS (
  SELECT vec_id, x FROM v WHERE vec_id IS NOT NULL AND x IS NOT NULL AND len(x) > 0
    AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= 0.9
), reach AS (
  SELECT a AS vec_id, a AS r FROM link UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON link.a = reach.r
), low AS (SELECT vec_id, min(r) AS c FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(low.c, v.vec_id) AS component_id, coalesce(low.c, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN n USING (vec_id) LEFT JOIN low USING (vec_id)
"""

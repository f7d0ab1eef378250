"""Near copies of whole texts: SimHash fingerprints, trie self-joins, exact Jaccard on word shingles, components.

One 64-bit fingerprint within 3 bits stands for a similarity of about 0.97; at 0.8 each bit differs with the chance
0.15. So a text gets TABLES fingerprints of 32 bits, each joined with itself in a trie with 3 bits of error, where a pair
at 0.8 meets with the chance 0.26 each time and 0.9993 in all. Two fingerprint words more must agree roughly, lest chance
meetings chain up. What meets is a bucket, and bucketlinks verifies its pairs on the whole shingle sets.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwerk.llm.bucketlinks import PLANE_NAMES, PLANES, Kind, linked
from tarnwerk.llm.common import cut, join_hot, release
from tarnwerk.llm.components import connected_components
from tarnwerk.llm.simhash import fingerprint_words, linked_keys

#: Fingerprints of 32 bits, two in a word, and the bits in which two may differ. Texts of up to FEW shingles, where a bit
#: differs with the chance 0.19, get MORE of them.
TABLES, MORE, FEW, BUDGET = 24, 40, 24, 3
#: Of 128 bits more, so many may differ: 19 do on average at similarity 0.8, 64 by chance.
FAR = 38
#: The share of the 64 places whose PLANES bits all agree: 0.61 on average at similarity 0.8, 0.125 by chance.
NEAR = 0.36
#: Texts whose shingle sets a Python worker holds at once.
TEXTS = 512


def shingle_hashes(text: bytes | None, width: int = 5) -> np.ndarray:
    """The distinct shingles of a text as XXH64 values: words as in simhash.fingerprint (fewer than ``width``: all of
    them as one shingle; none: an empty set)."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(x + 1 for x in ends)]
    digest = xxhash.xxh64_intdigest
    return np.array(sorted({digest(joined[i:j], 42) for i, j in zip(starts, ends[min(width, len(words)) - 1 :])}), np.uint64)


def _slices(batches):
    """The batches, in slices of at most TEXTS rows."""
    for b in batches:
        for i in range(0, b.num_rows, TEXTS):
            yield b.slice(i, TEXTS)


def _signed(rows: DataFrame, width: int) -> DataFrame:
    """(k, keys, s0..) of rows (k, text), a row a key; keys: the fingerprints, 16 bits at the top of either half."""

    def run(batches):
        for b in _slices(batches):
            sets = [shingle_hashes(x.as_py(), width) for x in b.column(1)]
            words = np.array([fingerprint_words(x, PLANES + MORE // 2) for x in sets], np.uint64).reshape(-1, PLANES + MORE // 2)
            pieces = words[:, PLANES:].copy().view(np.uint32).astype(np.uint64)
            keys = (pieces >> np.uint64(16)) << np.uint64(48) | (pieces & np.uint64(0xFFFF)) << np.uint64(16)
            held = np.array([MORE if len(x) <= FEW else TABLES for x in sets], np.int32)
            flat = keys[np.arange(MORE)[None, :] < held[:, None]]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(held)].astype(np.int32)), pa.array(flat.view(np.int64), pa.int64()))
            bits = [pa.array(words[:, p].copy().view(np.int64), pa.int64()) for p in range(PLANES)]
            yield pa.RecordBatch.from_arrays([b.column(0), lists, *bits], ["k", "keys", *PLANE_NAMES])

    made = rows.mapInArrow(run, f"k long, keys array<long>, {', '.join(f'{s} long' for s in PLANE_NAMES)}")
    return made.groupBy("k").agg(*[F.first(c).alias(c) for c in ("keys", *PLANE_NAMES)])


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """(k, line array<long>): the shingle sets of rows (k, text)."""

    def run(batches):
        for b in _slices(batches):
            arrays = [shingle_hashes(x.as_py(), width).view(np.int64) for x in b.column(1)]
            ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
            flat = np.concatenate(arrays)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))], ["k", "line"])

    return rows.mapInArrow(run, "k long, line array<long>")


def _key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _reach(docs: DataFrame, text: str, id_col: str, width: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(id, k) of every row, k being its text's key, and (k, c): the smallest id that a text reaches."""
    rows = docs.select(_key(text).alias("k"), F.col(text).cast("binary").alias("text"))
    signed = cut(_signed(rows, width))
    tables = signed.select("k", F.posexplode("keys").alias("t", "key"), F.col("s0").alias("c0"), F.col("s1").alias("c1"))
    meet = connected_components(cut(linked_keys(tables, BUDGET, FAR).distinct()))
    buckets = meet.select(F.col("node").alias("k"), F.array("component").alias("bands"))
    held = [cut(join_hot(buckets, signed.select("k", *PLANE_NAMES), "k"))]
    del signed, tables, meet, buckets
    release(docs.sparkSession)

    def fetch(keys: DataFrame) -> DataFrame:
        found = rows.join(keys.withColumnRenamed("k", "w"), F.col("k") == F.col("w"), "left_semi")
        return _sets(found.groupBy("k").agg(F.min("text").alias("text")), width)

    kind = Kind(64, lambda z: z, F.size, NEAR)
    comps = connected_components(linked(held.pop(), fetch, threshold, kind), "k", "p").select(F.col("node").alias("k"), "component")
    marked = cut(docs.select(F.col(id_col).cast("long").alias("id"), _key(text).alias("k")))
    lows = marked.groupBy("k").agg(F.min("id").alias("low"))
    classes = cut(join_hot(lows, comps, "k", "left").select("k", "low", F.coalesce("component", "k").alias("component")))
    reach = classes.groupBy("component").agg(F.min("low").alias("c"))
    return marked, cut(join_hot(classes, reach, "component").select("k", "c"))


def similar_texts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id_col, component_id) for every row of ``docs``; component_id is the smallest id reachable by links between
    texts whose shingle sets have at least that Jaccard similarity.

    Defined cases: null, empty and blank texts are one class; equal texts are linked; a null id stays null and is no
    candidate for component_id (which is null only if no linked row has an id); an empty table gives an empty result.
    """
    marked, answer = _reach(docs, text, id_col, width, threshold)
    return join_hot(marked, answer, "k").select(F.col("id").alias(id_col), F.col("c").alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the rows whose id is not the smallest of their text's class.

    Defined cases: a row is judged by its own text, so of rows that share an id only those go whose text is also in a
    row with a smaller id; equal rows are one document and stay or go together; rows with a null id stay; other columns
    pass unchanged, whatever their names; an empty table gives an empty result.
    """
    marked, answer = _reach(docs, text, id_col, width, threshold)
    gone = join_hot(marked, answer, "k").where("id <> c").select(F.col("id").alias("_gone_id"), F.col("k").alias("_gone_k")).distinct()
    return docs.join(gone, (F.col(id_col).cast("long") == F.col("_gone_id")) & (_key(text) == F.col("_gone_k")), "left_anti")

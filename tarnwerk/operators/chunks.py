"""Cutting content into chunks: fixed sizes with built-in functions, content-defined with numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The rolling sum sees so many bytes, and a cut is where it comes near this.
WINDOW, CENTRE = 32, 0x7FFFFFFF


def fixed(files: DataFrame, size: int, id_col: str = "path", data: str = "data") -> DataFrame:
    """(id_col, idx, offset, size, hash) of files longer than ``size``; hash is SHA-1 of the raw piece."""
    n = F.octet_length(data)
    rows = files.where(n > size).select(id_col, data, n.alias("n"), F.explode(F.sequence(F.lit(0), ((n - 1) / size).cast("int"))).alias("idx"))
    piece = F.expr(f"substring({data}, idx * {size} + 1, {size})")
    return rows.select(id_col, "idx", (F.col("idx") * size).cast("long").alias("offset"), F.octet_length(piece).cast("long").alias("size"), F.sha1(piece).alias("hash"))


def offsets(chunks: DataFrame, id_col: str, idx: list[str], size: str) -> DataFrame:
    """``chunks`` with the running offset of each within its file."""
    before = Window.partitionBy(id_col).orderBy(*idx).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))


def sums(data: np.ndarray) -> np.ndarray:
    """The rolling sum at every byte: doubling and xor in 32 bits, which is the xor of the last 32 bytes shifted by
    their age."""
    out = np.zeros(len(data), np.uint32)
    wide = data.astype(np.uint32)
    for age in range(min(WINDOW, len(data))):
        out[age:] ^= wide[: len(data) - age] << np.uint32(age)
    return out


def cuts(data: bytes, least: int, average: int, most: int) -> list[int]:
    """Where content-defined chunks end (but for the last one). Nothing for data of at most ``least`` bytes."""
    if least and least < WINDOW:
        raise ValueError(f"chunks of under {WINDOW} bytes can't be detected")
    n = len(data)
    if not least or n <= least:
        return []
    threshold = 0xFFFFFFFF // average if average else 0
    x = sums(np.frombuffer(data, np.uint8)).astype(np.int64)
    away = np.where(x >= 1 << 31, x - (1 << 32), x) - CENTRE
    wrapped = (away + (1 << 31)) % (1 << 32) - (1 << 31)  # two's complement, in which the least number stays negative
    size = np.where(wrapped == -(1 << 31), wrapped, np.abs(wrapped))
    limit = threshold - (1 << 32) if threshold >= 1 << 31 else threshold
    hits = np.flatnonzero(size < limit)
    out, last = [], 0
    while n - last > least:
        start, hard = last + least, last + most
        k = np.searchsorted(hits, start)
        if k < len(hits) and hits[k] < min(hard, n):
            last = int(hits[k])
        elif hard <= n:
            last = hard
        else:
            break
        out.append(last)
    return out


def content_defined(files: DataFrame, least: int, average: int, most: int, id_col: str = "path", data: str = "data") -> DataFrame:
    """(id_col, idx, offset, size, hash): the content-defined chunks of each file, or the whole file as one; hash is
    SHA-1 of the raw piece. Null data gives nothing."""
    kind = dict(files.dtypes)[id_col]

    def run(batches):
        for b in batches:
            rows = []
            for k, v in enumerate(b.column(1)):
                raw = v.as_py()
                if raw is not None:
                    ends = [*cuts(raw, least, average, most), len(raw)]
                    rows += [(k, i, s, e - s, hashlib.sha1(raw[s:e]).hexdigest()) for i, (s, e) in enumerate(zip([0, *ends], ends))]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int32(), pa.int64(), pa.int64(), pa.string())))], ["id", "idx", "offset", "size", "hash"])

    return files.select(F.col(id_col).alias("id"), F.col(data).cast("binary").alias("data")).mapInArrow(run, f"id {kind}, idx int, offset long, size long, hash string").withColumnRenamed("id", id_col)

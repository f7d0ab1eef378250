"""Best-fit packing into sequences of several permitted lengths.

Pieces of one length are interchangeable, so the packing is planned on the histogram of lengths (as many entries as the
largest permitted length, whatever the corpus): lengths in falling order, each piece into the open bin with the least
room that holds it, in bulk over ranges of like bins. Where none is left, bins of that permitted length are opened
whose cost a packed token is least. At the end every bin shrinks to the smallest permitted length that holds its
contents. A piece finds its bin by its rank among the pieces of its length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwerk.llm.common import cut

SIZES = (512, 1024, 2048, 4096)
#: Cost of a sequence besides its tokens, in tokens.
OVERHEAD = 16
#: A frequent length is ranked in so many parts.
SALTS = 64
WORD = r"[^ \t-\r]+"


def token_cost(size: int) -> float:
    return size + OVERHEAD


@dataclass
class Plan:
    """Rules: pieces of length L with rank start <= r < start + bins * per go to bin first + (r - start) // per at
    offset + ((r - start) % per) * L. ends: ranges of like bins with what they hold."""

    rules: dict[int, list[tuple[int, int, int, int, int]]] = field(default_factory=dict)
    ends: list[tuple[int, int, int]] = field(default_factory=list)  # first bin, bins, tokens held
    bins: int = 0


def plan(histogram: dict[int, int], sizes: tuple[int, ...] = SIZES, cost: Callable[[int], float] = token_cost) -> Plan:
    """Best fit over falling lengths for ``histogram`` (length to pieces, lengths up to the largest size)."""
    out, sizes = Plan(), tuple(sorted(sizes))
    rooms: list[int] = []  # sorted room of open bins
    open_bins: dict[int, deque[tuple[int, int, int]]] = {}  # room -> (first, bins, held), longest with that room first

    def put(room: int, first: int, bins: int, held: int, back: bool = False) -> None:
        if bins:
            if room not in open_bins:
                insort(rooms, room)
                open_bins[room] = deque()
            (open_bins[room].appendleft if back else open_bins[room].append)((first, bins, held))

    for length in sorted((x for x, n in histogram.items() if n > 0 and x > 0), reverse=True):
        if length > sizes[-1]:
            raise ValueError(f"a piece of {length} tokens fits no permitted length")
        left, rank, rules = histogram[length], 0, []

        def fill(room: int, first: int, bins: int, held: int) -> None:
            """Put pieces into like bins, as many a bin as go in."""
            nonlocal left, rank
            for per in (room // length, left % (room // length)):
                n = min(bins, left // per) if per else 0
                if n:
                    rules.append((rank, n, per, first, held))
                    put(room - per * length, first, n, held + per * length)
                    rank, left, first, bins = rank + n * per, left - n * per, first + n, bins - n
            put(room, first, bins, held, back=True)

        while left and (at := bisect_left(rooms, length)) < len(rooms):
            room = rooms[at]
            first, bins, held = open_bins[room].popleft()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
            fill(room, first, bins, held)
        while left:
            fitting = [s for s in sizes if s >= length]
            size = min(fitting, key=lambda s: (cost(s) / (s // length * length), -s))
            bins = left // (size // length)
            if not bins:  # fewer than fill one: the cheapest that takes them all
                size, bins = min((s for s in fitting if s // length >= left), key=lambda s: (cost(s), s)), 1
            first, out.bins = out.bins, out.bins + bins
            fill(size, first, bins, 0)
        out.rules[length] = rules
    out.ends = sorted(x for ranges in open_bins.values() for x in ranges)
    return out


class Places:
    """A plan as arrays, to look up many pieces at once."""

    def __init__(self, p: Plan, sizes: tuple[int, ...]):
        rows = [(length << 40 | start, start, per, first, held) for length, rules in p.rules.items() for start, _, per, first, held in rules]
        self.rules = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.first = np.array([e[0] for e in p.ends], np.int64)
        held = np.array([e[2] for e in p.ends], np.int64)
        self.held, self.size = held, np.array(sorted(sizes))[np.searchsorted(sorted(sizes), held)] if len(held) else held

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        if not len(length):
            return (length,) * 4
        _, start, per, first, held = self.rules[np.searchsorted(self.rules[:, 0], length << 40 | rank, "right") - 1].T
        bins = first + (rank - start) // per
        at = np.searchsorted(self.first, bins, "right") - 1
        return bins, held + (rank - start) % per * length, self.size[at], self.held[at]


def pack(rows: DataFrame, id_col: str, length: str, sizes: tuple[int, ...] = SIZES, cost: Callable[[int], float] = token_cost) -> DataFrame:
    """(id_col, piece int, start long, n_tokens int, bin_id long, bin_offset int, bin_size int, bin_tokens int): a row
    for every piece of every row of ``rows``. A row longer than the largest size is cut into pieces of that size and a
    rest; a piece takes bin_offset to bin_offset + n_tokens of its bin, and bin_size is a permitted size.

    Defined cases: a null or zero length gives one row with n_tokens 0 and no bin; null ids and repeated rows are
    packed like any other; ranks are written down once, so that a lost executor changes no bin; other columns aren't
    looked at; an empty table gives an empty result.
    """
    top = max(sizes)
    base = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("n"))
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / top) - 1, F.lit(0).cast("long")))).alias("piece")
    pieces = base.select("id", "n", piece).withColumn("len", F.least(F.col("n") - F.col("piece") * top, F.lit(top)).cast("long"))
    salt = F.pmod(F.xxhash64("id", "piece"), F.lit(SALTS)).cast("int")
    parts = pieces.select("id", "piece", "len", salt.alias("salt"))
    place = F.row_number().over(Window.partitionBy("len", "salt").orderBy("id", "piece")) - 1
    ranked = cut(parts.withColumn("place", place.cast("long")))
    counts = ranked.groupBy("len", "salt").agg(F.count("*").alias("c"))  # SALTS rows a length
    bases = cut(counts.select("len", "salt", "c", (F.sum("c").over(Window.partitionBy("len").orderBy("salt")) - F.col("c")).alias("base")))
    histogram = {r.len: r.c for r in bases.groupBy("len").agg(F.sum("c").alias("c")).collect()}  # a row a length
    places = Places(plan({k: v for k, v in histogram.items() if k}, sizes, cost), tuple(sizes))
    sent = rows.sparkSession.sparkContext.broadcast(places)
    full = ranked.join(bases.select("len", "salt", "base"), ["len", "salt"]).select("id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * top).alias("start"), "len", (F.col("place") + F.col("base")).alias("rank"))
    id_type = dict(base.dtypes)["id"]

    def run(batches):
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(4).to_numpy()
            none = length == 0
            found = [np.zeros(len(length), np.int64) for _ in range(4)]
            for to, x in zip(found, sent.value(length[~none], rank[~none])):
                to[~none] = x
            made = [pa.array(x, t, mask=none) for x, t in zip(found, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3).cast(pa.int32()), *made], ["id", "piece", "start", "n_tokens", "bin_id", "bin_offset", "bin_size", "bin_tokens"])

    return full.mapInArrow(run, f"id {id_type}, piece int, start long, n_tokens int, bin_id long, bin_offset int, bin_size int, bin_tokens int").withColumnRenamed("id", id_col)


def pack_texts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """pack() with words between ASCII white space as tokens."""
    return pack(docs.select(F.col(id_col).alias("id"), F.regexp_count(F.col(text), F.lit(WORD)).alias("n")), "id", "n", sizes).withColumnRenamed("id", id_col)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Shards of near-equal bytes by fixed virtual slots, with DataFrame functions only.

Every record hashes into one of SLOTS slots for good; bytes and rows are summed by slot (SLOTS rows whatever the
corpus); a versioned map says which shard a slot belongs to. Rebalancing edits the map: it moves or swaps the slots
that narrow the gap between the heaviest and the lightest shard, and writes a new version. Records are never hashed
anew, and only those of edited slots move.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwerk.llm.common import cut, shared_dir

#: Fixed for the life of a corpus.
SLOTS = 8192


@dataclass(frozen=True)
class SlotMap:
    """Shard by slot, its version, and the slots that this version moved."""

    version: int
    shards: int
    shard: tuple[int, ...]
    moved: tuple[int, ...] = ()

    @classmethod
    def first(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(1, shards, tuple(s % shards for s in range(slots)))

    def loads(self, size: list[int]) -> list[int]:
        out = [0] * self.shards
        for s, to in enumerate(self.shard):
            out[to] += size[s]
        return out

    def rebalanced(self, size: list[int], tolerance: float = 1e-4, edits: int = 100_000) -> SlotMap:
        """The next version: the heaviest shard gives slots to the lightest, or swaps with it, while that narrows the
        gap and the gap is over ``tolerance`` of a shard's mean."""
        shard, load = list(self.shard), self.loads(size)
        slots: list[list[tuple[int, int]]] = [[] for _ in range(self.shards)]
        for s, to in enumerate(shard):
            if size[s]:
                insort(slots[to], (size[s], s))
        limit = tolerance * sum(load) / max(1, self.shards)
        for _ in range(edits):
            heavy, light = max(range(self.shards), key=load.__getitem__), min(range(self.shards), key=load.__getitem__)
            gap = load[heavy] - load[light]
            if gap <= limit:
                break
            best: tuple[int, tuple[int, int], tuple[int, int] | None] | None = None
            tried = [None] if gap > 4 * (slots[heavy][-1][0] if slots[heavy] else 0) else [None, *slots[light]]
            for back in tried:
                want = gap // 2 + (back[0] if back else 0)
                at = bisect_left(slots[heavy], (want, -1))
                for give in slots[heavy][max(0, at - 1) : at + 1]:
                    net = give[0] - (back[0] if back else 0)
                    if 0 < net < gap and (best is None or abs(gap - 2 * net) < best[0]):
                        best = (abs(gap - 2 * net), give, back)
            if best is None:
                break
            for x, a, b in ((best[1], heavy, light), (best[2], light, heavy)):
                if x:
                    slots[a].remove(x)
                    insort(slots[b], x)
                    shard[x[1]] = b
                    load[a] -= x[0]
                    load[b] += x[0]
        return SlotMap(self.version + 1, self.shards, tuple(shard), tuple(s for s, (a, b) in enumerate(zip(self.shard, shard)) if a != b))

    def grown(self, size: list[int], shards: int) -> SlotMap:
        """The next version with more shards: each new shard takes slots from the heaviest ones until it has its
        share; no slot moves between old shards."""
        shard, load = list(self.shard), [*self.loads(size), *[0] * (shards - self.shards)]
        slots = [sorted((size[s], s) for s, to in enumerate(shard) if to == k) for k in range(self.shards)]
        mean = sum(load) / shards
        for new in range(self.shards, shards):
            while any(slots):
                heavy = max((k for k in range(self.shards) if slots[k]), key=load.__getitem__)
                at = min(len(slots[heavy]) - 1, bisect_left(slots[heavy], (int(mean - load[new]) + 1, -1)))
                give = slots[heavy][at]
                if load[new] + give[0] > mean and at:
                    give = slots[heavy][at - 1]
                if load[new] + give[0] > mean:
                    break
                slots[heavy].remove(give)
                shard[give[1]] = new
                load[heavy] -= give[0]
                load[new] += give[0]
        return SlotMap(self.version + 1, shards, tuple(shard), tuple(s for s, (a, b) in enumerate(zip(self.shard, shard)) if a != b))

    def table(self, spark: SparkSession, first: list[int] | None = None) -> DataFrame:
        """(version, slot, shard, first): a row a slot; first: rows of the shard in slots before this one."""
        listed = lambda x: F.split(F.lit(",".join(map(str, x))), ",")[F.col("id").cast("int")]
        first = first or [0] * len(self.shard)
        return spark.range(len(self.shard)).select(F.lit(self.version).alias("version"), F.col("id").alias("slot"), listed(self.shard).cast("int").alias("shard"), listed(first).cast("long").alias("first"))


def save(spark: SparkSession, m: SlotMap, path: str) -> None:
    """Add a version to the map stored at ``path``."""
    m.table(spark).withColumn("shards", F.lit(m.shards)).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A version (by default the latest) of the map stored at ``path``: SLOTS rows."""
    stored = spark.read.parquet(path)
    version = version if version is not None else stored.agg(F.max("version")).first()[0]
    rows = sorted((r.slot, r.shard, r.shards) for r in stored.where(F.col("version") == version).collect())
    return SlotMap(version, rows[0][2], tuple(r[1] for r in rows))


def slotted(docs: DataFrame, text: str = "text", id_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """(id, size, crc, vslot): a record's bytes plus 1, the CRC-32 of its text, its slot for good."""
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"), F.crc32(raw).alias("crc"))
    key = F.when(F.col("id").isNotNull(), F.xxhash64("id")).otherwise(F.xxhash64("crc", "size"))
    return rows.withColumn("vslot", F.pmod(key, F.lit(slots)))


def assign(docs: DataFrame, shards: int = 8, text: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """A row for every row of ``docs``: id_col, size, text_crc32, law 'bytes', shard, slot (its place in the shard,
    gapless from 0), grown_shard (null: that law says nothing of growth), virtual_slot, map_version.

    The map's versions are stored at ``path`` (default: a new folder in the shared one). Defined cases: null text has
    no bytes (size 1, CRC of nothing); a null id is hashed by size and CRC instead; equal ids share a virtual slot;
    other columns aren't looked at; an empty table gives an empty result. Shards' bytes differ by less than 0.01 % of
    their mean, or by about a record's size if that is more.
    """
    spark = docs.sparkSession
    rows = cut(slotted(docs, text, id_col))
    size, count = [0] * SLOTS, [0] * SLOTS
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():  # SLOTS rows at most
        size[r.vslot], count[r.vslot] = r.b, r.n
    m = SlotMap.first(shards)
    path = path or f"{shared_dir(spark)}/slot-maps/{uuid4().hex}"
    save(spark, m, path)
    m = m.rebalanced(size)
    save(spark, m, path)
    first, filled = [0] * SLOTS, [0] * shards
    for s, to in enumerate(m.shard):
        first[s], filled[to] = filled[to], filled[to] + count[s]
    slots = F.broadcast(m.table(spark, first))  # SLOTS rows
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("id", "crc", "size"))
    found = rows.withColumn("place", place).join(slots, F.col("vslot") == F.col("slot"))
    return found.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("place") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"),
        F.col("version").alias("map_version"),
    )


def op2_shards(spark, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""The place of every row in one order over a whole table, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwerk.plans.lineage import checkpointed

WITHIN = 33


def placed(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """``df`` with the place (from 1) of each row in the given order: a range-partitioned sort, the rows of each partition
    counted, and the places of a partition moved by what comes before it. Rows that tie get places in any order."""
    checkpointed(df.sparkSession)
    rows = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_at", WITHIN).alias("_part")
    counts = rows.groupBy(part).agg(F.count("*").alias("_n"))  # a row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit((1 << WITHIN) - 1))
    joined = rows.withColumn("_part", F.shiftright("_at", WITHIN)).join(F.broadcast(starts), "_part")
    return joined.select(*df.columns, (F.col("_before") + within + 1).alias(name))

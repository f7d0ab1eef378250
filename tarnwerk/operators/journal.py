"""Logs: what a sequence of records says in the end, and how long its steps took."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwerk.schemas import NEXT, TERMINAL, transitions


def latest(records: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """(key, value, first_seq): the last value of each key and where the key came first."""
    return records.groupBy(key).agg(F.max_by(value, seq).alias(value), F.min(seq).alias("first_seq"))


def incomplete(records: DataFrame, key: str = "txn_id", seq: str = "seq", phase: str = "phase") -> DataFrame:
    """Transactions whose last phase is prepare or warm."""
    return latest(records, key, seq, phase).where(F.col(phase).isin("prepare", "warm"))


def recovery_action(phase: Column) -> Column:
    return F.when(phase == "warm", "commit").when(phase == "prepare", "abort")


def check_transitions(rows: DataFrame, a: str = "from", b: str = "to") -> DataFrame:
    """``rows`` with verdict: 'ok', 'invalid' or 'unknown' (no such state to come from)."""
    allowed = F.broadcast(transitions(rows.sparkSession).select(F.col("from").alias("_a"), F.col("to").alias("_b")))  # 20 rows
    known = [*NEXT, *TERMINAL]
    found = rows.join(allowed, (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b")), "left")
    verdict = F.when(F.col("_b").isNotNull(), "ok").when(F.col(a).isin(known), "invalid").otherwise("unknown")
    return found.withColumn("verdict", verdict).drop("_a", "_b")


def is_terminal(state: Column) -> Column:
    return state.isin(TERMINAL)


def elapsed(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """``rows`` with the microseconds since the record before of the same key."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at, tie))
    return rows.withColumn("elapsed_us", F.timestamp_diff("MICROSECOND", before, F.col(at)))


def runs_of(rows: DataFrame, key: str, order: list[str], hit: Column, least: int) -> DataFrame:
    """Runs of at least ``least`` consecutive hits of each key: (key, run, n). Anything else ends a run."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.select(key, *order, hit.alias("_hit")).withColumn("run", F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(w))
    return marked.where("_hit").groupBy(key, "run").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def until_terminal(events: DataFrame, key: str, seq: str, terminal: Column) -> DataFrame:
    """Each key's events up to and including its first terminal one."""
    end = events.where(terminal).groupBy(F.col(key).alias("_k")).agg(F.min(seq).alias("_end"))
    return events.join(end, F.col(key) == F.col("_k"), "left").where(F.col("_end").isNull() | (F.col(seq) <= F.col("_end"))).drop("_k", "_end")


def newest(rows: DataFrame, key: str, seq: str, n: int) -> DataFrame:
    """The n keys put last, with when."""
    return rows.groupBy(key).agg(F.max(seq).alias("last_put")).orderBy(F.desc("last_put"), key).limit(n)


def histogram(rows: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """(le, n): how many values are at most each bound, and +inf as null; one pass, one row a bound."""
    sums = rows.agg(*[F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("all"))
    parts = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.coalesce(f"b{i}", F.lit(0)).cast("long").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(None).cast("double").alias("le"), F.col("all").alias("n")))
    return sums.select(F.explode(parts).alias("x")).select("x.*")


def for_recovery(jobs: DataFrame, most: int = 3) -> DataFrame:
    """Unfinished jobs start again from 'incoming' with one more recovery, or fail once they have had ``most``."""
    spent = F.col("recovery_count") >= most
    again = jobs.where(~is_terminal(F.col("state")))
    return again.select("id", F.when(spent, "failed").otherwise("incoming").alias("state"), F.when(spent, F.col("recovery_count")).otherwise(F.col("recovery_count") + 1).alias("recovery_count"), F.when(spent, F.col("state")).alias("failed_at_state"))

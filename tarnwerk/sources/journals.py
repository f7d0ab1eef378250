"""Appending to logs: upload logs, transaction logs, checksummed journals.

A log is a folder with a numbered folder for each append, which appears by a rename once it is written; the readers in
``logs`` take the folder's path. Files sort by append, then by the order asked for, so (file, line_no) is the log's order.
There is one writer at a time.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwerk.functions import bits


def append(rows: DataFrame, path: str, line: Column, *order: str | Column) -> int:
    """Append ``line`` of every row in ``order``; the number of this append, from 0."""
    spark = rows.sparkSession
    at = lambda *p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((path.rstrip("/"), *p)))
    fs = at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at())] if fs.exists(at()) else []
    number = max((int(n[2:]) for n in names if n.startswith("n=")), default=-1) + 1
    staged = f"_staged-{uuid4().hex}"
    rows.orderBy(*order).select(line.alias("value")).write.text(f"{path.rstrip('/')}/{staged}")
    if not fs.rename(at(staged), at(f"n={number:012d}")):
        raise OSError(f"append {number} to {path} could not be committed")
    return number


def append_upload_log(objects: DataFrame, path: str, *order: str | Column) -> int:
    """A record (hash, time) for every row of ``objects`` (hash, at timestamp)."""
    stamp = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("time")
    return append(objects, path, F.to_json(F.struct("hash", stamp)), *order)


def append_txn_log(records: DataFrame, path: str, *order: str | Column) -> int:
    """A record of a phase for every row of ``records`` (txn_id, repo, phase, target_root_hash, gc_pin, at)."""
    return append(records, path, F.to_json(F.struct("txn_id", "repo", "phase", "target_root_hash", "gc_pin", "at")), *order)


def append_journal(entries: DataFrame, path: str, *order: str | Column) -> int:
    """A checksummed line for every row of ``entries`` (t, job_id, from, to, run_id, note)."""
    return append(entries, path, bits.crc_line(F.to_json(F.struct("t", "job_id", "from", "to", "run_id", "note"))), *order)

"""Where lineage is cut to."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def checkpointed(spark: SparkSession) -> None:
    """Make sure that there is a checkpoint folder: the one in spark.checkpoint.dir, or else one of our own (a temporary
    one in local mode only)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", "")
    local = sc.master == "local" or sc.master.startswith("local[")
    sc.setCheckpointDir(named or (tempfile.mkdtemp(prefix="tarnwerk-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"))

"""Helpers that the operators of this subpackage share: the shared folder, lineage cuts, joins that tolerate hot keys."""

from __future__ import annotations

import gc
import tempfile

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, one of our own (a temporary one in local mode
    only, a folder of the warehouse otherwise)."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return str(found.get()).rsplit("/", 1)[0]
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named:
        local = sc.master.startswith("local[") or sc.master == "local"
        named = tempfile.mkdtemp(prefix="tarnwerk-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tarnwerk"
    sc.setCheckpointDir(named)
    return named


#: Spark's own setting that removes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there; a lost executor costs a reread, not a recomputation. The
    shuffle files on the way are removed as soon as it is written, and so are earlier steps that nothing refers to any more;
    the collection also keeps the driver's heap from growing to its limit over many steps."""
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        made = df.select("*").checkpoint(eager=True)  # a new query, for a query takes the setting when it is made
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    # A checkpoint keeps the planner's guess of its size, and a join's guess is the product of its sides: over rounds of
    # joins the number gets so many digits that the driver takes minutes and its memory to multiply it.
    plan = made._jdf.queryExecution()
    if plan.optimizedPlan().stats().sizeInBytes() >= 1 << 62:
        made = DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.logical().rdd(), made._jdf.schema(), False), spark)
    release(spark)
    return made


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the checkpoints that nothing refers to any more, and give the driver's free memory back:
    that of the heap by the collection, and that outside it, which plans and their compilation leave in many arenas."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Whether the driver's JVM gave its free memory outside the heap back; Java 17.0.9 and later on Linux can."""
    gateway = spark.sparkContext._gateway
    jvm = gateway.jvm
    try:
        # by reflection on the interface, for the server's own class is not open to Py4J
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = gateway.new_array(jvm.java.lang.Object, 4)
        given[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given[1] = "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return False
    return True


def far_key(c: Column) -> Column:
    """A one-to-one image of a long. Joining on it makes both sides pass a fresh exchange, also where one side comes
    from an aggregate over the same key, so that adaptive execution can split a hot key."""
    return c.bitwiseXOR(F.lit(0x5851F42D4C957F2D))


def join_hot(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Equi-join on the long column ``on`` that survives hot keys on the left; ``right`` has one row a key."""
    return left.withColumn("_fk", far_key(F.col(on))).join(right.withColumn("_fk", far_key(F.col(on))).drop(on), "_fk", how).drop("_fk")

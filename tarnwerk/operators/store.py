"""The content-addressed store as a table: what is new, what is missing, what is held."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_objects(results: DataFrame, key: list[str], first: str) -> DataFrame:
    """One row a key, the first by ``first``, with how often it came (n) and the repeats (n - 1)."""
    return results.groupBy(*key).agg(F.count("*").alias("n"), (F.count("*") - 1).alias("repeats"), F.min(first).alias(first))


def new_objects(objects: DataFrame, held: DataFrame, key: str = "hash") -> DataFrame:
    return objects.join(held.select(key).distinct(), key, "left_anti")


def present_objects(objects: DataFrame, held: DataFrame, key: str = "hash") -> DataFrame:
    return objects.join(held.select(key).distinct(), key, "left_semi")


def with_sizes(wanted: DataFrame, held: DataFrame, key: str = "hash") -> DataFrame:
    """Requested objects with their size, -1 for those not held."""
    return wanted.join(held.groupBy(key).agg(F.max("size").alias("size")), key, "left").withColumn("size", F.coalesce("size", F.lit(-1)).cast("long"))


def sharded(objects: DataFrame, key: str = "hash") -> DataFrame:
    """With the shard that the table is partitioned by."""
    return objects.withColumn("shard", F.substring(key, 1, 2))


def lookup(store: DataFrame, name: str, key: str = "hash") -> DataFrame:
    """A point lookup that prunes to the shard's partition."""
    return store.where((F.col("shard") == name[:2]) & (F.col(key) == name))


def lookup_all(wanted: DataFrame, store: DataFrame, key: str = "hash") -> DataFrame:
    """``wanted`` with whether each name is held, by its shard and name, as a point lookup finds it."""
    there = store.select("shard", key).distinct().withColumn("held", F.lit(True))
    found = sharded(wanted, key).join(there, ["shard", key], "left")
    return found.withColumn("held", F.coalesce("held", F.lit(False))).drop("shard")


def put(objects: DataFrame, path: str, key: str = "hash") -> None:
    """Append the objects that the store at ``path`` doesn't hold yet."""
    spark = objects.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fresh = objects.dropDuplicates([key])
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        fresh = new_objects(fresh, spark.read.parquet(path), key)
    sharded(fresh, key).repartition("shard").write.mode("append").partitionBy("shard").parquet(path)


def requests(missing: DataFrame, per: int, key: str = "hash", by: str = "txn") -> DataFrame:
    """Missing objects of each transaction in requests of ``per``: (by, request, hashes)."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(by).orderBy(key)) - 1
    rows = missing.withColumn("request", (place / per).cast("long"))
    return rows.groupBy(by, "request").agg(F.sort_array(F.collect_list(key)).alias("hashes"))

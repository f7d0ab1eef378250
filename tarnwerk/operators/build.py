"""Whole catalogs: creating, building a tree of them in one pass, changing rows, and an identity that can be repeated."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwerk.functions import bits, paths
from tarnwerk.operators import catalog
from tarnwerk.schemas import CHUNKS, COUNTERS, NESTED, PROPERTIES, STATISTICS

#: The schema that catalogs declare.
SCHEMA, REVISION = "2.5", "7"


def new_catalog(spark: SparkSession, path: str = "", ttl: int = 240, at: int = 0) -> dict[str, DataFrame]:
    """The tables of an empty catalog: its root directory, zero counters, properties."""
    root = spark.range(1).select(F.lit(path).alias("path"), F.lit("dir").alias("type"), F.lit(4096).cast("long").alias("size"), F.lit(0o755).alias("perm"), F.lit(0).alias("n_chunks"), F.lit(None).cast("string").alias("hash"))
    counters = [(path, f"{kind}_{c}", 1 if (kind, c) == ("self", "dir") else 0) for kind in ("self", "subtree") for c in COUNTERS]
    properties = [(path, "schema", SCHEMA), (path, "schema_revision", REVISION), (path, "root_prefix", path), (path, "revision", "0"), (path, "TTL", str(ttl)), (path, "last_modified", str(at))]
    return {
        "catalog": catalog.catalog_rows(root).withColumn("catalog_path", F.lit(path)),
        "chunks": spark.createDataFrame([], CHUNKS),
        "nested_catalogs": spark.createDataFrame([], NESTED),
        "bind_mountpoints": spark.createDataFrame([], NESTED),
        "statistics": spark.createDataFrame(counters, STATISTICS),
        "properties": spark.createDataFrame(properties, PROPERTIES),
    }


@dataclass
class Built:
    """Rows with their catalog, one row of counters a catalog, mounts of catalogs in catalogs, identities."""

    rows: DataFrame
    counters: DataFrame
    mounts: DataFrame
    identities: DataFrame


def identities(rows: DataFrame) -> DataFrame:
    """(catalog_path, n, identity): a digest of a catalog's rows that doesn't depend on their order, from sums that are
    combined map-side, so no catalog is gathered anywhere. Times are left out."""
    key = [c for c in rows.columns if c not in ("catalog_path", "mtime", "mtimens")]
    a, b = F.xxhash64(*key), F.xxhash64(F.lit(1), *key)
    sums = rows.groupBy("catalog_path").agg(F.count("*").alias("n"), F.bit_xor(a).alias("x"), F.bit_xor(b).alias("y"), F.sum(a.cast("decimal(20,0)")).alias("s"), F.sum(b.cast("decimal(20,0)")).alias("t"))
    return sums.select("catalog_path", "n", F.sha1(F.concat_ws(":", *[F.col(c).cast("string") for c in ("n", "x", "y", "s", "t")]).cast("binary")).alias("identity"))


def build(entries: DataFrame, rules: list[tuple[str, bool, bool]], lease: str = "", marker: str = ".marker") -> Built:
    """The catalogs of a release, all at once: paths are put below the lease, missing directories added, split points
    planned, every row given its owner, counters rolled up. A path that comes twice is an error when the rows are read.

    entries: path, type, size, perm, n_chunks, external, n_xattrs, hash.
    """
    prefix = lease and "/" + lease.strip("/")
    placed = entries.withColumn("path", paths.rebase(F.col("path"), F.lit(prefix)))
    above = catalog.missing_directories(placed, placed.where("type = 'dir'")).where(paths.is_below(F.col("path"), F.lit(prefix)) | (F.col("path") == prefix))
    made = above.select("path", F.lit("dir").alias("type"), F.lit(4096).cast("long").alias("size"), F.lit(0o755).alias("perm"), F.lit(0).alias("n_chunks"), F.lit(False).alias("external"), F.lit(0).alias("n_xattrs"), F.lit(None).cast("string").alias("hash"))
    tree = placed.select(made.columns).unionByName(made)
    once = tree.groupBy("path").agg(F.count("*").alias("_n"), F.min(F.struct(*[c for c in tree.columns if c != "path"])).alias("_r"))
    tree = once.select(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("path twice: "), "path"))).otherwise(F.col("path")).alias("path"), "_r.*")
    splits = catalog.plan_splits(placed, rules, prefix, marker)
    rows = catalog.owner(tree, splits)
    # a split directory is the root of its own catalog and a mount point in its owner's
    roots = rows.join(splits, "path", "left_semi").withColumn("catalog_path", F.col("path"))
    every = rows.unionByName(roots.select(rows.columns))
    mounts = catalog.owner(splits, splits, to="catalog_path")
    counters = catalog.self_counters(every.join(mounts.select("path", "catalog_path", F.lit(True).alias("_m")), ["path", "catalog_path"], "left").where("_m is null"))
    nested = mounts.groupBy(F.col("catalog_path").alias("_c")).agg(F.count("*").alias("self_nested"))
    counters = counters.join(nested, F.col("catalog_path") == F.col("_c"), "left").drop("_c").withColumn("self_nested", F.coalesce("self_nested", F.lit(0)).cast("long"))
    return Built(every, catalog.rollup(counters, [*catalog.SELF, "nested"]), mounts, identities(every))


def update_mount(mounts: DataFrame, path: str, identity: str, size: int) -> DataFrame:
    """``mounts`` (path, sha1, size, ...) with one mount pointed at another catalog; none of that path is an error."""
    if not mounts.where(F.col("path") == path).head(1):
        raise KeyError(path)
    here = F.col("path") == path
    return mounts.withColumns({"sha1": F.when(here, identity).otherwise(F.col("sha1")), "size": F.when(here, F.lit(size)).otherwise(F.col("size"))})


def set_property(properties: DataFrame, key: str, value: str) -> DataFrame:
    return properties.withColumn("value", F.when(F.col("key") == key, value).otherwise(F.col("value")))


def insert(rows: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """``rows`` and ``new`` together; a key that comes twice is an error when the result is read."""
    both = rows.unionByName(new)
    twice = both.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")).where("_n > 1")
    checked = both.join(twice, F.col(key) == F.col("_k"), "left")
    return checked.withColumn(key, F.when(F.col("_n").isNotNull(), F.raise_error(F.concat(F.lit("key twice: "), F.col(key).cast("string")))).otherwise(F.col(key))).select(both.columns)


def move_jobs(jobs: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs with their new states, journal lines) after changes (id, to, t, run_id, note), one a job; a change that the
    state machine doesn't allow is an error when the result is read."""
    from tarnwerk.operators.journal import check_transitions

    asked = jobs.select("id", F.col("state").alias("from")).join(changes, "id")
    checked = check_transitions(asked)
    ok = checked.withColumn("to", F.when(F.col("verdict") == "ok", F.col("to")).otherwise(F.raise_error(F.concat(F.lit("no way from "), "from", F.lit(" to "), "to"))))
    record = F.to_json(F.struct("t", F.col("id").cast("string").alias("job_id"), "from", "to", "run_id", "note"))
    lines = ok.select("id", bits.crc_line(record).alias("line"))
    moved = jobs.join(ok.select("id", F.col("to").alias("_to")), "id", "left")
    return moved.withColumn("state", F.coalesce("_to", "state")).drop("_to"), lines

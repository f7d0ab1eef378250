"""The catalogs of a release on disk: made from a build, opened, changed, and finalized as a new version.

A version is a folder with the six tables, all catalogs together, that counts once its marker file is there; readers
take the newest marked one, so a writer that dies leaves nothing to be seen. There is one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwerk.operators import build, catalog
from tarnwerk.schemas import CHUNKS_BY_PATH, NESTED

TABLES = ["catalog", "chunks", "nested_catalogs", "bind_mountpoints", "statistics", "properties"]
COUNTED = [*catalog.SELF, "nested"]
KEY = ["catalog_path", "path"]
MARK = "_DONE"

Tables = dict[str, DataFrame]


def tables_of(built: build.Built, chunks: DataFrame | None = None, ttl: int = 240, at: int = 0) -> Tables:
    """The tables of a build's catalogs, at revision 0. ``chunks``: CHUNKS_BY_PATH, none if left out."""
    spark = built.rows.sparkSession
    here = F.col("catalog_path")
    values = {"schema": F.lit(build.SCHEMA), "schema_revision": F.lit(build.REVISION), "root_prefix": F.when(here != "", here), "revision": F.lit("0"), "TTL": F.lit(str(ttl)), "last_modified": F.lit(str(at))}
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])
    properties = built.rows.select("catalog_path").distinct().select("catalog_path", F.explode(pairs).alias("p")).select("catalog_path", "p.*")
    return {
        "catalog": built.rows,
        "chunks": chunks if chunks is not None else spark.createDataFrame([], CHUNKS_BY_PATH),
        "nested_catalogs": pointed(built.mounts, built.identities),
        "bind_mountpoints": spark.createDataFrame([], NESTED),
        "statistics": counters_kv(built.counters),
        "properties": properties.where("value is not null"),
    }


def pointed(mounts: DataFrame, identities: DataFrame) -> DataFrame:
    """Mounts (catalog_path, path) with the identity of the catalog they lead to, and its rows as size."""
    of = identities.select(F.col("catalog_path").alias("path"), F.col("identity").alias("sha1"), F.col("n").alias("size"))
    return mounts.select(*KEY).join(of, "path", "left").select(*KEY, "sha1", "size")


def counters_kv(counters: DataFrame) -> DataFrame:
    """(catalog_path, counter, value): all 24 counters of every catalog, 0 where ``counters`` has no column or no value."""
    names = [f"{kind}_{n}" for kind in ("self", "subtree") for n in COUNTED]
    value = lambda n: F.coalesce(F.col(n), F.lit(0)).cast("long") if n in counters.columns else F.lit(0).cast("long")
    return counters.select("catalog_path", *[value(n).alias(n) for n in names]).unpivot(["catalog_path"], names, "counter", "value")


def add_counters(statistics: DataFrame, changes: DataFrame) -> DataFrame:
    """``statistics`` after ``changes`` (catalog_path, self_*), which count for the catalogs above as well."""
    known = statistics.select("catalog_path").distinct()
    names = [f"self_{n}" for n in COUNTED]
    given = known.join(changes, "catalog_path", "left")
    own = given.select("catalog_path", *[(F.coalesce(F.col(n), F.lit(0)) if n in changes.columns else F.lit(0)).cast("long").alias(n) for n in names])
    both = statistics.unionByName(counters_kv(catalog.rollup(own, COUNTED)))
    return both.groupBy("catalog_path", "counter").agg(F.sum("value").cast("long").alias("value"))


def upsert(tables: Tables, new: DataFrame, chunks: DataFrame | None = None) -> Tables:
    """``tables`` with the rows of ``new`` (the columns of catalog) in place of those of the same catalog and path.
    Chunk rows of what was replaced go, ``chunks`` come in. A key that comes twice in ``new`` is an error when read."""
    twice = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("path twice: "), F.first("path")))).otherwise(F.lit(1))
    rest = [c for c in new.columns if c not in KEY]
    once = new.groupBy(*KEY).agg(twice.alias("_n"), F.min(F.struct(*rest)).alias("_r")).where("_n = 1").select(*KEY, "_r.*")
    left = remove(tables, new.select(*KEY))
    added = {"catalog": left["catalog"].unionByName(once), "statistics": add_counters(left["statistics"], catalog.self_counters(once))}
    return left | added | ({"chunks": left["chunks"].unionByName(chunks)} if chunks is not None else {})


def remove(tables: Tables, gone: DataFrame) -> Tables:
    """``tables`` without the rows, chunk rows and counts of ``gone`` (catalog_path, path); what isn't there is ignored."""
    keys = gone.select(*KEY).distinct()
    lost = tables["catalog"].join(keys, KEY, "left_semi")
    return tables | {
        "catalog": tables["catalog"].join(keys, KEY, "left_anti"),
        "chunks": tables["chunks"].join(keys, KEY, "left_anti"),
        "statistics": add_counters(tables["statistics"], catalog.self_counters(lost, F.lit(-1))),
    }


def _folder(spark: SparkSession, *path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path("/".join(path))
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The finished versions in a folder, in order."""
    at, fs = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(_folder(spark, path, n, MARK)[0]))


def finalize(tables: Tables, path: str, at: int, touched: DataFrame | None = None) -> int:
    """Write ``tables`` as the next version and return its number. The revision of every catalog goes up by one and
    its last_modified becomes ``at`` (of those in ``touched`` (catalog_path) alone, if given); mounts point to the
    identities of what they lead to now."""
    spark = tables["catalog"].sparkSession
    number = max(versions(spark, path), default=0) + 1
    marked = (touched if touched is not None else tables["properties"]).select("catalog_path").distinct().withColumn("_t", F.lit(True))
    value = F.when(F.col("_t") & (F.col("key") == "revision"), (F.col("value").cast("long") + 1).cast("string"))
    value = value.when(F.col("_t") & (F.col("key") == "last_modified"), F.lit(str(at))).otherwise(F.col("value"))
    properties = tables["properties"].join(marked, "catalog_path", "left").select("catalog_path", "key", value.alias("value"))
    done = tables | {"properties": properties, "nested_catalogs": pointed(tables["nested_catalogs"], build.identities(tables["catalog"]))}
    for name in TABLES:
        done[name].write.mode("overwrite").parquet(f"{path}/v={number}/{name}")
    mark, fs = _folder(spark, path, f"v={number}", MARK)
    fs.create(mark, True).close()
    return number


def open_release(spark: SparkSession, path: str, version: int | None = None) -> Tables:
    """The tables of a finished version, the newest by default; none there is an error."""
    there = versions(spark, path)
    if not there or (version is not None and version not in there):
        raise FileNotFoundError(f"no version {version or ''} in {path}")
    return {name: spark.read.parquet(f"{path}/v={version or there[-1]}/{name}") for name in TABLES}


def root_prefixes(tables: Tables) -> DataFrame:
    """(catalog_path, root_prefix), empty for a catalog without that property."""
    found = F.max(F.when(F.col("key") == "root_prefix", F.col("value")))
    return tables["properties"].groupBy("catalog_path").agg(F.coalesce(found, F.lit("")).alias("root_prefix"))


def mounts_of(tables: Tables) -> DataFrame:
    """Mounted catalogs and bind mounts together."""
    return tables["nested_catalogs"].unionByName(tables["bind_mountpoints"])

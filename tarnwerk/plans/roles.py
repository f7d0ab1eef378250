"""The driver's tables in the roles of the data model, as DataFrames and as SQL views of the same content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwerk.operators import catalog
from tarnwerk.plans.registry import Tables

RULES = "/src1*\n/*/de\n! /src3/*\n"


def entries(t: Tables) -> DataFrame:
    """Documents as files: /source/lang/doc_id."""
    p = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    return t.documents.select(
        F.col("doc_id").alias("seq"), p.alias("path"), F.lit("reg").alias("type"), F.lit(0o644).alias("perm"), F.col("text").cast("binary").alias("data"), F.octet_length("text").cast("long").alias("size"),
        F.sha1(F.col("text").cast("binary")).alias("hash"), F.when(F.octet_length("text") > 8192, F.ceil(F.octet_length("text") / 8192)).otherwise(0).cast("int").alias("n_chunks"),
        (F.col("doc_id") % 50 == 0).alias("external"), F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0).alias("n_xattrs"),
    )


ENTRIES = """e AS (
  SELECT doc_id AS seq, '/' || source || '/' || lang || '/' || doc_id AS path, 'reg' AS type, strlen(text) AS size, sha1(text) AS hash,
    CASE WHEN strlen(text) > 8192 THEN ceil(strlen(text) / 8192.0) ELSE 0 END::INT AS n_chunks, doc_id % 50 = 0 AS external,
    CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS n_xattrs, text FROM documents
)"""


def tree(t: Tables) -> DataFrame:
    """Files and all directories above them, as entries with a type, size, chunks, external, attributes."""
    files = entries(t).select("path", "type", "size", "n_chunks", "external", "n_xattrs", "hash")
    dirs = catalog.directories(files).select("path", F.lit("dir").alias("type"), F.lit(4096).cast("long").alias("size"), F.lit(0).alias("n_chunks"), F.lit(False).alias("external"), F.lit(0).alias("n_xattrs"), F.lit(None).cast("string").alias("hash"))
    return files.unionByName(dirs)


TREE = (
    ENTRIES
    + """, parts AS (SELECT path, string_split(path, '/') AS s FROM e),
dirs AS (SELECT DISTINCT array_to_string(list_slice(s, 1, i), '/') AS path FROM (SELECT s, unnest(range(1, len(s))) AS i FROM parts)),
tree AS (
  SELECT path, type, size, n_chunks, external, n_xattrs, hash FROM e
  UNION ALL SELECT path, 'dir', 4096, 0, false, 0, NULL FROM dirs
)"""
)


def splits(t: Tables) -> DataFrame:
    return catalog.plan_splits(entries(t), catalog.parse_rules(RULES), "", ".marker")


SPLITS = (
    TREE
    + """, splits AS (
  SELECT path FROM dirs WHERE path <> '' AND (regexp_matches(path, '^/src1[^/]*$') OR regexp_matches(path, '^/[^/]*/de$')) AND NOT regexp_matches(path, '^/src3/[^/]*$')
)"""
)

OWNED = (
    SPLITS
    + """, owned AS (
  SELECT tree.*, coalesce((SELECT arg_max(s.path, length(s.path)) FROM splits s WHERE starts_with(tree.path, s.path || '/')), '') AS catalog_path FROM tree
)"""
)


def owned(t: Tables) -> DataFrame:
    return catalog.owner(tree(t), splits(t))


def objects(t: Tables) -> DataFrame:
    """Manifest objects: the parts of each order. (txn, hash as text)."""
    return t.lineitem.select(F.col("l_orderkey").alias("txn"), F.lpad(F.lower(F.hex("l_partkey")), 8, "0").alias("hash")).distinct()


OBJECTS = "o AS (SELECT DISTINCT l_orderkey AS txn, printf('%08x', l_partkey) AS hash FROM lineitem)"


def held(t: Tables) -> DataFrame:
    """What a replica holds: the parts of orders before a day, with their size."""
    early = t.orders.where("o_orderdate < timestamp_ntz'1993-01-01'").select("o_orderkey")
    parts = t.lineitem.join(early, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_partkey").distinct()
    return parts.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.lpad(F.lower(F.hex("l_partkey")), 8, "0").alias("hash"), (F.col("p_size") * 1024).cast("long").alias("size"))


HELD = """held AS (
  SELECT DISTINCT printf('%08x', l_partkey) AS hash, (p_size * 1024)::BIGINT AS size FROM lineitem JOIN part ON p_partkey = l_partkey
  WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01')
)"""

PHASES = {"view": "prepare", "click": "warm", "purchase": "commit", "error": "abort", "signup": "prepare"}


def records(t: Tables) -> DataFrame:
    """Transaction log: events as phases of their user's transaction."""
    phase = F.element_at(F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv]), F.col("event_type"))
    return t.events.select(F.col("user_id").alias("txn_id"), F.col("event_id").alias("seq"), phase.alias("phase"), F.col("ts").alias("at"))


RECORDS = "r AS (SELECT user_id AS txn_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'prepare' WHEN 'click' THEN 'warm' WHEN 'purchase' THEN 'commit' WHEN 'error' THEN 'abort' WHEN 'signup' THEN 'prepare' END AS phase, ts AS at FROM events)"


def jobs(t: Tables) -> DataFrame:
    """Orders as jobs."""
    state = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "staging").otherwise("leased")
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("repo"), state.alias("state"), F.col("o_orderdate").alias("created_at"),
        F.timestamp_add("SECOND", (F.col("o_orderkey") % 600).cast("int"), F.col("o_orderdate")).alias("updated_at"), F.floor("o_totalprice").cast("long").alias("tar_size"), (F.col("o_orderkey") % 5).cast("int").alias("recovery_count"),
    )


JOBS = """j AS (
  SELECT o_orderkey AS id, o_custkey AS repo, CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'staging' ELSE 'leased' END AS state,
    o_orderdate AS created_at, o_orderdate + to_seconds((o_orderkey % 600)::INT) AS updated_at, floor(o_totalprice)::BIGINT AS tar_size, (o_orderkey % 5)::INT AS recovery_count FROM orders
)"""

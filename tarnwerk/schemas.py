"""Schemas and static relations of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "archive string, seq long, path string, type string, mode int, mtime timestamp, size long, data binary, link_target string, uid long, gid long, xattrs map<string,binary>"
CHUNK = "path string, idx int, offset long, size long, hash string, compressed binary, comp_size long"
CATALOG = "catalog_path string, md5path_1 long, md5path_2 long, parent_1 long, parent_2 long, hardlinks long, hash binary, size long, mode long, mtime long, mtimens long, flags long, name string, symlink string, uid long, gid long, xattr binary"
CHUNKS = "catalog_path string, md5path_1 long, md5path_2 long, offset long, size long, hash binary"
CHUNKS_BY_PATH = "catalog_path string, path string, idx int, offset long, size long, hash string"
NESTED = "catalog_path string, path string, sha1 string, size long"
STATISTICS = "catalog_path string, counter string, value long"
PROPERTIES = "catalog_path string, key string, value string"
OBJECT = "struct<hash:string,size:long,suffix:string>"
MANIFEST = f"transaction_id string, repo string, base_root_hash string, target_root_hash string, base_urls array<string>, generator string, auth string, created_at timestamp, total_size long, provisional boolean, objects array<{OBJECT}>"
JOURNAL = "t timestamp, job_id string, `from` string, `to` string, run_id string, note string"
TXN = "txn_id string, repo string, phase string, target_root_hash string, gc_pin string, at timestamp"
JOB = "id string, repo string, path string, package_name string, tar_path string, tar_name string, tar_size long, tar_sha256 string, state string, created_at timestamp, updated_at timestamp, n_objects int, n_new_objects int, n_bytes_raw long, n_bytes_compressed long, error string, failed_at_state string, recovery_count int, tag_name string, new_root_hash string"

#: Job states in the order of a run, the terminal ones, and the transitions that are allowed.
STATES = ["incoming", "staging", "uploading", "distributing", "leased", "committing", "published", "aborted", "failed"]
TERMINAL = ["published", "aborted", "failed"]
NEXT = {
    "incoming": ["staging", "leased", "aborted", "failed"],
    "staging": ["uploading", "aborted", "failed"],
    "uploading": ["leased", "distributing", "aborted", "failed"],
    "distributing": ["leased", "aborted", "failed"],
    "leased": ["committing", "aborted", "failed"],
    "committing": ["published", "aborted", "failed"],
}
#: What a catalog counts, for itself and for everything below it.
COUNTERS = ["chunked", "chunked_size", "chunks", "dir", "external", "external_file_size", "file_size", "nested", "regular", "special", "symlink", "xattr"]

def transitions(spark: SparkSession) -> DataFrame:
    """(from, to): the allowed transitions, a table of fixed size."""
    return spark.createDataFrame([(a, b) for a, to in NEXT.items() for b in to], "`from` string, `to` string")


def numbered(names: list[str]):
    """Position of a name column's value in a fixed list, from 0; null if it isn't there."""
    return lambda c: F.nullif(F.array_position(F.array(*map(F.lit, names)), c), F.lit(0)) - 1

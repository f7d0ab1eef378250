"""Logs and manifests in text: checksummed journals, transaction logs, manifests by line, repository manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwerk.functions import bits
from tarnwerk.schemas import JOB, JOURNAL, TXN


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): the lines of small text files with their number; a whole file is one row first, so the
    order is the file's. The last flag says whether the line ended with a line feed."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = whole.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "value"), (F.size(F.split("value", "\n")) - 1).alias("_n"))
    return rows.where("not (line_no = _n and value = '')").withColumn("ended", F.col("line_no") < F.col("_n")).drop("_n")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Records of a checksummed journal; a line with a bad prefix, checksum or body is an error."""
    rows = lines(spark, path).where("value <> ''")
    payload = F.substr(F.col("value"), F.lit(10))
    body = F.from_json(payload, JOURNAL, {"mode": "PERMISSIVE"})
    good = F.col("value").rlike("^[0-9a-f]{8} ") & (bits.crc_line(payload) == F.col("value")) & F.coalesce(body["job_id"].isNotNull(), F.lit(False))
    return rows.select("file", "line_no", F.when(good, body).otherwise(F.raise_error(F.concat(F.lit("bad journal line "), F.col("line_no").cast("string")))).alias("r")).select("file", "line_no", "r.*")


def read_txn_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of a transaction log; a torn tail (a bad last line without a line feed) is dropped, any other bad line is
    an error."""
    rows = lines(spark, path).where("value <> ''").withColumn("r", F.from_json("value", TXN))
    bad = F.coalesce(F.col("r.txn_id").isNull() | F.col("r.phase").isNull(), F.lit(True))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad record in line "), F.col("line_no").cast("string")))).otherwise(F.col("r"))
    kept = rows.where(~bad | F.col("ended"))
    return kept.select("file", F.col("line_no").cast("long").alias("seq"), checked.alias("r")).select("file", "seq", "r.*")


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job manifests under ``path``/<state>/<job>/manifest.json."""
    return spark.read.schema(JOB).option("multiLine", True).json(f"{path}/*/*/manifest.json")


def read_upload_log(spark: SparkSession, path: str) -> DataFrame:
    """(hash, line_no): distinct non-empty hashes of an upload log in the order they came first."""
    rows = lines(spark, path).select("line_no", F.from_json("value", "hash string")["hash"].alias("hash")).where("hash is not null and hash <> ''")
    return rows.groupBy("hash").agg(F.min("line_no").alias("line_no"))


def read_ndjson_manifest(spark: SparkSession, path: str, most: int = 16 << 20) -> DataFrame:
    """(file, hash, size, suffix): the objects of manifests by line (a header, then an object a line)."""
    rows = lines(spark, path).where("value <> ''")
    first = rows.groupBy("file").agg(F.min("line_no").alias("_first"))
    body = F.when(F.octet_length("value") > most, F.raise_error(F.lit("manifest line too long"))).otherwise(F.from_json("value", "hash string, size long, suffix string"))
    return rows.join(first, "file").where("line_no > _first").select("file", body.alias("o")).select("file", "o.*")


def parse_repo_manifest(text: Column) -> Column:
    """struct<root, algo, repo, revision, ttl> of a repository manifest: lines up to `--`, the first letter is the key;
    the root's suffix names the algorithm. A manifest without root or name is an error."""
    head = F.transform(F.split(F.substring_index(text, "\n--", 1), "\n"), lambda x: F.rtrim(x, F.lit("\r")))
    value = lambda key: F.get(F.transform(F.filter(head, lambda x: x.startswith(key)), lambda x: F.substr(x, F.lit(2))), F.lit(0))
    root, name = value("C"), value("N")
    algo = F.when(root.endswith("-"), 2).when(root.endswith("~"), 3).otherwise(1)
    body = F.struct(F.regexp_replace(root, "[-~]$", "").alias("root"), algo.alias("algo"), name.alias("repo"), value("S").cast("decimal(20,0)").alias("revision"), value("D").cast("long").alias("ttl"))
    return F.when(F.coalesce(root, F.lit("")).eqNullSafe("") | F.coalesce(name, F.lit("")).eqNullSafe(""), F.raise_error(F.lit("manifest without root or name"))).otherwise(body)


def ndjson_lines(manifest: DataFrame, objects: DataFrame) -> DataFrame:
    """(txn, line_no, line): a manifest by line, header first, objects in the order of their hash."""
    from pyspark.sql import Window

    head = manifest.select("txn", F.lit(0).alias("line_no"), F.to_json(F.struct(*[c for c in manifest.columns])).alias("line"))
    place = F.row_number().over(Window.partitionBy("txn").orderBy("hash"))
    return head.unionByName(objects.select("txn", place.alias("line_no"), F.to_json(F.struct("hash", "size")).alias("line")))

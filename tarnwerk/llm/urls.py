"""URL filters by a temporal list join.

A dated list says which host, domain or URL prefix gets which verdict from when on, and when an entry is withdrawn.
Its entries become validity intervals that don't overlap for one key, and every capture is joined with those of its
keys that were valid when it was fetched. The most specific one decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: More specific last.
KINDS = ("domain", "host", "prefix")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without a final dot; null where there is none."""
    found = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when(found != "", found)


def keys_of(url: Column) -> Column:
    """array<struct<kind, value, rank>>: a URL's host, its domains (the host and each suffix of whole labels), and its
    prefixes (host and each leading part of the path that ends with '/', and the whole path). A larger rank is more
    specific."""
    host, path = host_of(url), F.regexp_extract(url, PATH, 1)
    labels, parts = F.split(host, r"\."), F.split(path, "/")
    n, m = F.size(labels), F.size(parts)
    key = lambda kind, value, rank: F.struct(F.lit(kind).alias("kind"), value.alias("value"), rank.cast("int").alias("rank"))
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: key("domain", F.array_join(F.slice(labels, i, n - i + 1), "."), n - i + 1))
    leading = F.transform(F.sequence(F.lit(1), F.greatest(m - 1, F.lit(1))), lambda i: key("prefix", F.concat(host, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")), F.lit(20_000) + i))
    whole = F.array(key("prefix", F.concat(host, path), F.lit(20_000) + m))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(domains, F.array(key("host", host, F.lit(10_000))), leading, whole)))


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, value, verdict, valid_from, valid_to) of a dated list (kind, value, verdict, active boolean, at timestamp).

    An entry holds from ``at`` until the next one for its key, the last one for good (valid_to null). One that isn't
    active withdraws what was there. Of several at one time the last by (active, verdict) holds. Entries without kind,
    value or time say nothing; hosts and domains are compared in lower case. A prefix that ends in '/' covers all that
    begins with it; one that doesn't covers the URL with exactly that path, neither what lies below it nor a longer name.
    """
    lower = F.when(F.col("kind") == "prefix", F.col("value")).otherwise(F.lower("value"))
    rows = entries.select("kind", lower.alias("value"), "verdict", F.coalesce("active", F.lit(False)).alias("active"), F.col("at").cast("timestamp_ntz").alias("valid_from"))
    rows = rows.where("kind is not null and value is not null and valid_from is not null")
    last = rows.groupBy("kind", "value", "valid_from").agg(F.max(F.struct("active", "verdict")).alias("e"))
    order = Window.partitionBy("kind", "value").orderBy("valid_from")
    spans = last.withColumn("valid_to", F.lead("valid_from").over(order))
    return spans.where("e.active").select("kind", "value", F.col("e.verdict").alias("verdict"), "valid_from", "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at", default: str = "allow") -> DataFrame:
    """``captures`` with verdict, matched_kind, matched_value, matched_from: the most specific list entry that was
    active when the URL was fetched (valid_from <= at < valid_to), else ``default`` and nulls.

    Captures of one URL at one time are judged once, so a host or URL with a third of all rows is joined in pieces.
    Defined cases: a URL that is null or has no host and a null time get the default; URLs are compared with their
    prefixes as they are written (the rule for those without a final '/' is in intervals()), hosts in lower case; other columns pass unchanged (those named like the new ones are
    replaced); empty tables on either side are fine.
    """
    new = ["verdict", "matched_kind", "matched_value", "matched_from"]
    kept = captures.drop(*new)
    when = F.col("at").cast("timestamp_ntz")
    plain = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row"), F.col(url).alias("u"), F.col(at).alias("at"))
    plain = plain.select("row", "u", when.alias("t"), F.xxhash64("u", when).alias("h"))
    asked = plain.select("u", "t", "h").distinct().where("u is not null and t is not null")
    keyed = asked.select("u", "t", "h", F.explode(keys_of(F.col("u"))).alias("key")).select("u", "t", "h", "key.*")
    keyed = keyed.withColumn("x", F.xxhash64(F.lit(1), "kind", "value"))
    spans = intervals(entries).select(F.xxhash64(F.lit(1), "kind", "value").alias("x"), F.col("kind").alias("k"), F.col("value").alias("v"), "verdict", "valid_from", "valid_to")
    valid = (F.col("valid_from") <= F.col("t")) & (F.col("valid_to").isNull() | (F.col("t") < F.col("valid_to")))
    same = (keyed["x"] == spans["x"]) & (F.col("kind") == F.col("k")) & (F.col("value") == F.col("v"))
    hits = keyed.join(spans, same & valid)
    best = hits.groupBy("h", "u", "t").agg(F.max_by(F.struct("verdict", "kind", "value", "valid_from"), "rank").alias("e"))
    best = best.select(F.col("h").alias("bh"), F.col("u").alias("bu"), F.col("t").alias("bt"), "e", F.xxhash64("h").alias("y"))
    plain = plain.withColumn("y", F.xxhash64("h"))
    out = plain.join(best, (plain["y"] == best["y"]) & (F.col("u") == F.col("bu")) & (F.col("t") == F.col("bt")), "left")
    return out.select("row.*", F.coalesce("e.verdict", F.lit(default)).alias("verdict"), F.col("e.kind").alias("matched_kind"), F.col("e.value").alias("matched_value"), F.col("e.valid_from").alias("matched_from"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A list over the hosts that occur, dated by letters of the MD5 of the name: blocked domains (the last two labels),
    hosts that are blocked, withdrawn and blocked again, hosts that are allowed within a blocked domain, and blocked
    prefixes (a host's first directory)."""
    hosts = pages.select(F.col("url").alias("u"), host_of(F.col("url")).alias("host")).where("host is not null")
    letter = lambda i: F.ascii(F.substring("m", i, 1))
    day = lambda n: F.timestamp_add("DAY", n, F.lit("2024-01-01").cast("timestamp_ntz"))
    entry = lambda kind, value, verdict, active, at: F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(verdict).alias("verdict"), F.lit(active).alias("active"), at.alias("at"))
    one = hosts.select("host").distinct().withColumn("m", F.md5(F.col("host").cast("binary")))
    since, until = letter(2) * 3 % 120, letter(2) * 3 % 120 + letter(3) % 90 + 1
    a = one.where(letter(1) % 3 == 0).select(F.explode(F.array(entry("host", F.col("host"), "block", True, day(since)), entry("host", F.col("host"), "block", False, day(until)), entry("host", F.col("host"), "block", True, day(until + 100)))).alias("e"))
    b = one.where(letter(1) % 3 == 1).select(entry("host", F.col("host"), "allow", True, day(since)).alias("e"))
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    c = one.select(domain.alias("d")).distinct().withColumn("m", F.md5(F.col("d").cast("binary"))).where(letter(1) % 2 == 0).select(entry("domain", F.col("d"), "block", True, day(letter(4) * 2 % 100)).alias("e"))
    first = F.regexp_extract("u", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*/)", 1)
    d = hosts.select(F.concat("host", first).alias("p"), first.alias("f")).where("f <> ''").select("p").distinct().withColumn("m", F.md5(F.col("p").cast("binary"))).where(letter(1) % 4 == 0).select(entry("prefix", F.col("p"), "block", True, day(letter(5) * 5 % 200)).alias("e"))
    return a.unionByName(b).unionByName(c).unionByName(d).select("e.*")


def op8_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every page as a capture, fetched on a day that its id decides, against dated_list()."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    day = F.coalesce(F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int"), F.lit(0))
    captures = pages.withColumn("fetched_at", F.timestamp_add("DAY", day, F.lit("2024-01-01").cast("timestamp_ntz")))
    return evaluate(captures, dated_list(pages))


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days(coalesce(((page_id * 37 % 365) + 365) % 365, 0)::INT) AS fetched_at,
    nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '.'), '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*/)', 1) AS dir
  FROM pages
), h AS (SELECT host, md5(host) AS m FROM (SELECT DISTINCT host FROM p WHERE host IS NOT NULL)),
hd AS (SELECT *, ascii(m[2]) * 3 % 120 AS since, ascii(m[2]) * 3 % 120 + ascii(m[3]) % 90 + 1 AS until FROM h),
dm AS (SELECT d, md5(d) AS m FROM (SELECT DISTINCT regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS d FROM h)),
px AS (SELECT x, md5(x) AS m FROM (SELECT DISTINCT host || dir AS x FROM p WHERE host IS NOT NULL AND dir <> '')),
e AS (
  SELECT 'host' AS kind, host AS value, 'block' AS verdict, true AS active, since AS d FROM hd WHERE ascii(m[1]) % 3 = 0
  UNION ALL SELECT 'host', host, 'block', false, until FROM hd WHERE ascii(m[1]) % 3 = 0
  UNION ALL SELECT 'host', host, 'block', true, until + 100 FROM hd WHERE ascii(m[1]) % 3 = 0
  UNION ALL SELECT 'host', host, 'allow', true, since FROM hd WHERE ascii(m[1]) % 3 = 1
  UNION ALL SELECT 'domain', d, 'block', true, ascii(m[4]) * 2 % 100 FROM dm WHERE ascii(m[1]) % 2 = 0
  UNION ALL SELECT 'prefix', x, 'block', true, ascii(m[5]) * 5 % 200 FROM px WHERE ascii(m[1]) % 4 = 0
), s AS (
  SELECT kind, value, verdict, active, TIMESTAMP '2024-01-01' + to_days(d::INT) AS valid_from,
    lead(TIMESTAMP '2024-01-01' + to_days(d::INT)) OVER (PARTITION BY kind, value ORDER BY d) AS valid_to FROM e
), u AS (SELECT DISTINCT url, fetched_at, host, path FROM p WHERE host IS NOT NULL),
k AS (
  SELECT url, fetched_at, 'host' AS kind, host AS value, 10000 AS rank FROM u
  UNION ALL SELECT url, fetched_at, 'domain', array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.'), len(string_split(host, '.')) - i + 1
    FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM u)
  UNION ALL SELECT url, fetched_at, 'prefix', host || array_to_string(list_slice(string_split(path, '/'), 1, i), '/') || '/', 20000 + i
    FROM (SELECT *, unnest(range(1, greatest(len(string_split(path, '/')) - 1, 1) + 1)) AS i FROM u)
  UNION ALL SELECT url, fetched_at, 'prefix', host || path, 20000 + len(string_split(path, '/')) FROM u
), m AS (
  SELECT k.url, k.fetched_at, max_by({'verdict': s.verdict, 'kind': s.kind, 'value': s.value, 'f': s.valid_from}, k.rank) AS e
  FROM k JOIN s ON s.kind = k.kind AND s.value = k.value AND s.active AND s.valid_from <= k.fetched_at AND (s.valid_to IS NULL OR k.fetched_at < s.valid_to)
  GROUP BY ALL
)
SELECT p.page_id, p.url, p.fetched_at, coalesce(m.e.verdict, 'allow') AS verdict, m.e.kind AS matched_kind, m.e.value AS matched_value, m.e.f AS matched_from
FROM p LEFT JOIN m ON m.url = p.url AND m.fetched_at = p.fetched_at
"""

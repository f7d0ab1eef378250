"""Queries over scalar functions, checks and projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwerk.functions import bits, paths
from tarnwerk.operators import catalog, distribution, journal
from tarnwerk.plans import roles
from tarnwerk.plans.registry import Tables, query

c = F.col

#: Odd names that every check of names is run on, besides a key of each row.
NAMES = "['', 'a', 'ab', 'abc', 'a/b', 'a+b', 'a#b', 'v1.0.0', 'tag name', 'x_y-z', '../up', 'a/../../b', './file', 'é']"


def _named(t: Tables):
    """(id, s): every event type and part name, and the odd names by turns."""
    odd = F.array(*[F.lit(x) for x in ("", "a", "ab", "abc", "a/b", "a+b", "a#b", "v1.0.0", "tag name", "x_y-z", "../up", "a/../../b", "./file", "é")])
    at = (c("p_partkey") % 28).cast("int")
    return t.part.select(c("p_partkey").alias("id"), F.when(at < 14, F.get(odd, at)).otherwise(c("p_name")).alias("s"))


NAMED = f"n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 28 < 14 THEN ({NAMES})[(p_partkey % 28 + 1)::INT] ELSE p_name END AS s FROM part)"


@query("validate_path", f"WITH {NAMED} SELECT id, s, s = '' OR (NOT starts_with(s, '/') AND NOT list_contains(string_split(s, '/'), '..')) AS ok FROM n")
def _(t):
    return _named(t).select("id", "s", paths.valid_path(c("s")).alias("ok"))


#: Links that climb: from /source/lang/doc, so many steps up.
@query("validate_symlink", "SELECT doc_id, repeat('../', (doc_id % 5)::INT) || 'x' AS target, doc_id % 5 <= 2 AS ok FROM documents")
def _(t):
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), c("doc_id").cast("string"))
    target = F.concat(F.repeat(F.lit("../"), (c("doc_id") % 5).cast("int")), F.lit("x"))
    return t.documents.select("doc_id", target.alias("target"), paths.valid_symlink(path, target).alias("ok"))


@query("size_limit", "SELECT count(*) AS n, sum((strlen(text) > 4096)::INT)::BIGINT AS refused FROM documents")
def _(t):
    over = F.octet_length("text") > 4096
    return t.documents.agg(F.count("*").alias("n"), F.sum(over.cast("long")).alias("refused"))


@query("entry_type_filter", "SELECT event_id FROM events WHERE event_type IN ('view', 'click', 'purchase', 'signup')")
def _(t):
    return t.events.where(c("event_type").isin("view", "click", "purchase", "signup")).select("event_id")


@query("clamp_ids", "SELECT c_custkey, greatest(floor(c_acctbal)::BIGINT, 0) AS uid FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.greatest(F.floor("c_acctbal").cast("long"), F.lit(0).cast("long")).alias("uid"))


@query("duplicate_path_check", "SELECT text AS path, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def _(t):
    from tarnwerk.sources.archives import duplicate_paths

    return duplicate_paths(t.documents.select(c("text").alias("path")))


@query("object_name_check", f"WITH {NAMED} SELECT id, regexp_matches(s, '^[0-9A-Za-z]{{3,}}$') AS ok FROM n")
def _(t):
    return _named(t).select("id", paths.valid_object_name(c("s")).alias("ok"))


@query("repo_name_check", f"WITH {NAMED} SELECT id, length(s) <= 255 AND regexp_matches(s, '^[0-9A-Za-z._-]+$') AS ok FROM n")
def _(t):
    return _named(t).select("id", paths.valid_repo_name(c("s")).alias("ok"))


@query("topic_segment_check", f"WITH {NAMED} SELECT id, s <> '' AND NOT regexp_matches(s, '[/+#]') AS ok FROM n")
def _(t):
    return _named(t).select("id", paths.valid_topic_segment(c("s")).alias("ok"))


@query("tag_name_check", f"WITH {NAMED} SELECT id, s = '' OR (length(s) <= 255 AND regexp_matches(s, '^[A-Za-z0-9._-]+$')) AS ok FROM n")
def _(t):
    return _named(t).select("id", paths.valid_tag(c("s")).alias("ok"))


@query("sanitised_names", f"WITH {NAMED} SELECT id, regexp_replace(s, '[^A-Za-z0-9._-]', '_', 'g') AS safe FROM n")
def _(t):
    return _named(t).select("id", paths.safe_file_name(c("s")).alias("safe"))


@query("is_terminal", f"WITH {roles.JOBS} SELECT state IN ('published', 'aborted', 'failed') AS terminal, count(*) AS n FROM j GROUP BY 1")
def _(t):
    return roles.jobs(t).groupBy(journal.is_terminal(c("state")).alias("terminal")).agg(F.count("*").alias("n"))


STATES = "(['incoming', 'staging', 'uploading', 'distributing', 'leased', 'committing', 'published', 'aborted', 'failed', 'nowhere'])"


@query(
    "fsm_validate",
    f"""WITH p AS (SELECT event_id, {STATES}[(event_id % 10 + 1)::INT] AS a, {STATES}[(event_id // 10 % 9 + 1)::INT] AS b FROM events)
SELECT event_id, a AS "from", b AS "to", CASE
  WHEN a = 'nowhere' THEN 'unknown'
  WHEN a IN ('published', 'aborted', 'failed') THEN 'invalid'
  WHEN b IN ('aborted', 'failed') THEN 'ok'
  WHEN (a, b) IN (('incoming', 'staging'), ('incoming', 'leased'), ('staging', 'uploading'), ('uploading', 'distributing'), ('uploading', 'leased'), ('distributing', 'leased'), ('leased', 'committing'), ('committing', 'published')) THEN 'ok'
  ELSE 'invalid' END AS verdict FROM p""",
)
def _(t):
    states = F.array(*[F.lit(s) for s in ("incoming", "staging", "uploading", "distributing", "leased", "committing", "published", "aborted", "failed", "nowhere")])
    rows = t.events.select("event_id", F.get(states, (c("event_id") % 10).cast("int")).alias("from"), F.get(states, (F.floor(c("event_id") / 10) % 9).cast("int")).alias("to"))
    return journal.check_transitions(rows)


@query("repo_served", "SELECT c_custkey, c_custkey % 3 = 0 OR lower(c_mktsegment) IN ('building', 'machinery') AS served FROM customer")
def _(t):
    repos = F.when(c("c_custkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Building"), F.lit("MACHINERY")))
    return t.customer.select("c_custkey", distribution.serves(repos, c("c_mktsegment")).alias("served"))


@query("under_lease", f"WITH {roles.ENTRIES} SELECT path, starts_with(path, '/src1/') AS below FROM e")
def _(t):
    return roles.entries(t).select("path", paths.is_below(c("path"), F.lit("/src1")).alias("below"))


@query("glob_match", f"WITH {roles.TREE} SELECT path, (regexp_matches(path, '^/src1[^/]*$') OR regexp_matches(path, '^/[^/]*/de$')) AND NOT regexp_matches(path, '^/src3/[^/]*$') AS matched FROM tree")
def _(t):
    return roles.tree(t).select("path", catalog.matches(c("path"), catalog.parse_rules(roles.RULES)).alias("matched"))


HALF = "(CASE WHEN {0} >= 9223372036854775808 THEN {0}::HUGEINT - 18446744073709551616 ELSE {0}::HUGEINT END)::BIGINT"
UPPER, LOWER = HALF.format("md5_number_upper({0})"), HALF.format("md5_number_lower({0})")


@query("md5_path", f"SELECT page_id, {UPPER.format('url')} AS lo, {LOWER.format('url')} AS hi FROM pages")
def _(t):
    lo, hi = bits.md5_path(c("url"))
    return t.pages.select("page_id", lo.alias("lo"), hi.alias("hi"))


@query("parent_path", f"WITH {roles.TREE} SELECT path, CASE WHEN path = '' THEN NULL ELSE regexp_replace(path, '/[^/]*$', '') END AS parent, regexp_extract(path, '([^/]*)$', 1) AS name FROM tree")
def _(t):
    return roles.tree(t).select("path", paths.parent_path(c("path")).alias("parent"), paths.base_name(c("path")).alias("name"))


@query("path_ancestors", f"WITH {roles.TREE} SELECT e.path, array_to_string(list_slice(s, 1, i), '/') AS above FROM e JOIN (SELECT path, s, unnest(range(1, len(s))) AS i FROM parts) p USING (path)")
def _(t):
    return roles.entries(t).select("path", F.explode(paths.ancestors(c("path"))).alias("above"))


@query("unix_mode", "SELECT event_id, CASE event_type WHEN 'view' THEN 16384 WHEN 'click' THEN 40960 ELSE 32768 END + (event_id % 512) + CASE WHEN event_id % 3 = 0 THEN 2048 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN 512 ELSE 0 END AS mode FROM events")
def _(t):
    kind = F.when(c("event_type") == "view", "dir").when(c("event_type") == "click", "symlink").otherwise("reg")
    return t.events.select("event_id", bits.unix_mode(kind, c("event_id") % 512, setuid=c("event_id") % 3 == 0, sticky=c("event_id") % 5 == 0).cast("long").alias("mode"))


@query(
    "entry_flags",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 1 + CASE WHEN event_id % 2 = 0 THEN 32 ELSE 0 END WHEN 'click' THEN 8 WHEN 'error' THEN 20 ELSE 4 + CASE WHEN event_id % 3 > 0 THEN 64 ELSE 0 END END
  + CASE WHEN event_id % 4 >= 1 THEN (event_id % 4 - 1) * 256 ELSE 0 END + event_id % 2 * 2048 + CASE WHEN event_id % 11 = 0 THEN 32768 ELSE 0 END + CASE WHEN event_id % 13 > 10 THEN 131072 ELSE 0 END AS flags,
  CASE WHEN event_id % 4 >= 1 THEN event_id % 4 ELSE 1 END AS algo FROM events""",
)
def _(t):
    kind = F.when(c("event_type") == "view", "dir").when(c("event_type") == "click", "symlink").when(c("event_type") == "error", "fifo").otherwise("reg")
    n = c("event_id")
    flags = bits.entry_flags(kind, n % 3, (n % 4).cast("int"), (n % 2).cast("int"), n % 2 == 0, n % 11 == 0, F.when(n % 13 > 10, 1).otherwise(0)).cast("long")
    return t.events.select("event_id", flags.alias("flags")).withColumn("algo", bits.hash_algo(c("flags")).cast("long"))


@query("pack_hardlinks", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey * 4294967296 + CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE l_linenumber % 3 END AS packed FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", bits.pack_hardlinks(c("l_orderkey"), c("l_linenumber") % 3).alias("packed"))


@query("hash_suffix", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 2 THEN '-' WHEN 3 THEN '~' ELSE '' END AS suffix FROM orders")
def _(t):
    return t.orders.select("o_orderkey", bits.hash_suffix(c("o_orderkey") % 5).alias("suffix"))


@query("object_path", f"WITH {roles.ENTRIES} SELECT seq, 'data/' || substr(hash, 1, 2) || '/' || substr(hash, 3) AS path, 'http://h/r/data/' || substr(hash, 1, 2) || '/' || substr(hash, 3) AS url, '/srv/' || substr(hash, 1, 2) || '/' || hash || 'C' AS replica FROM e")
def _(t):
    h = c("hash")
    return roles.entries(t).select("seq", paths.object_path(h).alias("path"), paths.object_url(F.lit("http://h/r/"), h).alias("url"), paths.replica_path(F.lit("/srv"), h).alias("replica"))


@query("hash_from_path", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN substr(md5(url), 1, 2) || substr(md5(url), 3) END AS hash FROM pages")
def _(t):
    m = F.md5(c("url").cast("binary"))
    good = F.concat(F.lit("/x/data/"), F.substring(m, 1, 2), F.lit("/"), F.substring(m, 3, 40))
    p = F.when(c("page_id") % 3 == 0, good).when(c("page_id") % 3 == 1, F.concat(good, F.lit("/more"))).otherwise(c("url"))
    return t.pages.select("page_id", paths.hash_of_data_path(p).alias("hash"))


@query("path_segment", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'r' || page_id END AS segment FROM pages")
def _(t):
    p = F.concat(F.lit("/api/repos/r"), c("page_id").cast("string"), F.when(c("page_id") % 2 == 0, "/log").otherwise("/x/log"))
    return t.pages.select("page_id", paths.segment_between(p, "/repos/", "/log").alias("segment"))


@query("content_sha1", "SELECT doc_id, sha1(text) AS hash, strlen(text) AS size FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha1(c("text").cast("binary")).alias("hash"), F.octet_length("text").cast("long").alias("size"))


@query("hex_prefix", "SELECT p_partkey, regexp_extract(p_name, '^[0-9a-fA-F]*', 0) AS prefix FROM part")
def _(t):
    return t.part.select("p_partkey", paths.hex_prefix(c("p_name")).alias("prefix"))


@query("verify_hash", "SELECT doc_id, doc_id % 4 <> 0 AS good FROM documents")
def _(t):
    raw = c("text").cast("binary")
    name = F.when(c("doc_id") % 4 == 0, F.sha1(F.concat(c("text"), F.lit("x")).cast("binary"))).when(c("doc_id") % 4 == 1, F.upper(F.sha1(raw))).otherwise(F.sha1(raw))
    return t.documents.select("doc_id", (F.lower(F.sha1(raw)) == F.lower(name)).alias("good"))


@query("archive_checksum", "SELECT doc_id, sha256(text) AS sha256, true AS ok FROM documents")
def _(t):
    s = F.sha2(c("text").cast("binary"), 256)
    return t.documents.select("doc_id", s.alias("sha256"), (s == F.lower(F.upper(s))).alias("ok"))


@query("map_merge", "SELECT doc_id, 'b' AS k, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS v FROM documents UNION ALL SELECT doc_id, 'a', source FROM documents")
def _(t):
    src = F.create_map(F.lit("a"), c("source"), F.lit("b"), c("source"))
    over = F.when(c("doc_id") % 2 == 0, F.create_map(F.lit("b"), c("lang"))).otherwise(F.create_map().cast("map<string,string>"))
    keep = F.map_filter(src, lambda k, _: ~F.array_contains(F.map_keys(over), k))
    return t.documents.select("doc_id", F.explode(F.map_concat(keep, over)).alias("k", "v"))


@query("synthetic_attrs", f"WITH {roles.ENTRIES} SELECT seq, 'hash' AS k, hash || '-' AS v FROM e UNION ALL SELECT seq, 'compression', 'zlib' FROM e UNION ALL SELECT seq, 'chunk_list', '0:8192:' || hash || '-' || chr(10) || '8192:' || (size - 8192) || ':' || hash || '-' FROM e WHERE n_chunks = 2")
def _(t):
    e = roles.entries(t)
    line = lambda at, n: F.concat_ws(":", at.cast("string"), n.cast("string"), F.concat(c("hash"), bits.hash_suffix(F.lit(2))))
    chunks = F.array_join(F.array(line(F.lit(0), F.lit(8192)), line(F.lit(8192), c("size") - 8192)), "\n")
    base = F.create_map(F.lit("hash"), F.concat(c("hash"), bits.hash_suffix(F.lit(2))), F.lit("compression"), F.lit("zlib"))
    attrs = F.when(c("n_chunks") == 2, F.map_concat(base, F.create_map(F.lit("chunk_list"), chunks))).otherwise(base)
    return e.select("seq", F.explode(attrs).alias("k", "v"))


@query("lease_path", f"WITH {NAMED} SELECT id, CASE WHEN trim(s, '/') = '' THEN '' ELSE '/' || regexp_replace(s, '^/', '') END AS lease FROM n")
def _(t):
    return _named(t).select("id", paths.lease_path(F.concat(c("s"), F.lit("/"))).alias("lease"))


@query("safe_id", f"WITH {roles.TREE} SELECT path, CASE WHEN path = '' THEN 'root' ELSE replace(substr(path, 2), '/', '_') END || '_' || printf('%08x', md5_number_upper(path)) AS id FROM tree")
def _(t):
    return roles.tree(t).select("path", bits.safe_id(c("path")).alias("id"))


@query("bundle_header", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 4 > 0 THEN floor(l_quantity)::BIGINT END AS size FROM lineitem")
def _(t):
    size = F.when(c("l_linenumber") % 4 > 0, F.floor("l_quantity").cast("string")).otherwise("many")
    header = F.concat_ws(" ", F.hex("l_partkey"), size)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.get(F.split(header, " "), F.lit(1)).try_cast("long").alias("size"))


B = "(o_totalprice * (o_orderkey % 9) * (o_orderkey % 9) * 200)::BIGINT"


@query("human_bytes", f"SELECT o_orderkey, {B} AS b, CASE WHEN {B} = 0 THEN '—' WHEN {B} < 1024 THEN {B} || ' B' WHEN {B} < 1048576 THEN printf('%.1f KB', {B} / 1024.0 + 1e-9) WHEN {B} < 1073741824 THEN printf('%.1f MB', {B} / 1048576.0 + 1e-9) ELSE printf('%.2f GB', {B} / 1073741824.0 + 1e-9) END AS text FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders)")
def _(t):
    b = (F.floor("o_totalprice").cast("long") * (c("o_orderkey") % 9) * (c("o_orderkey") % 9) * 200).cast("long")
    return t.orders.select("o_orderkey", b.alias("b"), paths.human_bytes(b).alias("text"))


@query("human_duration", "WITH d AS (SELECT event_id, (event_id * 7919 % 20000000 - 1000)::BIGINT AS ms FROM events), s AS (SELECT *, greatest(ms, 0) // 1000 AS s FROM d) SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS text FROM s")
def _(t):
    ms = c("event_id") * 7919 % 20_000_000 - 1000
    return t.events.select("event_id", paths.human_duration(ms).alias("text"))


@query("topics", "SELECT n_nationkey, 'base/repos/' || n_name || '/announce' AS announce, 'base/receivers/' || n_name || '/presence' AS presence FROM nation")
def _(t):
    return t.nation.select("n_nationkey", paths.topic("base", "repos", c("n_name"), "announce").alias("announce"), paths.topic("base", "receivers", c("n_name"), "presence").alias("presence"))


@query("autotune_class", "SELECT event_id, CASE WHEN value < 5 THEN 32 WHEN value < 50 THEN 16 ELSE 8 END AS slots, CASE WHEN value < 5 THEN 1 WHEN value < 50 THEN 8 WHEN value < 150 THEN 32 ELSE 64 END AS files FROM events")
def _(t):
    slots, files = distribution.autotune(c("value"))
    return t.events.select("event_id", slots.alias("slots"), files.alias("files"))


@query("acl_allowed", "SELECT event_id, user_id = 7 OR event_id % 2 = 0 OR event_type IN ('view', 'click') AS ok FROM events")
def _(t):
    topic = F.concat(F.lit("base/"), F.when(c("event_type") == "view", "n/ready").when(c("event_type") == "click", "n/presence").otherwise("n/announce"))
    return t.events.select("event_id", distribution.acl_allowed(c("user_id").cast("string"), "7", c("event_id") % 2 == 1, topic).alias("ok"))


@query("error_class", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'permanent' WHEN event_type = 'error' THEN 'transient' ELSE 'internal' END AS class FROM events")
def _(t):
    return t.events.select("event_id", distribution.error_class(F.when(c("event_id") % 3 == 0, "permanent"), c("event_type") == "error").alias("class"))


@query("stuck_jobs", f"WITH {roles.JOBS} SELECT id FROM j WHERE state NOT IN ('published', 'aborted', 'failed') AND created_at + to_seconds(600) - updated_at > INTERVAL 2 MINUTES")
def _(t):
    age = F.timestamp_diff("MICROSECOND", c("updated_at"), F.timestamp_add("SECOND", F.lit(600), c("created_at")))
    return roles.jobs(t).where(~journal.is_terminal(c("state")) & (age > 120_000_000)).select("id")


@query("sweep_tmp", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND length(lang) = 2")
def _(t):
    name = F.when(c("doc_id") % 3 == 0, F.concat(c("doc_id").cast("string"), F.lit(".tmp"))).otherwise(c("doc_id").cast("string"))
    return t.documents.where((F.length("lang") == 2) & name.endswith(".tmp")).select("doc_id")


@query("load_slots", "SELECT event_id, greatest(2, 16 - trunc(value / 10)::INT) AS slots FROM events")
def _(t):
    return t.events.select("event_id", distribution.load_slots(F.lit(2), F.lit(16), c("value") / 10).alias("slots"))


@query(
    "manifest_validate",
    """SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'missing transaction_id' WHEN 1 THEN 'missing repo' WHEN 2 THEN 'missing target_root_hash' WHEN 3 THEN 'missing base_urls'
  WHEN 4 THEN 'invalid generator' WHEN 5 THEN 'invalid auth' WHEN 6 THEN 'invalid hash' END AS error FROM orders""",
)
def _(t):
    k = c("o_orderkey") % 9
    part = lambda n, good, bad=F.lit(""): F.when(k == n, bad).otherwise(good)
    urls = part(3, F.array(F.lit("http://h")), F.array().cast("array<string>"))
    error = distribution.manifest_error(part(0, c("o_orderkey").cast("string")), part(1, c("o_orderpriority")), part(2, F.lit("00aa")), urls, part(4, F.lit("diff"), F.lit("guess")), part(5, F.lit(""), F.lit("open")), part(6, F.array(F.lit("00aabb")), F.array(F.lit("ok1"), F.lit("a/b"))))
    return t.orders.select("o_orderkey", error.alias("error"))


@query("provenance_override", "SELECT o_orderkey, coalesce(c_mktsegment, o_orderpriority) AS actor FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0")
def _(t):
    claims = t.customer.where("c_custkey % 2 = 0").select("c_custkey", "c_mktsegment")
    return t.orders.join(claims, c("o_custkey") == c("c_custkey"), "left").select("o_orderkey", F.coalesce("c_mktsegment", "o_orderpriority").alias("actor"))


@query("resolve_staging_path", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '/stage/' || source || '/' || doc_id || '.tar' WHEN 1 THEN '/stage/' || doc_id || '.tar' WHEN 2 THEN '/stage/' || doc_id END AS resolved FROM documents")
def _(t):
    name, k = c("doc_id").cast("string"), c("doc_id") % 6
    text = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    asked = F.when(k == 0, text(c("source"), "/", name, ".tar")).when(k == 1, text("/stage/x/../", name, ".tar")).when(k == 2, text("/../stage//./", name))
    asked = asked.when(k == 3, text("../", name)).when(k == 4, text("/stage2/", name)).otherwise(text("/stage/../etc/", name))
    return t.documents.select("doc_id", paths.staging_path("/stage", asked, "/stage").alias("resolved"))


@query("crc_lines")
def _(t):
    line = F.to_json(F.struct("event_id", "event_type"))
    return t.events.select("event_id", bits.crc_line(line).alias("line"))


@query("attribute_blobs")
def _(t):
    from tarnwerk.functions.codecs import attributes_blob

    names, values = F.array(F.lit("b"), F.lit("a")), F.array(c("source").cast("binary"), c("lang").cast("binary"))
    return t.documents.select("doc_id", attributes_blob(names, values).alias("blob"))


@query("zlib_keys")
def _(t):
    from tarnwerk.functions.codecs import zlib_sha1

    return t.documents.select("doc_id", zlib_sha1(c("text").cast("binary")).alias("key"))

"""Queries over entries, chunks, the store and catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwerk.functions import paths
from tarnwerk.operators import catalog, chunks, order, store
from tarnwerk.plans import roles
from tarnwerk.plans.registry import query

c = F.col

HELD_DOCS = "h AS (SELECT DISTINCT sha1(text) AS hash FROM documents WHERE doc_id % 3 = 0)"


def _held(t):
    return roles.entries(t).where("seq % 3 = 0").select("hash").distinct()


@query(
    "publish_summary",
    f"""WITH {roles.ENTRIES}, {HELD_DOCS}, u AS (SELECT hash, count(*) AS n, max(size) AS size FROM e GROUP BY hash)
SELECT sum(n)::BIGINT AS n_files, sum(n * size)::BIGINT AS raw_bytes, sum((hash NOT IN (SELECT hash FROM h))::INT)::BIGINT AS new_objects,
  sum(CASE WHEN hash NOT IN (SELECT hash FROM h) THEN size ELSE 0 END)::BIGINT AS new_bytes,
  (sum(n - 1) + sum((hash IN (SELECT hash FROM h))::INT))::BIGINT AS dedup_hits FROM u""",
)
def _(t):
    seen = roles.entries(t).groupBy("hash").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    known = seen.join(_held(t).select("hash", F.lit(True).alias("held")), "hash", "left")
    new = c("held").isNull()
    return known.agg(
        F.sum("n").alias("n_files"), F.sum(c("n") * c("size")).alias("raw_bytes"), F.sum(new.cast("long")).alias("new_objects"),
        F.sum(F.when(new, c("size")).otherwise(0)).alias("new_bytes"), (F.sum(c("n") - 1) + F.sum((~new).cast("long"))).alias("dedup_hits"),
    )


@query("in_batch_dedup", f"WITH {roles.ENTRIES} SELECT hash, n_chunks > 0 AS chunked, count(*) AS n, count(*) - 1 AS repeats, min(seq) AS seq FROM e GROUP BY ALL")
def _(t):
    return store.distinct_objects(roles.entries(t).withColumn("chunked", c("n_chunks") > 0), ["hash", "chunked"], "seq")


@query("dedup_against_cas", f"WITH {roles.ENTRIES}, {HELD_DOCS} SELECT DISTINCT hash FROM e WHERE hash NOT IN (SELECT hash FROM h)")
def _(t):
    return store.new_objects(roles.entries(t).select("hash").distinct(), _held(t))


@query("present_in_cas", f"WITH {roles.ENTRIES}, {HELD_DOCS} SELECT DISTINCT hash FROM e WHERE hash IN (SELECT hash FROM h)")
def _(t):
    return store.present_objects(roles.entries(t).select("hash").distinct(), _held(t))


@query("cas_put", f"WITH {roles.ENTRIES} SELECT substr(hash, 1, 2) AS shard, count(DISTINCT hash) AS n FROM e GROUP BY ALL")
def _(t):
    objects = roles.entries(t).select("hash").distinct()
    both = _held(t).unionByName(store.new_objects(objects, _held(t)))
    return store.sharded(both).groupBy("shard").agg(F.count("*").alias("n"))


@query("cas_list", f"WITH {roles.ENTRIES} SELECT DISTINCT hash FROM e")
def _(t):
    p = paths.object_path(c("hash"))
    return roles.entries(t).select(paths.hash_of_data_path(F.concat(F.lit("/srv/"), p)).alias("hash")).distinct()


@query("cas_usage", f"WITH {roles.ENTRIES} SELECT count(*) AS n, sum(size)::BIGINT AS bytes FROM (SELECT DISTINCT hash, size FROM e)")
def _(t):
    return roles.entries(t).select("hash", "size").distinct().agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("object_lookup", f"WITH {roles.ENTRIES}, {HELD_DOCS} SELECT hash, coalesce(h.hash IS NOT NULL, false) AS held, max(size) AS size FROM e LEFT JOIN h USING (hash) GROUP BY ALL")
def _(t):
    return store.lookup_all(roles.entries(t).groupBy("hash").agg(F.max("size").alias("size")), store.sharded(_held(t))).select("hash", "held", "size")


@query("upload_log_distinct", f"WITH {roles.ENTRIES} SELECT hash, min(seq) AS first_seq FROM e GROUP BY hash")
def _(t):
    return roles.entries(t).groupBy("hash").agg(F.min("seq").alias("first_seq"))


@query("upload_log_contains", f"WITH {roles.ENTRIES}, {HELD_DOCS} SELECT seq, hash IN (SELECT hash FROM h) AS logged FROM e")
def _(t):
    log = _held(t).withColumn("logged", F.lit(True))
    return roles.entries(t).join(log, "hash", "left").select("seq", F.coalesce("logged", F.lit(False)).alias("logged"))


@query("largest_first", f"WITH {roles.ENTRIES} SELECT seq, size, row_number() OVER (ORDER BY size DESC, seq) AS place FROM e")
def _(t):
    return order.placed(roles.entries(t).select("seq", "size"), F.desc("size"), "seq")


@query("union_archives", "SELECT 'docs' AS archive, sha1(text) AS hash, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'bench', sha1(text), count(*) FROM benchmark GROUP BY ALL")
def _(t):
    one = lambda df, name: df.select(F.lit(name).alias("archive"), F.sha1(c("text").cast("binary")).alias("hash"))
    return one(t.documents, "docs").unionByName(one(t.benchmark, "bench")).groupBy("archive", "hash").agg(F.count("*").alias("n"))


@query("archive_list_duplicates", "SELECT path, count(*) AS n FROM (SELECT md5(text) AS path FROM documents UNION ALL SELECT md5(text) FROM benchmark UNION ALL SELECT md5(text) FROM conversations) GROUP BY path HAVING count(*) > 1")
def _(t):
    from tarnwerk.sources.archives import duplicate_paths

    one = lambda df: df.select(F.md5(c("text").cast("binary")).alias("path"))
    return duplicate_paths(one(t.documents).unionByName(one(t.benchmark)).unionByName(one(t.conversations)))


@query("chunk_fixed", "WITH d AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents WHERE strlen(text) > 1024), p AS (SELECT *, unnest(range(0, (n - 1) // 1024 + 1)) AS idx FROM d) SELECT doc_id, idx::INT AS idx, idx * 1024 AS \"offset\", least(1024, n - idx * 1024) AS size, sha1(unhex(substr(h, (idx * 2048 + 1)::BIGINT, 2048))) AS hash FROM p")
def _(t):
    return chunks.fixed(t.documents.select("doc_id", c("text").cast("binary").alias("data")), 1024, "doc_id")


@query("chunk_offsets", "WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, floor(l_quantity)::BIGINT AS size FROM lineitem) SELECT *, coalesce(sum(size) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM l")
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.floor("l_quantity").cast("long").alias("size"))
    return chunks.offsets(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "size")


@query("chunk_cdc")
def _(t):
    return chunks.content_defined(t.documents.select("doc_id", c("text").alias("data")), 256, 1024, 4096, "doc_id")


@query("attach_hashes", f"WITH {roles.TREE}, r AS (SELECT path, hash, strlen(text) AS n FROM e WHERE seq % 5 <> 0) SELECT tree.path, tree.type, r.hash, r.n FROM tree LEFT JOIN r ON r.path = tree.path AND tree.type = 'reg'")
def _(t):
    results = roles.entries(t).where("seq % 5 <> 0").select("path", "hash", c("size").alias("n"))
    return roles.tree(t).select("path", "type").join(results, "path", "left")


@query("preload_list", f"WITH {roles.ENTRIES} SELECT string_agg(DISTINCT hash, chr(10) ORDER BY hash) AS list FROM e WHERE path LIKE '/src1/%'")
def _(t):
    hashes = roles.entries(t).where(paths.is_below(c("path"), F.lit("/src1"))).select("hash").distinct()
    return hashes.agg(F.array_join(F.sort_array(F.collect_list("hash")), "\n").alias("list"))  # one file's content


@query("rebase_path", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '/rel/v1' WHEN 1 THEN '/abs/' || doc_id WHEN 2 THEN '/rel/v1/' || lang || '/' || doc_id ELSE '/rel/v1' END AS path FROM documents")
def _(t):
    k = c("doc_id") % 4
    rel = F.when(k == 0, ".").when(k == 1, F.concat(F.lit("/abs/"), c("doc_id").cast("string"))).when(k == 2, F.concat("lang", F.lit("/"), c("doc_id").cast("string"))).otherwise("")
    return t.documents.select("doc_id", paths.rebase(rel, F.lit("/rel/v1")).alias("path"))


@query("catalog_entry", f"""WITH {roles.TREE}, x AS (SELECT *, CASE WHEN path = '' THEN '' ELSE regexp_replace(path, '/[^/]*$', '') END AS up FROM tree)
SELECT path, (CASE WHEN md5_number_upper(path) >= 9223372036854775808 THEN md5_number_upper(path)::HUGEINT - 18446744073709551616 ELSE md5_number_upper(path)::HUGEINT END)::BIGINT AS md5path_1,
  CASE WHEN path = '' THEN 0 ELSE (CASE WHEN md5_number_upper(up) >= 9223372036854775808 THEN md5_number_upper(up)::HUGEINT - 18446744073709551616 ELSE md5_number_upper(up)::HUGEINT END)::BIGINT END AS parent_1,
  1::BIGINT AS hardlinks, hash, size, CASE type WHEN 'dir' THEN 16804 ELSE 33188 END::BIGINT AS mode, CASE type WHEN 'dir' THEN 1 ELSE 4 + CASE WHEN n_chunks > 0 THEN 64 ELSE 0 END END::BIGINT AS flags, regexp_extract(path, '([^/]*)$', 1) AS name FROM x""")
def _(t):
    rows = catalog.catalog_rows(roles.tree(t).withColumn("perm", F.lit(0o644)))
    return rows.select("path", "md5path_1", "parent_1", "hardlinks", "hash", "size", "mode", "flags", "name")


@query("plan_splits", f"WITH {roles.SPLITS} SELECT path FROM splits")
def _(t):
    return roles.splits(t)


@query("marker_splits", f"WITH {roles.ENTRIES} SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS path FROM e WHERE seq % 100 = 0")
def _(t):
    marked = roles.entries(t).withColumn("path", F.when(c("seq") % 100 == 0, F.concat(paths.parent_path(c("path")), F.lit("/.marker"))).otherwise(c("path")))
    return catalog.plan_splits(marked, [], "", ".marker")


@query("owner_catalog", f"WITH {roles.OWNED} SELECT path, catalog_path FROM owned")
def _(t):
    return roles.owned(t).select("path", "catalog_path")


@query("split_parent", f"WITH {roles.SPLITS} SELECT a.path, coalesce(max(b.path), '') AS parent FROM splits a LEFT JOIN splits b ON starts_with(a.path, b.path || '/') GROUP BY a.path")
def _(t):
    return catalog.owner(roles.splits(t), roles.splits(t), to="parent")


SELF = """coalesce(sum((type = 'reg')::INT), 0)::BIGINT AS self_regular, sum((type = 'dir')::INT)::BIGINT AS self_dir,
  sum((type = 'reg' AND NOT external AND n_chunks > 0)::INT)::BIGINT AS self_chunked, sum(CASE WHEN type = 'reg' AND NOT external THEN n_chunks ELSE 0 END)::BIGINT AS self_chunks,
  sum(CASE WHEN type = 'reg' AND NOT external AND n_chunks = 0 THEN size ELSE 0 END)::BIGINT AS self_file_size, sum(CASE WHEN type = 'reg' AND NOT external AND n_chunks > 0 THEN size ELSE 0 END)::BIGINT AS self_chunked_size,
  sum((n_xattrs > 0)::INT)::BIGINT AS self_xattr, sum((type = 'reg' AND external)::INT)::BIGINT AS self_external, sum(CASE WHEN type = 'reg' AND external THEN size ELSE 0 END)::BIGINT AS self_external_file_size,
  sum((type = 'symlink')::INT)::BIGINT AS self_symlink, sum((type NOT IN ('reg', 'dir', 'symlink'))::INT)::BIGINT AS self_special"""
NAMES = catalog.SELF


def _self(t):
    return catalog.self_counters(roles.owned(t)).select("catalog_path", *[f"self_{n}" for n in NAMES])


@query("self_counters", f"WITH {roles.OWNED} SELECT catalog_path, {SELF} FROM owned GROUP BY catalog_path")
def _(t):
    return _self(t)


ROLLUP = f"""WITH {roles.OWNED}, s AS (SELECT catalog_path, {SELF} FROM owned GROUP BY catalog_path)
SELECT a.catalog_path, {', '.join(f'any_value(a.self_{n}) AS self_{n}' for n in NAMES)}, {', '.join(f'coalesce(sum(b.self_{n}), 0)::BIGINT AS subtree_{n}' for n in NAMES)}
FROM s a LEFT JOIN s b ON a.catalog_path <> b.catalog_path AND starts_with(b.catalog_path, a.catalog_path || '/') GROUP BY a.catalog_path"""


@query("subtree_rollup", ROLLUP)
def _(t):
    return catalog.rollup(_self(t), NAMES)


@query("counters_kv", f"""WITH {roles.SPLITS}, x AS ({ROLLUP}), p AS (SELECT a.path, coalesce(max(b.path), '') AS parent FROM splits a LEFT JOIN splits b ON starts_with(a.path, b.path || '/') GROUP BY a.path),
n AS (SELECT x.catalog_path, count(p.path) AS self_nested FROM x LEFT JOIN p ON p.parent = x.catalog_path GROUP BY 1),
m AS (SELECT a.catalog_path, any_value(a.self_nested) AS self_nested, coalesce(sum(b.self_nested), 0)::BIGINT AS subtree_nested FROM n a LEFT JOIN n b ON a.catalog_path <> b.catalog_path AND starts_with(b.catalog_path, a.catalog_path || '/') GROUP BY 1),
y AS (SELECT * FROM x JOIN m USING (catalog_path))
SELECT catalog_path, counter, value FROM (UNPIVOT y ON COLUMNS(* EXCLUDE catalog_path) INTO NAME counter VALUE value)""")
def _(t):
    from tarnwerk.operators import release

    splits = roles.splits(t)
    nested = catalog.owner(splits, splits, to="catalog_path").groupBy("catalog_path").agg(F.count("*").alias("self_nested"))
    own = _self(t).join(nested, "catalog_path", "left").withColumn("self_nested", F.coalesce("self_nested", F.lit(0)).cast("long"))
    return release.counters_kv(catalog.rollup(own, release.COUNTED))


@query("counter_delta", f"WITH {roles.OWNED}, d AS (SELECT *, 1 AS s FROM owned WHERE type = 'reg' UNION ALL SELECT *, -1 FROM owned WHERE type = 'reg' AND hash[1] IN ('0', '1', '2', '3')) SELECT catalog_path, sum(s)::BIGINT AS self_regular, sum(CASE WHEN NOT external AND n_chunks = 0 THEN s * size ELSE 0 END)::BIGINT AS self_file_size, sum(CASE WHEN NOT external AND n_chunks > 0 THEN s ELSE 0 END)::BIGINT AS self_chunked FROM d GROUP BY catalog_path")
def _(t):
    files = roles.owned(t).where("type = 'reg'")
    old = files.where(F.substring("hash", 1, 1).isin("0", "1", "2", "3"))
    both = files.withColumn("s", F.lit(1)).unionByName(old.withColumn("s", F.lit(-1)))
    return catalog.self_counters(both, c("s")).select("catalog_path", "self_regular", "self_file_size", "self_chunked")


@query("self_nested", f"WITH {roles.SPLITS}, p AS (SELECT a.path, coalesce(max(b.path), '') AS parent FROM splits a LEFT JOIN splits b ON starts_with(a.path, b.path || '/') GROUP BY a.path) SELECT parent AS catalog_path, count(*) AS self_nested FROM p GROUP BY parent")
def _(t):
    return catalog.owner(roles.splits(t), roles.splits(t), to="catalog_path").groupBy("catalog_path").agg(F.count("*").alias("self_nested"))


@query("deepest_first", f"WITH {roles.SPLITS} SELECT path, row_number() OVER (ORDER BY length(path) DESC, path) AS place FROM splits")
def _(t):
    from pyspark.sql import Window

    return roles.splits(t).withColumn("place", F.row_number().over(Window.orderBy(F.length("path").desc(), "path")).cast("long"))  # the splits of a rule file


@query("union_mounts", f"WITH {roles.SPLITS} SELECT path, 'nested' AS kind FROM splits UNION ALL SELECT path, 'bind' FROM dirs WHERE path LIKE '/src2/%'")
def _(t):
    binds = catalog.directories(roles.entries(t)).where(c("path").startswith("/src2/"))
    return roles.splits(t).withColumn("kind", F.lit("nested")).unionByName(binds.withColumn("kind", F.lit("bind")))


@query("mkdir_missing", f"WITH {roles.TREE} SELECT path FROM dirs WHERE path <> '' AND path NOT IN (SELECT path FROM dirs WHERE path LIKE '/src1%')")
def _(t):
    dirs = catalog.directories(roles.entries(t))
    known = dirs.where(c("path").startswith("/src1") | (c("path") == ""))
    return catalog.missing_directories(roles.entries(t), known)


@query("add_nested_mount", f"WITH {roles.SPLITS} SELECT path, 3 AS flags FROM splits UNION ALL SELECT path, 1 FROM dirs WHERE path NOT IN (SELECT path FROM splits)")
def _(t):
    from tarnwerk.functions.bits import DIR, NESTED_MOUNT

    dirs = catalog.directories(roles.entries(t)).withColumn("dir", F.lit(DIR))
    mounts = roles.splits(t).withColumn("mount", F.lit(NESTED_MOUNT))
    return dirs.join(mounts, "path", "full").select("path", F.coalesce("dir", F.lit(DIR)).bitwiseOR(F.coalesce("mount", F.lit(0))).alias("flags"))


EVENTS = "v AS (SELECT event_id AS seq, '/u/' || user_id || '/' || (event_id % 7) AS path, event_type = 'error' AS gone, value FROM events)"


def _changes(t):
    p = F.concat(F.lit("/u/"), c("user_id").cast("string"), F.lit("/"), (c("event_id") % 7).cast("string"))
    return t.events.select(c("event_id").alias("seq"), p.alias("path"), (c("event_type") == "error").alias("gone"), "value")


@query("upsert_last_wins", f"WITH {EVENTS} SELECT path, max(seq) AS seq, arg_max(value, seq) AS value FROM v WHERE NOT gone GROUP BY path")
def _(t):
    return catalog.last_wins(_changes(t).where("not gone").select("path", "value", c("seq").alias("at"), "seq"), ["path"], "seq").select("path", "seq", "value")


@query("ordered_delete", f"WITH {EVENTS} SELECT seq, path FROM v WHERE NOT gone AND NOT EXISTS (SELECT 1 FROM v d WHERE d.gone AND d.path = v.path AND d.seq > v.seq)")
def _(t):
    return catalog.apply_deletes(_changes(t), "path", "seq", c("gone")).select("seq", "path")


@query("remove_entries", f"WITH {roles.ENTRIES} SELECT seq, path FROM e WHERE seq NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return roles.entries(t).join(t.labels.select(c("doc_id").alias("seq")).distinct(), "seq", "left_anti").select("seq", "path")


@query("unique_keys", f"WITH {roles.TREE} SELECT md5(path) AS key, count(*) AS n FROM tree GROUP BY ALL HAVING count(*) > 1")
def _(t):
    return roles.tree(t).groupBy(F.md5(c("path").cast("binary")).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


@query("lookup_file_hash", f"WITH {roles.ENTRIES} SELECT path, hash FROM e WHERE path IN (SELECT '/' || source || '/' || lang || '/' || doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))")
def _(t):
    from tarnwerk.functions.bits import md5_path

    keyed = lambda df: df.select(*df.columns, *[k.alias(f"k{i}") for i, k in enumerate(md5_path(c("path")))])
    asked = keyed(roles.entries(t).join(t.labels.select(c("doc_id").alias("seq")).distinct(), "seq", "left_semi").select("path")).drop("path")
    return keyed(roles.entries(t).select("path", "hash")).join(asked.distinct(), ["k0", "k1"], "left_semi").select("path", "hash")


@query("nested_mount_lookup", f"WITH {roles.SPLITS} SELECT path, path IN (SELECT path FROM splits) AS mounted FROM dirs")
def _(t):
    mounts = roles.splits(t).withColumn("mounted", F.lit(True))
    return catalog.directories(roles.entries(t)).join(mounts, "path", "left").select("path", F.coalesce("mounted", F.lit(False)).alias("mounted"))


@query("hardlink_resolve", "SELECT doc_id AS seq, CASE WHEN doc_id % 10 IN (1, 2, 3) AND doc_id - doc_id % 10 IN (SELECT doc_id FROM documents) THEN (SELECT strlen(d.text) FROM documents d WHERE d.doc_id = documents.doc_id - documents.doc_id % 10) ELSE strlen(text) END AS size FROM documents")
def _(t):
    from tarnwerk.plans.lineage import checkpointed

    checkpointed(t.spark)
    k = c("doc_id") % 10
    link = k.isin(1, 2, 3)
    rows = t.documents.select(F.lit("a").alias("archive"), c("doc_id").alias("seq"), c("doc_id").cast("string").alias("path"), F.when(link, "link").otherwise("reg").alias("type"), F.when(link, (c("doc_id") - 1).cast("string")).alias("link_target"), F.octet_length("text").cast("long").alias("size"), F.lit(None).cast("binary").alias("data"))
    return catalog.resolve_hardlinks(rows).select("seq", "size")


def _built(t):
    from tarnwerk.operators import build

    files = roles.entries(t).select("path", "type", "size", "perm", "n_chunks", "external", "n_xattrs", "hash")
    return build.build(files, catalog.parse_rules(roles.RULES))


BUILT = f"""WITH {roles.OWNED}, every AS (
  SELECT path, type, size, n_chunks, external, catalog_path FROM owned UNION ALL SELECT path, type, size, n_chunks, external, path FROM owned WHERE path IN (SELECT path FROM splits)
)"""


@query("build_subtree_rows", f"{BUILT} SELECT path, type, size, catalog_path FROM every")
def _(t):
    return _built(t).rows.select("path", "type", "size", "catalog_path")


@query(
    "build_subtree_counters",
    f"""{BUILT}, own AS (SELECT * FROM every WHERE NOT (path IN (SELECT path FROM splits) AND path <> catalog_path)),
s AS (SELECT catalog_path, sum((type = 'reg')::INT)::BIGINT AS regular, sum((type = 'dir')::INT)::BIGINT AS dir FROM own GROUP BY catalog_path),
m AS (SELECT catalog_path, count(*) AS nested FROM owned WHERE path IN (SELECT path FROM splits) GROUP BY catalog_path)
SELECT a.catalog_path, any_value(a.regular) AS self_regular, any_value(a.dir) AS self_dir, coalesce(any_value(m.nested), 0)::BIGINT AS self_nested, coalesce(sum(b.regular), 0)::BIGINT AS subtree_regular, coalesce(sum(b.dir), 0)::BIGINT AS subtree_dir
FROM s a LEFT JOIN m ON m.catalog_path = a.catalog_path LEFT JOIN s b ON b.catalog_path <> a.catalog_path AND starts_with(b.catalog_path, a.catalog_path || '/') GROUP BY a.catalog_path""",
)
def _(t):
    return _built(t).counters.select("catalog_path", "self_regular", "self_dir", "self_nested", "subtree_regular", "subtree_dir")


@query("catalog_identity")
def _(t):
    return _built(t).identities


@query("batch_insert", f"WITH {roles.TREE} SELECT path, size FROM tree")
def _(t):
    from tarnwerk.operators import build

    tree = roles.tree(t).select("path", "type", "size")
    return build.insert(tree.where("type = 'dir'"), tree.where("type <> 'dir'")).select("path", "size")


@query("job_transition", f"WITH {roles.JOBS} SELECT id, CASE WHEN state = 'staging' AND id % 2 = 0 THEN 'uploading' WHEN state = 'leased' THEN 'committing' ELSE state END AS state FROM j")
def _(t):
    from tarnwerk.operators import build

    jobs = roles.jobs(t)
    to = F.when((c("state") == "staging") & (c("id") % 2 == 0), "uploading").when(c("state") == "leased", "committing")
    changes = jobs.select("id", to.alias("to"), c("updated_at").alias("t"), F.lit("r1").alias("run_id"), F.lit("").alias("note")).where("to is not null")
    return build.move_jobs(jobs, changes)[0].select("id", "state")

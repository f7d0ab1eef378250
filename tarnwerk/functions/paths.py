"""Column functions over paths, names and topics. All are built from JVM functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_path(p: Column) -> Column:
    """An archive path: empty, or relative without a `..` component."""
    return (p == "") | (~p.startswith("/") & ~F.array_contains(F.split(p, "/"), ".."))


def valid_symlink(path: Column, target: Column) -> Column:
    """A link target that is relative and never climbs above the archive's root, resolved lexically from the link."""
    steps = F.split(F.concat(F.regexp_replace(path, r"[^/]*$", ""), target), "/")
    step = lambda s: F.when(s.isin("", "."), 0).when(s == "..", -1).otherwise(1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"))
    walk = lambda a, s: F.struct((a["depth"] + step(s)).alias("depth"), F.least(a["low"], a["depth"] + step(s)).alias("low"))
    return (target != "") & ~target.startswith("/") & (F.aggregate(steps, start, walk)["low"] >= 0)


def parent_path(p: Column) -> Column:
    """`/a/b` -> `/a`, `/a` -> ``, `` -> null."""
    return F.when(p == "", None).when(~p.contains("/"), "").otherwise(F.regexp_replace(p, r"/[^/]*$", ""))


def base_name(p: Column) -> Column:
    return F.regexp_extract(p, r"([^/]*)$", 1)


def ancestors(p: Column) -> Column:
    """All proper prefixes of an absolute path on `/` borders, the root (``) first; none for the root itself."""
    parts = F.split(p, "/")
    return F.when(p == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def is_below(p: Column, prefix: Column) -> Column:
    """Strictly below ``prefix``; everything is below the empty one."""
    return (prefix == "") | p.startswith(F.concat(prefix, F.lit("/")))


def rebase(p: Column, prefix: Column) -> Column:
    """Archive path to absolute path below ``prefix``; absolute paths stay."""
    return F.when(p.isin(".", ""), prefix).when(p.startswith("/"), p).otherwise(F.concat(prefix, F.lit("/"), p))


def lease_path(p: Column) -> Column:
    """One leading slash, no trailing one; empty stays empty."""
    bare = F.regexp_replace(F.regexp_replace(p, "^/", ""), "/$", "")
    return F.when(bare == "", "").otherwise(F.concat(F.lit("/"), bare))


def object_path(h: Column) -> Column:
    return F.when(F.length(h) < 2, F.concat(F.lit("data/00/"), h)).otherwise(F.concat(F.lit("data/"), F.substring(h, 1, 2), F.lit("/"), F.substring(h, 3, 1_000_000)))


def object_url(base: Column, h: Column) -> Column:
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), object_path(h))


def replica_path(root: Column, h: Column) -> Column:
    """The older replica layout: the full name in its shard, always with the suffix C."""
    return F.concat(root, F.lit("/"), F.substring(h, 1, 2), F.lit("/"), h, F.lit("C"))


def hash_of_data_path(p: Column) -> Column:
    """The object that a `.../data/xx/rest` path names, null for other paths."""
    found = F.regexp_extract(p, r"(?s)^.*/data/([^/]{2})/([^/]+)\z", 1)
    rest = F.regexp_extract(p, r"(?s)^.*/data/([^/]{2})/([^/]+)\z", 2)
    name = F.concat(found, rest)
    return F.when((rest != "") & valid_object_name(name), name)


def segment_between(p: Column, before: str, after: str) -> Column:
    """The single path segment between the first ``before`` and the next ``after``; null if empty or not single."""
    rest = F.when(p.contains(before), F.substr(p, F.locate(before, p) + len(before)))
    segment = F.when(rest.contains(after), F.substring_index(rest, after, 1))
    return F.when((segment != "") & ~segment.contains("/"), segment)


def clean(p: Column) -> Column:
    """An absolute path without empty, `.` and `..` steps; `..` of the root is the root."""
    step = lambda a, s: F.when(s.isin("", "."), a).when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step), "/"))


def staging_path(root: str, p: Column, cwd: str = "/") -> Column:
    """The absolute form of ``p`` (relative ones start at ``cwd``), null unless it is ``root`` or below it; a name right
    below the root that starts with two dots is refused as well. Purely lexical: nothing is looked up."""
    here = clean(F.lit(root))
    full = clean(F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(cwd + "/"), p)))
    below = F.concat(F.rtrim(here, F.lit("/")), F.lit("/"))
    return F.when((full == here) | (full.startswith(below) & ~full.startswith(F.concat(below, F.lit("..")))), full)


def safe_file_name(s: Column) -> Column:
    return F.regexp_replace(s, "[^A-Za-z0-9._-]", "_")


def valid_object_name(h: Column) -> Column:
    return h.rlike(r"^[0-9A-Za-z]{3,}\z")


def valid_repo_name(r: Column) -> Column:
    return r.rlike(r"^[0-9A-Za-z._-]{1,255}\z")


def valid_topic_segment(s: Column) -> Column:
    return (s != "") & ~s.rlike("[/+#\\x00]")


def valid_tag(t: Column) -> Column:
    return (t == "") | t.rlike(r"^[A-Za-z0-9._-]{1,255}\z")


def topic(base: str, kind: str, name: Column, what: str) -> Column:
    return F.concat_ws("/", F.lit(base), F.lit(kind), name, F.lit(what))


def hex_prefix(h: Column) -> Column:
    return F.regexp_extract(h, "^[0-9a-fA-F]*", 0)


def human_bytes(b: Column) -> Column:
    scaled = lambda n, digits, unit: F.concat(F.format_string(f"%.{digits}f", b / n), F.lit(unit))
    return F.when(F.coalesce(b, F.lit(0)) == 0, "—").when(b < 1024, F.concat(b.cast("string"), F.lit(" B"))).when(b < 1 << 20, scaled(1024.0, 1, " KB")).when(b < 1 << 30, scaled(1048576.0, 1, " MB")).otherwise(scaled(1073741824.0, 2, " GB"))


def human_duration(ms: Column) -> Column:
    s = F.floor(F.greatest(ms, F.lit(0)) / 1000).cast("long")
    m, h = F.floor(s / 60), F.floor(s / 3600)
    text = lambda *parts: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in parts])
    return F.when(h > 0, text(h, "h ", m % 60, "m")).when(m > 0, text(m, "m ", s % 60, "s")).otherwise(text(s, "s"))

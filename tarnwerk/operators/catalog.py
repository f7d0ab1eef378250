"""Catalogs as tables: ownership by longest prefix, counters and their roll-up, changes in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwerk.functions import bits, paths

SELF = ["regular", "symlink", "special", "dir", "chunked", "chunks", "file_size", "chunked_size", "xattr", "external", "external_file_size"]


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression: * and ? stay within a component. A bad one is an error."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if i == len(pattern):
                raise ValueError(f"bad pattern {pattern!r}")
            out.append("\\" + pattern[i] if not pattern[i].isalnum() else pattern[i])
            i += 1
        elif c == "[":
            end = pattern.find("]", i + 1 + (pattern[i : i + 1] == "^"))
            if end < 0:
                raise ValueError(f"bad pattern {pattern!r}")
            out.append("[" + pattern[i:end].replace("[", "\\[") + "]")
            i = end + 1
        else:
            out.append("\\" + c if c in ".^$+(){}|]" else c)
    return "^" + "".join(out) + "\\z"


def parse_rules(text: str) -> list[tuple[str, bool, bool]]:
    """(regex, negated, on the name only) of each rule of a split-rule file; a bad pattern is an error with its line."""
    out = []
    for number, line in enumerate(text.split("\n"), 1):
        rule = line.strip()
        if not rule or rule.startswith("#"):
            continue
        negated = rule.startswith("!")
        pattern = rule[1:].strip() if negated else rule
        if "/" in pattern and not pattern.startswith("/"):
            pattern = "/" + pattern
        try:
            out.append((glob_regex(pattern), negated, "/" not in pattern))
        except ValueError as e:
            raise ValueError(f"line {number}: {e}") from e
    return out


def matches(path: Column, rules: list[tuple[str, bool, bool]]) -> Column:
    """Whether some rule matches and no negated one does. A rule list is written by hand, so it is unrolled."""
    full = F.regexp_replace(F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), "(.)/$", "$1")
    hit = lambda negated: reduce(lambda a, b: a | b, [(paths.base_name(full) if name else full).rlike(rx) for rx, n, name in rules if n == negated], F.lit(False))
    return hit(False) & ~hit(True)


def directories(entries: DataFrame, path: str = "path") -> DataFrame:
    """(path) of every directory above an entry, the root ('') included."""
    return entries.select(F.explode(paths.ancestors(F.col(path))).alias("path")).distinct()


def missing_directories(entries: DataFrame, known: DataFrame) -> DataFrame:
    return directories(entries).join(known.select("path"), "path", "left_anti")


def plan_splits(entries: DataFrame, rules: list[tuple[str, bool, bool]], lease: str, marker: str) -> DataFrame:
    """(path) of the directories that get a catalog of their own: those with a marker file in them and those the rules
    name, strictly below the lease."""
    marked = entries.where((F.col("type") == "reg") & (paths.base_name(F.col("path")) == marker)).select(paths.parent_path(F.col("path")).alias("path"))
    ruled = directories(entries).where(matches(F.col("path"), rules) & (F.col("path") != ""))
    return marked.unionByName(ruled).where((F.col("path") != "") & paths.is_below(F.col("path"), F.lit(lease)) & (F.col("path") != lease)).distinct()


def owner(rows: DataFrame, splits: DataFrame, path: str = "path", to: str = "catalog_path") -> DataFrame:
    """``rows`` with the deepest split directory strictly above each path, '' if there is none: ancestors are exploded
    and joined by equality, never compared with every split."""
    above = rows.select(path).distinct().select(path, F.explode(paths.ancestors(F.col(path))).alias("_s"))
    found = above.join(splits.select(F.col("path").alias("_s")).distinct(), "_s").groupBy(path).agg(F.max_by("_s", F.length("_s")).alias(to))
    return rows.join(found, path, "left").withColumn(to, F.coalesce(to, F.lit("")))


def counted(kind: Column, size: Column, chunks: Column, external: Column, xattrs: Column) -> dict[str, Column]:
    """What one entry adds to each counter."""
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    add = lambda c, n: F.when(c, n).otherwise(0).cast("long")
    file = kind == "reg"
    ext, chunked = file & external, file & ~external & (chunks > 0)
    plain = file & ~external & (chunks == 0)
    special = ~kind.isin("reg", "dir", "symlink")
    return {
        "regular": one(file), "symlink": one(kind == "symlink"), "special": one(special), "dir": one(kind == "dir"),
        "chunked": one(chunked), "chunks": add(chunked, chunks), "file_size": add(plain, size), "chunked_size": add(chunked, size),
        "xattr": one(xattrs > 0), "external": one(ext), "external_file_size": add(ext, size),
    }


def self_counters(entries: DataFrame, sign: Column | None = None) -> DataFrame:
    """A row a catalog: its counters over (catalog_path, type, size, n_chunks, external, n_xattrs), each entry times
    ``sign`` (1 added, -1 removed)."""
    add = counted(*[F.col(c) for c in ("type", "size", "n_chunks", "external", "n_xattrs")])
    sign = sign if sign is not None else F.lit(1)
    return entries.groupBy("catalog_path").agg(*[F.sum(add[c] * sign).cast("long").alias(f"self_{c}") for c in SELF])


def rollup(counters: DataFrame, names: list[str]) -> DataFrame:
    """``counters`` (catalog_path, self_*) with subtree_*: sums over all catalogs strictly below, by exploding each
    catalog's ancestors once."""
    cats = counters.select("catalog_path")
    up = counters.select(F.explode(paths.ancestors(F.col("catalog_path"))).alias("_a"), *[f"self_{n}" for n in names])
    sums = up.join(cats.select(F.col("catalog_path").alias("_a")), "_a", "left_semi").groupBy("_a").agg(*[F.sum(f"self_{n}").cast("long").alias(f"subtree_{n}") for n in names])
    joined = counters.join(sums, counters["catalog_path"] == sums["_a"], "left").drop("_a")
    return joined.select("catalog_path", *[f"self_{n}" for n in names], *[F.coalesce(f"subtree_{n}", F.lit(0)).cast("long").alias(f"subtree_{n}") for n in names])


def last_wins(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The last row of each key by ``seq``."""
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), seq).alias("_r"))
    return last.select(*key, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def apply_deletes(rows: DataFrame, key: str, seq: str, delete: Column) -> DataFrame:
    """Rows that no deletion of the same key follows; deletions themselves go. Deletions of nothing are ignored."""
    gone = rows.where(delete).groupBy(F.col(key).alias("_k")).agg(F.max(seq).alias("_at"))
    return rows.where(~delete).join(gone, F.col(key) == F.col("_k"), "left").where(F.col("_at").isNull() | (F.col(seq) > F.col("_at"))).drop("_k", "_at")


def resolve_hardlinks(entries: DataFrame, rounds: int = 32) -> DataFrame:
    """Link entries with the size and data key of the earlier entry of their archive they lead to, chains included;
    ``bad`` marks links to nothing, to themselves or to a later entry. Pointers are doubled, so a chain of n links
    takes log n joins."""
    base = entries.select("archive", "seq", "path", "type", "link_target")
    target = base.select("archive", F.col("path").alias("link_target"), F.col("seq").alias("to"))
    earlier = base.where("type = 'link'").join(target, ["archive", "link_target"], "left").where(F.col("to").isNull() | (F.col("to") < F.col("seq")))
    hop = earlier.groupBy("archive", "seq").agg(F.max("to").alias("to"))
    known = entries.join(hop, ["archive", "seq"], "left").withColumn("to", F.when(F.col("type") == "link", F.col("to")).otherwise(F.col("seq")))
    step = known.select("archive", "seq", "to")
    for _ in range(rounds):
        nxt = step.select(F.col("archive"), F.col("seq").alias("to"), F.col("to").alias("far"))
        moved = step.join(nxt, ["archive", "to"], "left").select("archive", "seq", F.col("far").alias("new"), F.col("to").alias("old"))
        step = moved.select("archive", "seq", F.col("new").alias("to")).checkpoint()
        if not moved.where(~F.col("new").eqNullSafe(F.col("old"))).head(1):
            break
    source = entries.select("archive", F.col("seq").alias("to"), F.col("size").alias("_size"), F.col("data").alias("_data"))
    out = entries.join(step, ["archive", "seq"], "left").join(source, ["archive", "to"], "left")
    link = F.col("type") == "link"
    return out.select(*[F.when(link, F.col("_size")).otherwise(F.col("size")).alias("size") if c == "size" else F.when(link, F.col("_data")).otherwise(F.col("data")).alias("data") if c == "data" else F.col(c) for c in entries.columns], (link & F.col("to").isNull()).alias("bad"))


def catalog_rows(entries: DataFrame) -> DataFrame:
    """Catalog columns of (path, type, size, perm, n_chunks, hash): keys, packed numbers, name."""
    p = F.col("path")
    k1, k2 = bits.md5_path(p)
    parent = F.coalesce(paths.parent_path(p), F.lit(""))
    p1, p2 = bits.md5_path(parent)
    root = p == ""
    zero = F.lit(0).cast("long")
    file = F.col("type") == "reg"
    algo = F.when(file, 1).otherwise(0)
    return entries.select(
        "path", k1.alias("md5path_1"), k2.alias("md5path_2"), F.when(root, zero).otherwise(p1).alias("parent_1"), F.when(root, zero).otherwise(p2).alias("parent_2"),
        bits.pack_hardlinks(F.lit(0), F.lit(1)).alias("hardlinks"), F.when(file, F.col("hash")).alias("hash"), "size", bits.unix_mode(F.col("type"), F.col("perm")).cast("long").alias("mode"),
        bits.entry_flags(F.col("type"), F.col("n_chunks"), algo, F.lit(0), F.lit(False), F.lit(False), F.lit(0)).cast("long").alias("flags"), paths.base_name(p).alias("name"),
    )


def versions(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Order of versions within a key, for checks that say which row comes last."""
    return rows.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(seq)))

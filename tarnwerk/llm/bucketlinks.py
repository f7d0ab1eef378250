"""Links between similar texts that share a MinHash bucket: pivots first, then tiles of what is left, never a list of all
pairs of a bucket.

Every member of a bucket is compared with its pivot, the member that meets most other texts. Members that are in one
component by then need no further comparison; what is left of buckets that still hold several components is compared in
tiles, the members outside the pivot's component with all. Two texts must agree in most of their signature's values
(PLANES bits of each are kept) before their shingle sets are compared, and where a kind has sketches, the sketches must
leave the similarity possible; they never rule out a similar pair. A pair left by that is compared in the first bucket
that it shares. So all similar texts that share a bucket end up in one component.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwerk.llm.common import cut, join_hot, release
from tarnwerk.llm.components import contracted

#: The share of the values that must agree before texts are compared. At similarity 0.8 it is 0.82 on average, at 0.1
#: in one shared bucket 0.3. In simulation it costs 14 in 1000 pairs right at 0.8 with 20 shingles, 1 with 80.
NEAR, PLANES = 0.58, 3
PLANE_NAMES = [f"s{p}" for p in range(PLANES)]
#: Words of a sketch: a bit of its 64 * SKETCH bits is set if a shingle's hash falls there.
SKETCH = 32
SKETCH_NAMES = [f"x{w}" for w in range(SKETCH)]
#: Members of a tile, and the most it weighs unless one member weighs more; two tiles that must meet are one row.
TILE, TILE_WEIGHT = 256, 1 << 18


@dataclass(frozen=True)
class Kind:
    """values: those of a signature; of: a text's shingle set, from the column that holds the text; weight: its length;
    near: the share of the values that must agree; sketch: (k, z, x0..) of texts (k, line), z being at least the size of
    the shingle set."""

    values: int
    of: Callable[[Column], Column]
    weight: Callable[[Column], Column]
    near: float = NEAR
    sketch: Callable[[DataFrame], DataFrame] | None = None


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, whatever the optimizer does with columns."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def planes(values: int) -> list[Column]:
    """The last PLANES bits of the columns m0, m1, ..., a bit of all in a column."""
    bit = lambda j, p: F.shiftleft(F.shiftright(f"m{j}", p).bitwiseAND(F.lit(1).cast("long")), j)
    return [reduce(Column.bitwiseOR, [bit(j, p) for j in range(values)]).alias(name) for p, name in enumerate(PLANE_NAMES)]


def _near(x, y, kind: Kind) -> Column:
    """Whether two kept signatures agree in that share of the values at least; x, y: from a plane's name to its column."""
    differ = reduce(Column.bitwiseOR, [x(f"s{p}").bitwiseXOR(y(f"s{p}")) for p in range(PLANES)])
    return F.bit_count(differ) <= int(kind.values * (1 - kind.near) + 1e-9)


def _possible(x, y, threshold: float) -> Column:
    """Whether two sketches leave that similarity possible. A bit that only one has stands for a shingle that only one
    has, and of those, similar sets have at most (1 - threshold) / (1 + threshold) of the sum of their sizes."""
    apart = reduce(Column.__add__, [F.bit_count(x(w).bitwiseXOR(y(w))) for w in SKETCH_NAMES])
    return apart <= (x("z") + y("z")) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-6)


def _similar(a: Column, b: Column, threshold: float) -> Column:
    """Whether two shingle sets have at least that Jaccard similarity; sizes are compared first."""
    na, nb = F.size(a), F.size(b)
    close = F.least(na, nb) >= F.greatest(na, nb) * F.lit(threshold)
    enough = let(F.size(F.array_intersect(a, b)), lambda shared: shared >= F.lit(threshold) * (na + nb - shared))
    return F.when(close, enough).otherwise(F.lit(False))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float, kind: Kind) -> DataFrame:
    """Those pairs (k, p) of texts whose shingle sets have at least that Jaccard similarity. texts: (k, line)."""
    a = texts.select("k", F.col("line").alias("a"))
    b = texts.select(F.col("k").alias("p"), F.col("line").alias("b"))
    both = join_hot(join_hot(pairs, a, "k"), b, "p")
    # made in a row of its own, the sets are made once, and they meet in generated code, which a lambda isn't
    two = F.struct(kind.of(F.col("a")).alias("a"), kind.of(F.col("b")).alias("b"))
    met = both.select("k", "p", F.explode(F.array(two)).alias("x"))
    return met.where(F.size(F.array_intersect("x.a", "x.b")) >= F.lit(threshold) * F.size(F.array_union("x.a", "x.b"))).select("k", "p")


def _tiled(rows: DataFrame, values: list[str], weight: Column, links) -> DataFrame:
    """``links(o, m)`` of every pair of tiles of a bucket that must meet, one row (bk, e) an element: o: members outside
    the pivot's component, m: all. rows: (bk, k, c, main) and ``values``; weight: what a row brings."""
    rows = rows.select("bk", F.struct("k", "c", "main", *values).alias("x"), weight.alias("_w"), F.xxhash64("k").alias("_h"), "main")
    out = F.when(F.col("main"), 0).otherwise(1)
    sizes = rows.groupBy("bk").agg(F.count("*").alias("n"), F.sum("_w").alias("nw"), F.sum(out).alias("u"), F.sum(out * F.col("_w")).alias("uw"))
    tiles = lambda n, w: F.greatest(F.ceil(F.col(n) / TILE), F.ceil(F.col(w) / TILE_WEIGHT))
    dealt = join_hot(rows, sizes.where("u > 0").select("bk", tiles("u", "uw").alias("ot"), tiles("n", "nw").alias("mt")), "bk")

    def side(some: DataFrame, own: str, other: str) -> DataFrame:
        held = some.groupBy("bk", "ot", "mt", F.pmod("_h", own).alias(f"{own}_at")).agg(F.collect_list("x").alias(own[0]))
        return held.select("bk", f"{own}_at", F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_at"), own[0])

    met = side(dealt.where(~F.col("main")), "ot", "mt").join(side(dealt, "mt", "ot"), ["bk", "ot_at", "mt_at"])
    return met.select("bk", F.explode(links(F.col("o"), F.col("m"))).alias("e"))


def _once(x, y) -> Column:
    """Whether two members share no bucket before this one; ``before`` holds a member's buckets with lesser keys. A pair
    that shares several buckets is compared in the first only."""
    return ~F.arrays_overlap(x("before"), y("before"))


def _apart(x: Column, y: Column) -> Column:
    """Pairs of members in different components, those outside the pivot's component once."""
    return (x["c"] != y["c"]) & (y["main"] | (x["k"] > y["k"]))


def _marked(rows: DataFrame, values: list[str], may) -> DataFrame:
    """(bk, k) of the members (bk, k, c, main) with ``values`` that have another in their bucket, but in another
    component, for which ``may(x, y)`` holds, which must be symmetric; x, y: from a name to its column. Members meet by
    tiles, in semi-joins: a member is done with the first that it finds in a tile, and pairs are never listed. Those
    outside the pivot's component look among all, then those inside among the outer ones that found some."""
    out = F.when(F.col("main"), 0).otherwise(1)
    sizes = rows.groupBy("bk").agg(F.count("*").alias("n"), F.sum(out).alias("u")).where("u > 0")
    tiles = sizes.select("bk", F.ceil(F.col("u") / TILE).alias("ot"), F.ceil(F.col("n") / TILE).alias("mt"))
    dealt = join_hot(rows, tiles, "bk")

    def side(some: DataFrame, own: str, other: str) -> DataFrame:
        at = F.pmod(F.xxhash64("k"), own).alias(f"{own}_at"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(f"{other}_at")
        return some.select("bk", *at, *[F.col(c).alias(f"{own}_{c}") for c in ("k", "c", *values)])

    x, y = lambda c: F.col(f"ot_{c}"), lambda c: F.col(f"mt_{c}")

    def found(who: DataFrame, among: DataFrame, own: str) -> DataFrame:
        w, a = who.alias("w"), among.alias("a")
        met = reduce(Column.__and__, [F.col(f"w.{c}") == F.col(f"a.{c}") for c in ("bk", "ot_at", "mt_at")])
        return w.join(a, met & (x("c") != y("c")) & may(x, y), "left_semi").select("bk", F.col(f"{own}_k").alias("k")).distinct()

    outer = cut(found(side(dealt.where(~F.col("main")), "ot", "mt"), side(dealt, "mt", "ot"), "ot"))
    few = dealt.where(~F.col("main")).join(outer, ["bk", "k"], "left_semi")
    return outer.unionByName(found(side(dealt.where("main"), "mt", "ot"), side(few, "ot", "mt"), "mt"))


def _joined(rows: DataFrame, texts: DataFrame, threshold: float, kind: Kind) -> DataFrame:
    """Pairs (k, p) of components that similar members (bk, k, c, main, before, s0..; z, x0.. where the kind has sketches)
    of one bucket join."""
    values = ["before", *PLANE_NAMES, *(["z", *SKETCH_NAMES] if kind.sketch else [])]

    def links(o, m):
        of = lambda a: F.transform(a, lambda x: F.struct(*[x[s].alias(s) for s in ("k", "c", "main", *values)], kind.of(x["line"]).alias("set")))
        may = lambda x, y: _possible(lambda s: x[s], lambda s: y[s], threshold) if kind.sketch else F.lit(True)
        same = lambda x, y: _apart(x, y) & _near(lambda s: x[s], lambda s: y[s], kind) & may(x, y) & _once(lambda s: x[s], lambda s: y[s]) & _similar(x["set"], y["set"], threshold)
        ends = lambda x, ms: F.array_distinct(F.transform(F.filter(ms, lambda y: same(x, y)), lambda y: F.struct(x["c"].alias("k"), y["c"].alias("p"))))
        return let(F.struct(of(o).alias("o"), of(m).alias("m")), lambda t: F.array_distinct(F.flatten(F.transform(t["o"], lambda x: ends(x, t["m"])))))

    return _tiled(join_hot(rows, texts, "k"), [*values, "line"], kind.weight(F.col("line")), links).select("e.k", "e.p").distinct()


def linked(signed: DataFrame, fetch: Callable[[DataFrame], DataFrame], threshold: float, kind: Kind) -> DataFrame:
    """Edges (k, p) that bring all similar texts that share a bucket into one component.

    signed: (k, bands, s0..), a row a text; ``fetch`` gives (k, line) for the keys k that it is given."""
    spark = signed.sparkSession
    # one exchange serves the count and the join; a bucket's keys pass through one task here, but are never gathered
    bands = signed.select("k", F.explode("bands").alias("bk")).repartition("bk")
    shared = bands.groupBy("bk").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(bands.join(shared.hint("shuffle_hash"), "bk").select("bk", "k", "n"))
    del bands, shared
    release(spark)

    central = members.groupBy("k").agg(F.sum("n").alias("w"))
    rows = cut(join_hot(members, join_hot(central, signed.select("k", *PLANE_NAMES), "k"), "k").select("bk", "n", "k", "w", *PLANE_NAMES))
    best = F.max(F.struct("w", "k", *PLANE_NAMES)).alias("b")
    pivots = rows.groupBy("bk").agg(best).select("bk", F.col("b.k").alias("p"), *[F.col(f"b.{s}").alias(f"p{s}") for s in PLANE_NAMES])
    near = _near(F.col, lambda s: F.col(f"p{s}"), kind)
    met = cut(join_hot(rows, pivots, "bk").where((F.col("n") > 2) | near).select("bk", "n", "k", "p", near.alias("main"), *PLANE_NAMES))
    del signed, members, central, rows, pivots
    release(spark)

    pairs = cut(met.where("main and k <> p").select("k", "p").distinct())
    more = met.where("n > 2").select("bk", "k", "p", *PLANE_NAMES)
    texts = cut(fetch(pairs.select("k").unionByName(pairs.select(F.col("p").alias("k"))).unionByName(more.select("k")).distinct()))
    release(spark)

    known = contracted(_verified(pairs, texts, threshold, kind), "k", "p")
    release(spark)
    comps = known.unionByName(known.select(F.col("p").alias("k"), "p")).groupBy("k").agg(F.min("p").alias("c"))
    state = join_hot(more, comps, "k", "left").withColumn("c", F.coalesce("c", "k"))
    state = join_hot(state, comps.select(F.col("k").alias("p"), F.col("c").alias("d")), "p", "left")
    state = cut(state.select("bk", "k", "c", (F.col("c") == F.coalesce("d", "p")).alias("main"), *PLANE_NAMES))
    del met, more, pairs
    release(spark)
    near = lambda x, y: _near(x, y, kind)
    rows = cut(state.join(_marked(state, PLANE_NAMES, near), ["bk", "k"]))
    del state
    release(spark)
    # both members of a near pair are marked in every bucket that they share, so the marks tell which is the first
    own = cut(rows.groupBy("k").agg(F.collect_set("bk").alias("own")))  # at most a bucket a band
    texts = cut(texts.join(own.select(F.col("k").alias("w")), F.col("k") == F.col("w"), "left_semi"))
    about = join_hot(kind.sketch(texts), own, "k") if kind.sketch else own
    rows = cut(join_hot(rows, about, "k").withColumn("before", F.filter("own", lambda b: b < F.col("bk"))).drop("own"))
    del own, about
    release(spark)
    if kind.sketch:
        may = lambda x, y: near(x, y) & _possible(x, y, threshold) & _once(x, y)
        rows = cut(rows.join(_marked(rows, [*PLANE_NAMES, "before", "z", *SKETCH_NAMES], may), ["bk", "k"]))
        release(spark)
    found = cut(_joined(rows, texts, threshold, kind))
    return known.unionByName(found)

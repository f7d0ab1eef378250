"""Fuzzy line deduplication with DataFrame functions only: MinHash over character shingles, banding, exact Jaccard,
components, one line kept a component.

A line's shingles: the 5 characters at every position (a shorter line is one shingle), for the signatures and for the
exact similarity alike. Equal lines have one key and are one node. Between steps lines travel as text; a set is made
where it is compared, for it takes eight bytes a character.

Signature: one 32-bit hash a shingle; value i is the least of hash xor seed i, which is the shingle nearest to a
point of the hash space and is the same for two lines with the chance of their similarity. The points lie in different
64ths of the space, and all shingles count for each. Shingles are read in blocks, whose least is taken in registers
before it goes to the aggregate. Short lines repeat shingles among their values.

Banding decides which lines are compared; bucketlinks says how, without listing the pairs of a bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwerk.llm.bucketlinks import PLANE_NAMES, SKETCH, SKETCH_NAMES, Kind, let, linked, planes
from tarnwerk.llm.common import cut, join_hot, release
from tarnwerk.llm.components import connected_components

SHINGLE = 5
#: A signature has BANDS * BAND_ROWS values, and every second value starts a band: the values RULER steps on from it, all
#: around. The steps' differences are all different, so two bands share one value at most. A pair at similarity 0.8
#: shares a bucket with the chance 0.9927 (simulation), at 0.9 with 0.9999. Nine bands of four values each would
#: find 0.9913 at 0.8, but 2.5 times as many pairs at 0.2 and five times as many at 0.1.
BANDS, BAND_ROWS, RULER = 9, 4, (0, 1, 4, 9, 11)
#: A line of up to SHORT characters has few shingles to choose from, and its bands miss together; it gets SHORT_BANDS
#: bands of SHORT_ROWS values as well, with which all of them together find 0.998 of pairs at similarity 0.8 and 8 or 16
#: shingles in simulation. With bands of two values the pairs to compare would soon grow with the square of the input.
SHORT, SHORT_BANDS, SHORT_ROWS = 48, 12, 3
#: Shingles that are read in one row.
BLOCK = 16


def seeds(count: int) -> list[int]:
    """Points of the space of signed 32-bit integers, spread over its 64 parts in a fixed random order."""
    rng = np.random.default_rng(9)
    parts = np.concatenate([rng.permutation(64) for _ in range(-(-count // 64))])[:count]
    return [int(p) - 32 << 26 | int(x) for p, x in zip(parts, rng.integers(0, 1 << 26, count))]


def wide(line: Column) -> Column:
    """4 bytes a character: substrings in constant time."""
    return F.encode(line, "UTF-32")


def shingle(w: Column, i: Column) -> Column:
    return F.substring(w, i * 4 + 1, F.lit(4 * SHINGLE))


def shingle_hashes(line: Column) -> Column:
    """The hashes of a line's shingles, repeats included; the wide line is made once, not for every element."""
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.octet_length(w) - 4 * SHINGLE + 1, F.lit(1)), F.lit(4))
    return let(wide(line), lambda w: F.transform(starts(w), lambda i: F.xxhash64(F.substring(w, i, F.lit(4 * SHINGLE)))))


def shingle_set(line: Column) -> Column:
    """The set of a line's shingles, by hash."""
    return F.array_distinct(shingle_hashes(line))


def line_rows(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(doc, pos, line, k) for every line that isn't blank; k: the line's key."""
    rows = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    return rows.where(F.trim("line") != "").withColumn("k", F.xxhash64("line"))


def signatures(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(k, again, bands, s0..): a row a distinct line; again: it occurs more than once; s0..: one bit of each value."""
    marks = line_rows(docs, text, id_col).select("k", wide(F.col("line")).alias("w"))
    last = F.greatest(F.shiftright(F.octet_length("w"), 2) - SHINGLE, F.lit(0))
    marks = marks.select("k", "w", last.alias("last"), F.explode(F.sequence(F.lit(0), last, F.lit(BLOCK))).alias("i"))
    # past the end of a line its last shingle repeats, which changes no least value
    hashed = lambda j: F.hash(shingle(F.col("w"), F.least(F.col("i") + j, F.col("last"))))
    marks = marks.select("k", "i", "last", *[hashed(j).alias(f"h{j}") for j in range(BLOCK)])
    count = BANDS * BAND_ROWS
    least = [F.min(F.least(*[F.col(f"h{j}").bitwiseXOR(F.lit(c).cast("int")) for j in range(BLOCK)])).alias(f"m{n}") for n, c in enumerate(seeds(count))]
    mins = marks.groupBy("k").agg(F.sum(F.when(F.col("i") == 0, 1).otherwise(0)).alias("n"), F.max("last").alias("last"), *least)
    def keys(sort, starts, steps):
        return [F.xxhash64(F.lit(sort), F.lit(j), *[F.col(f"m{(j + r) % count}") for r in steps]) for j in starts]

    long, short = keys(0, range(0, count, 2), RULER), keys(1, range(0, SHORT_BANDS * SHORT_ROWS, SHORT_ROWS), range(SHORT_ROWS))
    bands = F.when(F.col("last") <= SHORT - SHINGLE, F.array(*long, *short)).otherwise(F.array(*long))
    # ``let`` keeps this step out of the generated loop, whose one method would be too large to be compiled
    return mins.select("k", (F.col("n") > 1).alias("again"), let(bands, lambda b: b).alias("bands"), *planes(count))


def sketches(texts: DataFrame) -> DataFrame:
    """(k, z, x0..) of lines (k, line), a row a line: z: its shingles, repeats included; x0..: the bits at which the hashes
    of its shingles fall. A shingle is a row, for it sets a bit of one word only; a line has a row a word by then."""
    rows = texts.select("k", wide(F.col("line")).alias("w"))
    last = F.greatest(F.shiftright(F.octet_length("w"), 2) - SHINGLE, F.lit(0))
    rows = rows.select("k", "w", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("i"))
    rows = rows.select("k", "last", F.xxhash64(shingle(F.col("w"), F.col("i"))).alias("h"))
    word = F.shiftright("h", 6).bitwiseAND(F.lit(SKETCH - 1).cast("long"))
    words = rows.groupBy("k", "last", word.alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b"))
    own = lambda w: F.when(F.col("at") == w, F.col("b")).otherwise(F.lit(0).cast("long"))
    return words.groupBy("k").agg((F.max("last") + 1).alias("z"), *[F.bit_or(own(w)).alias(x) for w, x in enumerate(SKETCH_NAMES)])


def line_components(docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """(k, component) for the keys of lines that occur more than once or are similar to another line; component is the
    smallest key of the class."""
    held = [cut(signatures(docs, text, id_col))]
    again = cut(held[0].where("again").select("k"))
    release(docs.sparkSession)

    def fetch(keys: DataFrame) -> DataFrame:
        rows = line_rows(docs, text, id_col).select("k", "line")
        found = rows.join(keys.withColumnRenamed("k", "w"), F.col("k") == F.col("w"), "left_semi")
        return found.groupBy("k").agg(F.min("line").alias("line"))

    comps = connected_components(linked(held.pop(), fetch, threshold, Kind(BANDS * BAND_ROWS, shingle_set, F.length, sketch=sketches)), "k", "p")
    known = comps.select(F.col("node").alias("k"), "component")
    alone = again.join(known.select(F.col("k").alias("o")), F.col("k") == F.col("o"), "left_anti").select("k", F.col("k").alias("component"))
    return cut(known.unionByName(alone))


def dropped_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """(doc, pos, k, component) of every line occurrence that isn't the first (by id, then position) of its class."""
    classes = line_components(docs, text, id_col, threshold)
    places = line_rows(docs, text, id_col).select("doc", "pos", "k")
    found = cut(join_hot(places, classes, "k"))
    first = found.groupBy("component").agg(F.min(F.struct("doc", "pos")).alias("first"))
    return join_hot(found, first, "component").where(~F.struct("doc", "pos").eqNullSafe(F.col("first"))).select("doc", "pos", "k", "component")


def dedup_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = 0.8, counts: bool = False) -> DataFrame:
    """``docs`` with only one line of each class of similar lines left in the corpus: the first by id and position.

    Lines are what stands between line feeds; similar: Jaccard similarity of the shingle sets of at least
    ``threshold``, closed over chains. ``counts`` adds _lines and _dropped. Defined cases: blank lines are never
    dropped; null and empty texts stay as they are; a text that loses all its lines becomes empty, its row stays; rows
    that share an id count as one document (a line kept in one is kept in the other, too); rows with a null id lose
    nothing, but come first; all other columns pass unchanged; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    gone = dropped_lines(docs, text, id_col, threshold)
    gone = cut(gone.where("doc is not null").groupBy("doc").agg(F.collect_set(F.struct("pos", "k")).alias("drop")))  # at most a document's lines
    release(spark)
    names = docs.columns
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    t, d = f"c{names.index(text)}", f"c{names.index(id_col)}"
    joined = plain.join(gone.hint("shuffle_hash"), F.col(d) == F.col("doc"), "left")
    joined = joined.withColumn("lines", F.split(F.col(t), "\n"))  # a column, lest every element splits the text anew
    real = F.transform(F.filter("drop", lambda x: F.xxhash64(F.get("lines", x["pos"])) == x["k"]), lambda x: x["pos"])
    joined = joined.withColumn("gone", F.when(F.col("drop").isNotNull() & F.col(t).isNotNull(), real))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    joined = joined.withColumn("left", F.when(F.col("gone").isNotNull(), left))
    new = F.when(F.col("gone").isNull(), F.col(t)).otherwise(F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n"))
    extra = [F.coalesce(F.size("lines"), F.lit(0)).alias("_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("_dropped")] if counts else []
    return joined.select(*[(new if f"c{i}" == t else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)], *extra)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """A row a document: its lines, how many were dropped, and a digest of the text that is left."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), counts=True)
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))

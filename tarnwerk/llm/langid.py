"""Language identification, words first: a known word counts with its log frequency by language; an unseen word with
that of its longest known character n-grams, shorter and shorter ones in turn.

The model is fitted on a bounded, hashed sample of labelled rows and knows every language, and all words and n-grams
that the sample holds at least twice; the bound of the sample bounds the model, which is sent to every executor.
Prediction reads whole texts and nothing but texts.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows a language to fit on, about (a row is taken by the hash of its id).
ROWS_A_LANGUAGE = 4000
#: A word or n-gram seen less often says nothing reliable; the shorter n-grams stand in.
LEAST_SEEN = 2
LENGTHS = (5, 4, 3, 2, 1)
#: What a step down the lengths takes off the weight of an unseen word.
BACKOFF = 0.7
CACHED_WORDS = 400_000
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(w.isalpha() or any(map(str.isalpha, w)) for w in words)


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Table:
    """Rows of a matrix by string, held as the sorted XXH64 of the strings: eight bytes an entry in every worker."""

    def __init__(self, hashes: np.ndarray, rows: np.ndarray):
        order = np.argsort(hashes)
        self.keys, self.rows = array("Q", hashes[order].tobytes()), rows[order]

    def get(self, gram: str) -> np.ndarray | None:
        h = xxhash.xxh64_intdigest(gram.encode("utf-8", "replace"), 42)
        at = bisect_left(self.keys, h)
        return self.rows[at] if at < len(self.keys) and self.keys[at] == h else None

    def __contains__(self, gram: str) -> bool:
        return self.get(gram) is not None


@dataclass
class Model:
    """Languages, their log shares, and log frequencies by word and by n-gram (rows of a matrix)."""

    langs: list[str]
    prior: np.ndarray
    words: Table | dict[str, np.ndarray]
    grams: dict[int, Table | dict[str, np.ndarray]]

    def vector(self, word: str) -> np.ndarray:
        if (found := self.words.get(word)) is not None:
            return found
        weight = 1.0
        for n in LENGTHS:
            weight *= BACKOFF
            if known := [v for g in grams(word, n) if (v := self.grams[n].get(g)) is not None]:
                return weight * np.mean(known, axis=0)
        return np.zeros(len(self.langs))


class Predictor:
    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.langs)))

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not self.model.langs or not has_letter(words):
            return UNKNOWN, 0.0
        if len(self.at) > CACHED_WORDS:
            self.forget()
        if new := list(set(words).difference(self.at)):
            start = len(self.at)
            if start + len(new) > len(self.rows):
                self.rows = np.vstack([self.rows[:start], np.zeros((max(start, len(new), 1024), len(self.model.langs)))])
            for k, w in enumerate(new):
                self.at[w] = start + k
                self.rows[start + k] = self.model.vector(w)
        total = self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(axis=0) + self.model.prior
        k = int(np.argmax(total))
        return self.model.langs[k], float(1 / np.exp(total - total[k]).sum())


def held_out(id_col: str):
    """True for the rows that the model may not learn from: CRC-32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", rows: int = ROWS_A_LANGUAGE) -> Model:
    """A model of the rows that aren't held out and have a language and a text; empty if there are none."""
    all_rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"), held_out(id_col).alias("out"))
    labelled = all_rows.where("not out and lang is not null and text is not null").select("id", "text", "lang")
    sizes = labelled.groupBy("lang").count().collect()  # a row a language
    if not sizes:
        return Model([], np.zeros(0), {}, {n: {} for n in LENGTHS})
    langs = sorted(r.lang for r in sizes)
    of = {r.lang: r["count"] for r in sizes}
    share = F.element_at(F.create_map(*[F.lit(x) for name in langs for x in (name, min(1.0, rows / of[name]))]), F.col("lang"))
    drawn = F.pmod(F.xxhash64(F.coalesce("id", F.xxhash64("text"))), F.lit(1_000_000)) < share * 1_000_000
    sample = labelled.where(drawn)

    def count(batches):
        for b in batches:
            seen: dict[str, Counter] = {}
            for t, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.setdefault(name, Counter()).update(words_of(t))
            out: Counter = Counter()
            for name, words in seen.items():
                for w, c in words.items():
                    out[name, 0, w] += c
                    for n in LENGTHS:
                        for g in grams(w, n):
                            out[name, n, g] += c
            keys = list(out)
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))] + [pa.array(list(out.values()), pa.int64())], ["lang", "n", "gram", "c"])

    counted = sample.select("text", "lang").mapInArrow(count, "lang string, n int, gram string, c long").groupBy("n", "gram", "lang").agg(F.sum("c").alias("c"))
    place = (F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1).cast("int")
    per_gram = counted.groupBy("n", "gram").agg(F.sum("c").alias("total"), F.collect_list(F.struct(place.alias("l"), "c")).alias("by"))  # an entry a language
    # the driver gets numbers only, those of the bounded sample
    seen = per_gram.where(F.col("total") >= LEAST_SEEN).select("n", F.xxhash64("gram").alias("h"), F.col("by.l").alias("l"), F.col("by.c").alias("c")).toArrow()
    model = Model(langs, np.log(np.array([of[x] for x in langs]) / sum(of.values())), {}, {})
    for n in (0, *LENGTHS):
        mine = seen.filter(pc.equal(seen["n"], n)).combine_chunks()
        c = np.full((len(mine), len(langs)), 0.5)
        if len(mine):
            entry = pc.list_parent_indices(mine["l"]).to_numpy()
            np.add.at(c, (entry, pc.list_flatten(mine["l"]).to_numpy()), pc.list_flatten(mine["c"]).to_numpy())
        logs = np.log(c / c.sum(axis=0))
        logs -= logs.mean(axis=1, keepdims=True)  # only differences between languages matter
        found = Table(mine["h"].to_numpy().view(np.uint64), logs.astype(np.float32))
        if n:
            model.grams[n] = found
        else:
            model.words = found
    return model


_predictors: dict[int, Predictor] = {}


def identify(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, held_out, lang_pred, score) for every row of ``docs``; the score is the share of the predicted
    language among all, from 0 to 1.

    Defined cases: a text that is null, empty or without a letter is `und` with score 0, and so is every text if the
    model knows no language; texts with only unseen letters get the most frequent language; ties go to the first
    language by name; null ids are not held out; repeated rows come back as given; other columns aren't looked at.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        key = id(sent.value)
        if key not in _predictors:
            _predictors.clear()
            _predictors[key] = Predictor(sent.value)
        predict = _predictors[key]
        for b in batches:
            found = [predict(x.decode("utf-8", "replace") if (x := v.as_py()) is not None else None) for v in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["id", "out", "lang", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("out"), F.col(text).cast("binary").alias("text"))
    return source.mapInArrow(run, "id long, out boolean, lang string, score double").toDF(id_col, "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model, text: str = "text", min_score: float = 0.3) -> DataFrame:
    """``docs`` without the rows whose text has no language (`und`) or one with a score below ``min_score``.

    Defined cases: null and empty texts and texts without a letter go; a null id changes nothing; repeated rows stay or
    go together; other columns pass unchanged, whatever their names; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(column):
        key = id(sent.value)
        if key not in _predictors:
            _predictors.clear()
            _predictors[key] = Predictor(sent.value)
        return column.map(lambda t: _predictors[key](t)[1])

    return docs.where(score(F.col(text)) >= min_score)


def op7_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))

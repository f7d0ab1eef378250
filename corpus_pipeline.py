"""From raw documents to packed sequences: language ID, line dedup, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. Run as
a job, each stage is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwerk.llm import copies, langid, lines, packing
from tarnwerk.llm.common import shared_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a recognisable language, with a model fitted on labelled rows of ``docs``.

    Null and empty texts and texts without a letter go; equal texts stay or go together; null ids change nothing; texts
    are read whole; without labelled rows every text goes; all columns pass unchanged; an empty table stays empty.
    """
    return langid.keep_identified(docs, langid.fit(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with one line of each class of similar lines left; n_chars follows the text.

    Null and empty texts stay, and a text that loses all its lines becomes empty; rows that share an id count as one
    document; rows with a null id lose nothing; of lines that tie, the one of the smallest id and position stays; a line
    of any length is compared whole; other columns pass unchanged; an empty table stays empty.
    """
    out = lines.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(docs.columns) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id: Jaccard similarity of the shingles of
    five words of at least 0.8, verified on the whole sets.

    A row is judged by its own text, so rows that share an id don't lose other texts; equal rows stay or go together;
    rows with a null id stay; other columns pass unchanged; an empty table stays empty.
    """
    return copies.keep_one(docs, width=5, threshold=0.8)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes.

    A null, empty or blank text gives one row without a bin; a text longer than the largest bin is cut into pieces; null
    ids and repeated rows are packed like any other; other columns aren't looked at; an empty table gives an empty result.
    """
    return packing.pack_texts(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: Fingerprints, signatures and the bin plan can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; what a stage returns is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline/{uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Token counts as delta-maintained rollups.

A batch of changes is reduced to signed sums by source, language and tokenizer version and added to a store in the
shared folder as one directory, which appears by a rename and is named by the batch: a batch that is there already is
not added again, a batch that was interrupted leaves nothing. Totals are sums over batches; a snapshot holds the sums of
the batches that it names, so that totals read it and what came after.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwerk.llm.common import cut, shared_dir

KEYS = ["source", "lang", "tokenizer"]
#: Tokenizer versions that need no vocabulary: words between ASCII white space, and runs of letters and numbers.
TOKENIZERS = {"words-1": r"[^ \t-\r]+", "words-2": r"[\p{L}\p{N}]+"}


class Rollup:
    """Totals by KEYS in a folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.at = lambda *p: jvm.org.apache.hadoop.fs.Path("/".join((self.path, *p)))
        self.fs = self.at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self, batch: str) -> bool:
        return self.fs.exists(self.at(f"batch={batch}"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False if it is there already.

        changes: KEYS, op ('insert', 'delete' or 'revise'), n_tokens, and old_tokens for 'revise'. A null count is 0,
        a null key is a key of its own, an unknown op is an error, other columns aren't looked at.
        """
        if not batch or set(batch) & set("/\\=*?[]{} "):
            raise ValueError(f"no name for a batch: {batch!r}")
        if self.committed(batch):
            return False
        n, old = F.coalesce("n_tokens", F.lit(0)).cast("long"), F.coalesce("old_tokens", F.lit(0)).cast("long")
        known = lambda i, d, r: F.when(F.col("op") == "insert", i).when(F.col("op") == "delete", d).when(F.col("op") == "revise", r).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))))
        one = F.lit(1).cast("long")
        signed = changes.select(*KEYS, known(one, -one, one * 0).alias("docs"), known(n, -n, n - old).alias("tokens"))
        staged = f"_staged-{uuid4().hex}"
        signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{self.path}/{staged}")
        done = self.fs.rename(self.at(staged), self.at(f"batch={batch}")) if not self.committed(batch) else False
        inside = self.at(f"batch={batch}", staged)
        if self.fs.exists(inside):  # another writer was faster, and the rename went into its folder, unseen by readers
            self.fs.delete(inside, True)
            done = False
        elif not done:
            self.fs.delete(self.at(staged), True)
            if not self.committed(batch):
                raise OSError(f"batch {batch} could not be committed")
        return done

    def _names(self, start: str) -> list[str]:
        found = [s.getPath().getName() for s in self.fs.listStatus(self.at())] if self.fs.exists(self.at()) else []
        return sorted(n[len(start) :] for n in found if n.startswith(start))

    def _sums(self) -> tuple[DataFrame, list[str]]:
        """(rows to be added up, the batches that they stand for): the newest snapshot and the batches after it."""
        snapshots, batches = self._names("upto="), self._names("batch=")
        old = f"{self.path}/upto={snapshots[-1]}" if snapshots else None
        covered = {r.batch for r in self.spark.read.schema("batch string").parquet(f"{old}/batches").collect()} if old else set()  # a name a commit
        paths = [f"{self.path}/batch={b}" for b in batches if b not in covered] + ([f"{old}/sums"] if old else [])
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        return (self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)), batches

    def compact(self) -> None:
        """Write the sums of all batches that are there as a snapshot, which appears by a rename. The batches stay, for
        their names say what was committed."""
        rows, batches = self._sums()
        staged, number = f"_staged-{uuid4().hex}", len(self._names("upto="))
        rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{self.path}/{staged}/sums")
        self.spark.createDataFrame([(b,) for b in batches], "batch string").coalesce(1).write.parquet(f"{self.path}/{staged}/batches")
        if not self.fs.rename(self.at(staged), self.at(f"upto={number:012d}-{uuid4().hex}")):
            raise OSError("a snapshot could not be committed")

    def totals(self) -> DataFrame:
        """KEYS, n_docs, n_tokens over all batches; keys whose sums are both zero are left out."""
        sums = self._sums()[0].groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")


def inserts(docs: DataFrame, path: str | None = None, text: str = "text", op: str = "insert") -> DataFrame:
    """Changes for Rollup.commit that add (``op`` 'delete': take away) documents (source, lang, ``text``) under a
    vocabulary file, whose name is the tokenizer's version; a null text has no tokens."""
    from tarnwerk.llm import bpe

    counts = bpe.count_tokens(docs.select("source", "lang", F.col(text).alias("text")), path=path)
    version = F.lit((path or bpe.default_path()).rsplit("/", 1)[-1])
    return counts.select("source", "lang", version.alias("tokenizer"), F.lit(op).alias("op"), "n_tokens", F.lit(None).cast("long").alias("old_tokens"))


def counted(text: Column, tokenizer: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("long")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Four batches over whole tables, one of them sent twice: every document's words-1 count inserted; the same with
    words-2; words-1 revised to what words-2 finds in it, for documents that have a label; documents labelled toxic
    deleted under both.

    Defined cases: a null or empty text has 0 tokens and counts as a document; null sources and languages are keys of
    their own; a document without an id or a label keeps its first count; rows that share an id are documents of their
    own, all with that id's label; an id that is labelled twice is toxic if one label says so; texts of any length are
    read whole; other columns aren't looked at; empty tables give an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = cut(docs.select("doc_id", "source", "lang", counted(F.col("text"), "words-1").alias("n1"), counted(F.col("text"), "words-2").alias("n2")))
    marked = rows.join(labels, "doc_id")
    change = lambda d, op, tokenizer, n, old=None: d.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(op).alias("op"), F.col(n).alias("n_tokens"), (F.col(old) if old else F.lit(None).cast("long")).alias("old_tokens"))
    store = Rollup(spark, f"{shared_dir(spark)}/rollups/{uuid4().hex}")
    store.commit("load-1", change(rows, "insert", "words-1", "n1"))
    store.commit("load-2", change(rows, "insert", "words-2", "n2"))
    store.commit("revise-1", change(marked, "revise", "words-1", "n2", "n1"))
    store.commit("load-1", change(rows, "insert", "words-1", "n1"))
    toxic = marked.where("toxic = 1")
    store.commit("takedown-1", change(toxic, "delete", "words-1", "n2").unionByName(change(toxic, "delete", "words-2", "n2")))
    return store.totals()


OP6_SQL = r"""
WITH l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT d.source, d.lang, coalesce(len(regexp_extract_all(d.text, '[^ \t-\r]+')), 0) AS n1,
    coalesce(len(regexp_extract_all(d.text, '[\p{L}\p{N}]+')), 0) AS n2, l.doc_id IS NOT NULL AS marked, coalesce(l.toxic = 1, false) AS toxic
  FROM documents d LEFT JOIN l USING (doc_id)
), e AS (
  SELECT source, lang, 'words-1' AS tokenizer, CASE WHEN marked THEN n2 ELSE n1 END AS n FROM d WHERE NOT toxic
  UNION ALL SELECT source, lang, 'words-2', n2 FROM d WHERE NOT toxic
)
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM e GROUP BY ALL
HAVING count(*) <> 0
"""

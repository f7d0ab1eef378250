"""The token-count query on odd rows, against its SQL."""

import duckdb
import pytest

from tarnwerk.llm import rollup

DOCS = [
    (1, "a", "en", "two words"), (1, "a", "en", "same id, other text"), (1, "a", "en", "two words"), (2, "a", "en", None), (3, "a", None, ""), (4, None, "de", "x-y z"),
    (None, "a", "en", "no id"), (5, "b", "de", "toxic one"), (6, "b", "de", "tab\tfeed\nend\u00a0nbsp"), (7, "c", "en", "w-w " * 50_000),
]
LABELS = [(1, 0), (5, 0), (5, 1), (6, None), (None, 1), (7, 0), (99, 1)]


@pytest.mark.parametrize("docs,labels", [(DOCS, LABELS), (DOCS, []), ([], LABELS)])
def test_query_equals_its_sql(spark, tmp_path, docs, labels):
    spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, source string, lang string, text string, tokenizer string, n1 int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(*x, 9) for x in labels], "doc_id long, toxic int, source int").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = rollup.op6_token_counts(spark, str(tmp_path)).select("source", "lang", "tokenizer", "n_docs", "n_tokens").collect()
    assert sorted(map(tuple, found), key=str) == sorted(con.sql(f"SELECT source, lang, tokenizer, n_docs, n_tokens FROM ({rollup.OP6_SQL})").fetchall(), key=str)

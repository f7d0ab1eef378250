"""The queries of this subpackage by name, and their SQL where SQL can say it."""

from __future__ import annotations

from tarnwerk.llm.bpe import op5_bpe
from tarnwerk.llm.langid import op7_langid
from tarnwerk.llm.lines import op9_line_dedup
from tarnwerk.llm.packing import op4_packing
from tarnwerk.llm.rollup import OP6_SQL, op6_token_counts
from tarnwerk.llm.shards import op2_shards
from tarnwerk.llm.simhash import op10_simhash
from tarnwerk.llm.topk import OP3_SQL, op3_topk
from tarnwerk.llm.urls import OP8_SQL, op8_url_filters
from tarnwerk.llm.vectors import OP1_SQL, op1_embedding_dedup

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_shards": op2_shards,
    "op3_topk": op3_topk,
    "op4_packing": op4_packing,
    "op5_bpe": op5_bpe,
    "op6_token_counts": op6_token_counts,
    "op7_langid": op7_langid,
    "op8_url_filters": op8_url_filters,
    "op9_line_dedup": op9_line_dedup,
    "op10_simhash": op10_simhash,
}
ORACLES: dict[str, str] = {"op1_embedding_dedup": OP1_SQL, "op3_topk": OP3_SQL, "op6_token_counts": OP6_SQL, "op8_url_filters": OP8_SQL}

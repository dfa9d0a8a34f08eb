"""Queries of the pipeline operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framelake.llm.ann import op7_ann
from framelake.llm.chat import OP12_SQL, op12_chat
from framelake.llm.decontaminate import OP10_SQL, op10_decontaminate
from framelake.llm.extract import op4_html_text
from framelake.llm.lines import OP5_SQL, op5_line_dedup
from framelake.llm.merkle import OP13_SQL, op13_merkle
from framelake.llm.packing import op6_packing
from framelake.llm.pii import op8_pii
from framelake.llm.simhash import op2_simhash
from framelake.llm.tokens import op9_tokens
from framelake.llm.toxicity import op3_toxicity
from framelake.llm.trie import OP11_SQL, op11_trie
from framelake.llm.warc import OP1_SQL, op1_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_warc": op1_warc, "op2_simhash": op2_simhash, "op3_toxicity": op3_toxicity, "op4_html_text": op4_html_text, "op5_line_dedup": op5_line_dedup, "op6_packing": op6_packing, "op7_ann": op7_ann, "op8_pii": op8_pii, "op9_tokens": op9_tokens, "op10_decontaminate": op10_decontaminate, "op11_trie": op11_trie, "op12_chat": op12_chat, "op13_merkle": op13_merkle}
ORACLES: dict[str, str] = {"op1_warc": OP1_SQL, "op5_line_dedup": OP5_SQL, "op10_decontaminate": OP10_SQL, "op11_trie": OP11_SQL, "op12_chat": OP12_SQL, "op13_merkle": OP13_SQL}

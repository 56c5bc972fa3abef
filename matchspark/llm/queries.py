"""The operators' queries and, where SQL can express one, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchspark.llm.chat import OP8_SQL, op8_chat_perspectives
from matchspark.llm.decontaminate import op4_decontaminate
from matchspark.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from matchspark.llm.language_id import op10_language_id
from matchspark.llm.minhash import op11_minhash
from matchspark.llm.packing import op3_packing
from matchspark.llm.pii import op2_pii
from matchspark.llm.quality import op5_quality_rules
from matchspark.llm.ranked_search import OP12_SQL, op12_ranked_search
from matchspark.llm.simhash import op1_simhash
from matchspark.llm.substring_dedup import op9_substring_dedup
from matchspark.llm.toxicity import op6_toxicity
from matchspark.llm.url_filter import op7_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op10_language_id": op10_language_id,
    "op5_quality_rules": op5_quality_rules,
    "op6_toxicity": op6_toxicity,
    "op2_pii": op2_pii,
    "op1_simhash": op1_simhash,
    "op4_decontaminate": op4_decontaminate,
    "op3_packing": op3_packing,
    "op8_chat_perspectives": op8_chat_perspectives,
    "op7_url_filter": op7_url_filter,
    "op9_substring_dedup": op9_substring_dedup,
    "op11_minhash": op11_minhash,
    "op12_ranked_search": op12_ranked_search,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op8_chat_perspectives": OP8_SQL,
    "op12_ranked_search": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}

"""Queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op3_nearest_neighbours
from .chat import ORACLE_OP6, op6_chat_formatting
from .chosen_path import op10_chosen_path
from .conversation_repair import op13_conversation_repair
from .decontaminate import ORACLE_OP12, op12_decontamination
from .html import op1_html_extraction
from .langid import op5_language_id
from .mixing import op9_mixing
from .neardup_vectors import ORACLE_OP4, op4_embedding_neardup
from .pieces import op7_sentencepiece
from .sharding import op2_sharding
from .spelling import op11_spelling_variants
from .suffix_dedup import op8_suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_html_extraction, op2_sharding, op3_nearest_neighbours, op4_embedding_neardup,
    op5_language_id, op6_chat_formatting, op7_sentencepiece, op8_suffix_dedup, op9_mixing, op10_chosen_path,
    op11_spelling_variants, op12_decontamination, op13_conversation_repair)}

ORACLE_SQL: dict[str, str] = {"op4_embedding_neardup": ORACLE_OP4, "op6_chat_formatting": ORACLE_OP6,
                              "op12_decontamination": ORACLE_OP12}

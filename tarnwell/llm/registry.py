"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tarnwell.llm.chat import OP5_SQL, op5_chat
from tarnwell.llm.fingerprint import OP1_SQL, op1_fingerprint
from tarnwell.llm.langid import op4_language
from tarnwell.llm.neardup import OP2_SQL, op2_near_duplicates
from tarnwell.llm.ngrams import op10_scores
from tarnwell.llm.packing import op9_packing
from tarnwell.llm.pieces import op3_sentencepiece
from tarnwell.llm.quality import op6_quality
from tarnwell.llm.secrets import op8_secrets
from tarnwell.llm.urls import OP7_SQL, op7_urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each operator over its whole table, and the pipeline."""
    own = (op1_fingerprint, op2_near_duplicates, op3_sentencepiece, op4_language, op5_chat, op6_quality, op7_urls, op8_secrets, op9_packing, op10_scores)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express an operator; the others are tested against brute force."""
    sql = {"op1_fingerprint": OP1_SQL, "op2_near_duplicates": OP2_SQL, "op5_chat": OP5_SQL, "op7_urls": OP7_SQL}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

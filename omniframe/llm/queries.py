"""The training-data operators' queries and their SQL, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from omniframe.llm import decontaminate, html_text, language, lm_score, mixing, quality, simhash, substrings, token_store, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": html_text.op1_html_text,
    "op2_lm_score": lm_score.op2_lm_score,
    "op3_simhash": simhash.op3_simhash,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_mixing": mixing.op5_mixing,
    "op6_substrings": substrings.op6_substrings,
    "op7_language": language.op7_language,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_quality": quality.op9_quality,
    "op10_token_store": token_store.op10_token_store,
}

#: DuckDB SQL of those that SQL can express.
ORACLE: dict[str, str] = {"op2_lm_score": lm_score.SQL, "op4_url_filter": url_filter.SQL, "op5_mixing": mixing.SQL, "op6_substrings": substrings.SQL}

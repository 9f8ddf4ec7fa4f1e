"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bagminhash, decontamination, lines, repeats
from graphloom.llm.chat import op1_chat_turns
from graphloom.llm.language import op5_language
from graphloom.llm.media_query import op4_tiff_media
from graphloom.llm.packing import op6_best_fit
from graphloom.llm.toxicity import op3_toxicity
from graphloom.llm.wordpiece import op9_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_turns": op1_chat_turns,
    "op2_prefix_decontamination": decontamination.op2_prefix_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_tiff_media": op4_tiff_media,
    "op5_language": op5_language,
    "op6_best_fit": op6_best_fit,
    "op7_line_spread": lines.op7_line_spread,
    "op8_repeated_windows": repeats.op8_repeated_windows,
    "op9_token_counts": op9_token_counts,
    "op10_bagminhash": bagminhash.op10_bagminhash,
}
ORACLE_SQL: dict[str, str] = {
    "op2_prefix_decontamination": decontamination.ORACLE,
    "op7_line_spread": lines.ORACLE,
    "op8_repeated_windows": repeats.ORACLE,
    "op10_bagminhash": bagminhash.ORACLE,
}

"""The queries of this subpackage and the SQL that states what they return, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import binary_output, chat, exact_dedup, html_extract, licences, minhash, mixing, quality, sentencepiece_codec, suffix_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": sentencepiece_codec.op1,
        "op2_html_extract": html_extract.op2,
        "op3_binary_output": binary_output.op3,
        "op4_chat_format": chat.op4,
        "op5_mixing": mixing.op5,
        "op6_licences": licences.op6,
        "op7_suffix_dedup": suffix_dedup.op7,
        "op8_quality": quality.op8,
        "op9_exact_dedup": exact_dedup.op9,
        "op10_minhash": minhash.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": chat.SQL, "op9_exact_dedup": exact_dedup.SQL, "op10_minhash": minhash.SQL}

"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankforge.llm import chat, codes, dedup, language, mixing, multi_index, packing, quality, runs, secrets, topk, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_mil": quality.query,
        "op2_topk": topk.query,
        "op3_mixing": mixing.query,
        "op4_near_dedup": dedup.query,
        "op5_language": language.query,
        "op6_multi_index": multi_index.query,
        "op7_packing": packing.query,
        "op8_chat_format": chat.query,
        "op9_url_filter": url_filter.query,
        "op10_warc_revisit": warc.query,
        "op11_periodic_runs": runs.query,
        "op12_vector_codes": codes.query,
        "op13_secret_scan": secrets.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_topk": topk.ORACLE_SQL,
        "op3_mixing": mixing.ORACLE_SQL,
        "op8_chat_format": chat.ORACLE_SQL,
        "op9_url_filter": url_filter.ORACLE_SQL,
        "op10_warc_revisit": warc.ORACLE_SQL,
        "op12_vector_codes": codes.ORACLE_SQL,
        "op13_secret_scan": secrets.ORACLE_SQL,
    }

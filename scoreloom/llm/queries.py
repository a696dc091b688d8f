"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scoreloom.llm import alignment, decontam, extraction, licences, mixing, neardup, packing, quality, repair, sharding, substrings, urls, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_html_extraction": extraction.op2_html_extraction,
        "op3_decontamination": decontam.op3_decontamination,
        "op4_suffix_dedup": substrings.op4_suffix_dedup,
        "op5_mixing": mixing.op5_mixing,
        "op6_licence_scan": licences.op6_licence_scan,
        "op7_near_duplicates": neardup.op7_near_duplicates,
        "op8_url_filter": urls.op8_url_filter,
        "op9_warc": warc.op9_warc,
        "op10_quality_rules": quality.op10_quality_rules,
        "op11_alignment": alignment.op11_alignment,
        "op12_repair": repair.op12_repair,
        "op13_packing": packing.op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": decontam.OP3_SQL, "op4_suffix_dedup": substrings.OP4_SQL, "op7_near_duplicates": neardup.OP7_SQL, "op8_url_filter": urls.OP8_SQL, "op9_warc": warc.OP9_SQL, "op12_repair": repair.OP12_SQL}

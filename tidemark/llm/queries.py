"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, html_extract, language, minhash, packing, phrases, quality, simhash, substring_dedup, url_filter, vector_codes, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": html_extract.query,
        "op2_decontamination": decontaminate.query,
        "op3_url_filter": url_filter.query,
        "op4_exact_dedup": exact_dedup.query,
        "op5_substring_dedup": substring_dedup.query,
        "op6_packing": packing.query,
        "op7_quality": quality.query,
        "op8_language": language.query,
        "op9_warc": warc.query,
        "op10_minhash": minhash.query,
        "op11_simhash": simhash.query,
        "op12_vector_codes": vector_codes.query,
        "op13_phrases": phrases.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": decontaminate.SQL,
        "op3_url_filter": url_filter.SQL,
        "op4_exact_dedup": exact_dedup.SQL,
        "op5_substring_dedup": substring_dedup.SQL,
        "op9_warc": warc.SQL,
        "op10_minhash": minhash.SQL,
        "op12_vector_codes": vector_codes.SQL,
        "op13_phrases": phrases.SQL,
    }

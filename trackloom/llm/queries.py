"""Queries of this package for __spark_entry__.py, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm.automaton import op11_bpe_automaton
from trackloom.llm.decontaminate import SQL as DECONTAMINATE_SQL
from trackloom.llm.decontaminate import op7_benchmark_decontamination
from trackloom.llm.fingerprints import op10_document_fingerprints
from trackloom.llm.licenses import op4_license_scans
from trackloom.llm.lines import op6_line_dedup
from trackloom.llm.merkle import SQL as MERKLE_SQL
from trackloom.llm.merkle import op13_merkle_manifest
from trackloom.llm.packing import op8_best_fit_packing
from trackloom.llm.setsketch import op9_minhash_near_dedup
from trackloom.llm.suffixes import op5_suffix_array_dedup
from trackloom.llm.substring import op3_substring_dedup
from trackloom.llm.toxicity import op1_toxicity
from trackloom.llm.urls import SQL as URLS_SQL
from trackloom.llm.urls import op2_url_filters
from trackloom.llm.whitening import op12_embedding_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_url_filters": op2_url_filters,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_license_scans": op4_license_scans,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_document_fingerprints": op10_document_fingerprints,
    "op11_bpe_automaton": op11_bpe_automaton,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {"op2_url_filters": URLS_SQL, "op7_benchmark_decontamination": DECONTAMINATE_SQL, "op13_merkle_manifest": MERKLE_SQL}

"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .chat_format import OP6_SQL, op6_chat_formatting
from .decontaminate import OP3_SQL, op3_benchmark_decontamination
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .html_extract import op8_html_extraction
from .huffman import op1_token_output
from .packing import op9_best_fit_packing
from .quality import op4_quality_classifier
from .secrets import OP10_SQL, op10_secret_scan
from .simhash import op2_simhash_neardup
from .substring_dedup import op5_suffix_dedup

QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_simhash_neardup": op2_simhash_neardup,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_html_extraction": op8_html_extraction,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_secret_scan": op10_secret_scan,
}
ORACLE_SQL = {"op3_benchmark_decontamination": OP3_SQL, "op6_chat_formatting": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op10_secret_scan": OP10_SQL}

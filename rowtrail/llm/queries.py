"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from .decontaminate import OP10_SQL, op10_benchmark_decontamination
from .fim import OP13_SQL, op13_fill_in_middle
from .html_text import op9_html_extraction
from .jaccard import OP3_SQL, op3_ngram_jaccard_join
from .lines import OP4_SQL, op4_line_dedup
from .media import op2_media_columns
from .parts import MEDIA_SQL, SECRET_SQL, URL_SQL, media_payloads, secret_base_spans, url_rules
from .periodic import OP11_SQL, op11_periodic_runs
from .pieces import op5_sentencepiece
from .quality import op12_quality
from .secrets import op8_secret_scans
from .suffix import OP1_SQL, op1_suffix_array_dedup
from .toxicity import op7_toxicity
from .urls import op6_url_filters

QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_media_columns": op2_media_columns,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_line_dedup": op4_line_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_url_filters": op6_url_filters,
    "op7_toxicity": op7_toxicity,
    "op8_secret_scans": op8_secret_scans,
    "op9_html_extraction": op9_html_extraction,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_quality": op12_quality,
    "op13_fill_in_middle": op13_fill_in_middle,
    "media_payloads": media_payloads,
    "url_rules": url_rules,
    "secret_base_spans": secret_base_spans,
}
ORACLE_SQL = {
    "op1_suffix_array_dedup": OP1_SQL,
    "op3_ngram_jaccard_join": OP3_SQL,
    "op4_line_dedup": OP4_SQL,
    "op10_benchmark_decontamination": OP10_SQL,
    "op11_periodic_runs": OP11_SQL,
    "op13_fill_in_middle": OP13_SQL,
    "media_payloads": MEDIA_SQL,
    "url_rules": URL_SQL,
    "secret_base_spans": SECRET_SQL,
}

"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, html_extract, lexical, line_rules, media, mixing, ngram_join, packing, quality, token_counts, topk, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
    "op3_source_mix": mixing.op3_source_mix,
    "op4_media_columns": media.op4_media_columns,
    "op5_html_extraction": html_extract.op5_html_extraction,
    "op6_url_filter": urls.op6_url_filter,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_topk_search": topk.op9_topk_search,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_collocations": collocations.op11_collocations,
    "op12_line_rules": line_rules.op12_line_rules,
    "op13_lexical_search": lexical.op13_lexical_search,
}

SQL: dict[str, str] = {
    "op3_source_mix": mixing.OP3_SQL,
    "op9_topk_search": topk.OP9_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op12_line_rules": line_rules.OP12_SQL,
    "op13_lexical_search": lexical.OP13_SQL,
}

"""Queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, html_template, jaccard_join, language_crf, multi_index, packing, pseudonyms, token_shards, topk, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.op1_packing,
    "op2_html_template": html_template.op2_html_template,
    "op3_pseudonyms": pseudonyms.op3_pseudonyms,
    "op4_bpe": bpe.op4_bpe,
    "op5_token_shards": token_shards.op5_token_shards,
    "op6_exact_topk": topk.op6_exact_topk,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_language_crf": language_crf.op8_language_crf,
    "op9_multi_index": multi_index.op9_multi_index,
    "op10_warc": warc.op10_warc,
}

ORACLES: dict[str, str] = {
    "op6_exact_topk": topk.OP6_SQL,
    "op7_jaccard_join": jaccard_join.OP7_SQL,
    "op10_warc": warc.OP10_SQL,
}

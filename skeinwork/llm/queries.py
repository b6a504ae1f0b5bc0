"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import additive, audit, blockmax, html, licences, mixing, ngram_join, oracles, packing, pii, quality, spotsigs, urls, whitening
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_jaccard_join": lambda s, d: ngram_join.query(table(s, d, "documents")),
        "op2_licence_scan": lambda s, d: licences.query(table(s, d, "documents")),
        "op3_quality_classifier": additive.query,
        "op4_pii": lambda s, d: pii.query(table(s, d, "documents")),
        "op5_mixing": lambda s, d: mixing.query(table(s, d, "documents")),
        "op6_packing": lambda s, d: packing.query(table(s, d, "documents")),
        "op7_spot_signatures": lambda s, d: spotsigs.query(table(s, d, "documents")),
        "op8_html_main_text": lambda s, d: html.query(table(s, d, "pages")),
        "op9_url_filter": urls.query,
        "op10_quality_rules": lambda s, d: quality.query(table(s, d, "documents")),
        "op11_whitening": lambda s, d: whitening.query(table(s, d, "embeddings")),
        "op12_filter_audit": audit.query,
        "op13_exact_top_k": lambda s, d: blockmax.query(table(s, d, "embeddings")),
        "spot_near_documents": lambda s, d: spotsigs.near_duplicates(table(s, d, "documents")),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": oracles.ngram_join(),
        "op2_licence_scan": oracles.licence_scan(),
        "op10_quality_rules": oracles.quality_rules(),
        "op12_filter_audit": oracles.filter_audit(),
        "op13_exact_top_k": oracles.exact_top_k(),
        "spot_near_documents": oracles.near_documents(),
    }

"""Queries over whole tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clickloom.llm import chat, filter_audit, fingerprints, html_text, language, mixing, near_dedup, neighbours, ngram_join, packing, toxicity, vector_codes, warc
from clickloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": lambda spark, sf_dir: html_text.op1_html_text(table(spark, sf_dir, "pages")),
    "op2_winnowing": lambda spark, sf_dir: fingerprints.op2_winnowing(table(spark, sf_dir, "documents")),
    "op3_warc": lambda spark, sf_dir: warc.op3_warc(table(spark, sf_dir, "pages")),
    "op4_packing": lambda spark, sf_dir: packing.op4_packing(table(spark, sf_dir, "documents")),
    "op5_neighbours": lambda spark, sf_dir: neighbours.op5_neighbours(table(spark, sf_dir, "embeddings")),
    "op6_toxicity": lambda spark, sf_dir: toxicity.op6_toxicity(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ),
    "op7_language": lambda spark, sf_dir: language.op7_language(table(spark, sf_dir, "documents")),
    "op8_mixing": lambda spark, sf_dir: mixing.op8_mixing(table(spark, sf_dir, "documents")),
    "op9_chat": lambda spark, sf_dir: chat.op9_chat(table(spark, sf_dir, "conversations")),
    "op10_near_dedup": lambda spark, sf_dir: near_dedup.op10_near_dedup(table(spark, sf_dir, "documents")),
    "op11_vector_codes": lambda spark, sf_dir: vector_codes.op11_vector_codes(table(spark, sf_dir, "embeddings")),
    "op12_ngram_join": lambda spark, sf_dir: ngram_join.op12_ngram_join(table(spark, sf_dir, "documents")),
    "op13_filter_audit": lambda spark, sf_dir: filter_audit.op13_filter_audit(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ),
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": warc.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op9_chat": chat.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_ngram_join": ngram_join.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}

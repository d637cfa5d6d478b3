"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, html, minhash, packing, secrets, simhash, tokens, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Query] = {
    "op1_token_counts": lambda s, d: tokens.token_counts(_table(s, d, "documents")),
    "op2_simhash_near_dedup": lambda s, d: simhash.near_duplicates(_table(s, d, "documents")),
    "op3_toxicity": lambda s, d: toxicity.toxicity(_table(s, d, "documents"), _table(s, d, "labels")),
    "op4_benchmark_decontamination": lambda s, d: decontaminate.matches(_table(s, d, "documents"), _table(s, d, "benchmark")),
    "op5_warc": lambda s, d: warc.round_trip(_table(s, d, "pages")),
    "op6_document_fingerprints": lambda s, d: minhash.edited_fingerprints(_table(s, d, "documents")),
    "op7_secret_scans": lambda s, d: secrets.scan(_table(s, d, "documents"), secrets.train(s)),
    "op8_packing": lambda s, d: packing.pack(_table(s, d, "documents"), vocabulary=tokens.VOCABULARY),
    "op9_html_extraction": lambda s, d: html.extract(_table(s, d, "pages")),
    "op10_chat_formatting": lambda s, d: chat.preferences(_table(s, d, "conversations")),
}

ORACLES: dict[str, str] = {"op10_chat_formatting": chat.PREFERENCES_SQL}

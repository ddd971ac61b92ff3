"""The registered queries of this subpackage: thin calls of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.chat import chat_format
from docweave.llm.decontaminate import find_contamination
from docweave.llm.exact_dedup import exact_duplicates
from docweave.llm.html_text import extract_pages
from docweave.llm.merkle import merkle_manifest
from docweave.llm.mixing import mix_sources
from docweave.llm.ngram_model import lm_scores
from docweave.llm.repair import damage, repair_report
from docweave.llm.secrets import scan_secrets
from docweave.llm.simhash import near_duplicates
from docweave.llm.token_counts import count_tokens
from docweave.llm.topk import exact_top_k
from docweave.llm.toxicity import toxicity

from docweave.session import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).drop("source")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return find_contamination(docs, items, window=10).drop("spans")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, seed=42)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(_table(spark, sf_dir, "conversations"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"), keep="largest")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(_table(spark, sf_dir, "documents"))


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return repair_report(turns, damage(turns))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_mixing": op2_mixing,
        "op3_decontamination": op3_decontamination,
        "op4_simhash": op4_simhash,
        "op5_chat": op5_chat,
        "op6_lm": op6_lm,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_html": op8_html,
        "op9_secrets": op9_secrets,
        "op10_tokens": op10_tokens,
        "op11_merkle": op11_merkle,
        "op12_topk": op12_topk,
        "op13_repair": op13_repair,
    }

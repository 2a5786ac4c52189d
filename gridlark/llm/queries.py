"""The queries of the corpus operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridlark.llm import alignment, chat, decontaminate, licenses, pieces, quality, tokens
from gridlark.llm.language import identify
from gridlark.llm.neighbours import nearest
from gridlark.llm.secrets import secret_spans
from gridlark.llm.simhash import near_duplicates
from gridlark.llm.toxicity import toxicity
from gridlark.llm.whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_spans(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence statements in every document."""
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged by the current quality policy."""
    return quality.quality(table(spark, sf_dir, "documents"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy version costs, from a stored ledger of all documents."""
    return quality.ablation(quality.new_ledger(table(spark, sf_dir, "documents"), []))


def op4_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's last reply against another's, as preference pairs."""
    return chat.swapped_replies(table(spark, sf_dir, "conversations"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that stand in documents."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its SimHash and near-duplicate component."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and what they decode to."""
    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identify(table(spark, sf_dir, "documents"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest neighbours of every fiftieth embedding."""
    return nearest(table(spark, sf_dir, "embeddings"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers correspond in every document."""
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding along eight whitened components."""
    return whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to function."""
    return {
        f.__name__: f
        for f in (
            op1_secret_scan,
            op2_license_scan,
            op3_quality_rules,
            quality_ablation,
            op4_chat_preferences,
            op5_decontamination,
            op6_token_counts,
            op7_simhash_near_dedup,
            op8_toxicity,
            op9_piece_codec,
            op10_language_id,
            op11_nearest_neighbours,
            op12_cross_tokenizer_alignment,
            op13_embedding_whitening,
        )
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {
        "op2_license_scan": licenses.sql(),
        "op3_quality_rules": quality.sql(),
        "quality_ablation": quality.ablation_sql(),
        "op4_chat_preferences": chat.sql(),
        "op5_decontamination": decontaminate.sql(),
    }

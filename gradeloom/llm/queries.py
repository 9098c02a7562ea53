"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_documents

Query = Callable[[SparkSession, str], DataFrame]


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_rules import judge_documents

    docs = judge_documents(read_documents(spark, sf_dir).select("doc_id", "text"))
    return docs.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "left_chars")


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(read_documents(spark, sf_dir)).drop("kept_text")


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ordinal_quality import grade_documents

    return grade_documents(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(read_documents(spark, sf_dir))


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pseudonyms import KINDS, key_of, masked_column

    docs = masked_column(read_documents(spark, sf_dir).select("doc_id", "text"), "masked", key_of(spark))
    return docs.select("doc_id", "masked.text", *(F.col(f"masked.{k}").alias(f"n_{k}") for k in KINDS))


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(read_documents(spark, sf_dir)).drop("kept")


def op6_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .masked_lm import grade_documents

    return grade_documents(read_documents(spark, sf_dir))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import plan_mix, size_table

    return plan_mix(size_table(read_documents(spark, sf_dir))).select("doc_id", "size", "source_size", "target", "taken")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_components

    return near_components(read_documents(spark, sf_dir))


def op9_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .transport_stream import media_table

    return media_table(read_documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_substring, op2_ordinal_quality, op3_pack, op4_pseudonyms, op5_suffix, op6_masked_lm, op7_mix, op8_simhash, op9_transport_stream, op10_line_rules)}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return {"op1_substring": oracles.SUBSTRING, "op7_mix": oracles.MIX, "op10_line_rules": oracles.LINE_RULES}

"""Driver queries of the training-data operators: thin, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_extract, language_id, line_dedup, merkle, mixing, run_index, sharding, simhash, tiered_index, token_frames, topk_search, warc
from .common import table


def op1_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_term_at_a_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.digest(table(spark, sf_dir, "embeddings"))


def op3_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op4_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs)


def op5_byte_rnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(table(spark, sf_dir, "documents"))


def op6_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


def op7_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.digest(table(spark, sf_dir, "documents"))


def op8_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op9_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op10_window_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_broadcast_upper_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(table(spark, sf_dir, "documents"))


def op12_seekable_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_frames.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered_index.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_tag_path_text,
        op2_term_at_a_time,
        op3_hypergeometric_shards,
        op4_line_windows,
        op5_byte_rnn_language,
        op6_warc_writer,
        op7_run_length_index,
        op8_fair_queue_mix,
        op9_golay_simhash,
        op10_window_decontamination,
        op11_broadcast_upper_tree,
        op12_seekable_token_frames,
        op13_tiered_search,
    )
}

ORACLES: dict[str, str] = {
    "op2_term_at_a_time": topk_search.ORACLE,
    "op4_line_windows": line_dedup.ORACLE,
    "op6_warc_writer": warc.ORACLE,
    "op8_fair_queue_mix": mixing.ORACLE,
    "op11_broadcast_upper_tree": merkle.ORACLE,
    "op13_tiered_search": tiered_index.ORACLE,
}
